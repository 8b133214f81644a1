"""The latent space of op7 against the same subspace rounds over all passages at once, with whole matrices."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import decontamination


@pytest.mark.parametrize("query", ["op7", "pipeline"])
def test_space_is_fitted_on_all_documents(spark, monkeypatch, tmp_path, query):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(600)]
    topic = lambda k: [words[(k * 7 + rng.randrange(1 + k % 40)) % 600] for _ in range(rng.randrange(20, 160))]
    docs = [(i, " ".join(topic(rng.randrange(300)) + rng.sample(words, 3))) for i in range(3000)] + [(3000, None), (3001, "")]
    items = [(i, " ".join(rng.sample(words, 30))) for i in range(40)]
    seen = {}
    groups = decontamination.groups_of
    monkeypatch.setattr(decontamination, "groups_of", lambda own, term: seen.update(items=own, term=term) or groups(own, term))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5, "doc_id")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    if query == "op7":
        decontamination.contaminated(frame, bench).count()
    else:
        bench.write.parquet(f"{tmp_path}/benchmark.parquet")
        dict(corpus_pipeline.STAGES)["decontamination"](spark, frame, str(tmp_path)).count()
    vocabulary, term = seen["items"].vocabulary, seen["term"]
    v = len(vocabulary)
    assert decontamination.RANK + decontamination.EXTRA < v

    weight = decontamination.idf(frame, vocabulary)

    def passages(texts):
        out = []
        for t in filter(None, texts):
            at = np.searchsorted(vocabulary, decontamination.items_of([(0, t, None)]).words[0])
            out += [np.bincount(at[lo : lo + decontamination.PASSAGE], minlength=v) for lo in range(0, len(at), decontamination.PASSAGE)]
        x = np.array(out) * weight[:v]
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    known = {w for _, t in items for w in t.split()}
    # words that no item has take a place in a passage but aren't in the space
    lengths = []
    for _, t in docs:
        own = (t or "").split()
        lengths += [[w for w in own[lo : lo + decontamination.PASSAGE] if w in known] for lo in range(0, len(own), decontamination.PASSAGE)]
    a, b = passages(" ".join(x) for x in lengths if x), passages(t for _, t in items)
    gram = a.T @ a + b.T @ b * (decontamination.ITEM_ENERGY * (1 + len(lengths)) / len(b))
    basis = np.random.default_rng(decontamination.SEED).standard_normal((v, decontamination.RANK + decontamination.EXTRA)).astype(np.float32)
    for _ in range(decontamination.POWER + 1):
        q = np.linalg.qr(basis)[0]
        basis = gram @ q
    small = q.T @ basis
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    space = q @ vectors[:, np.argsort(values)[::-1][: decontamination.RANK]] * weight[:v, None]
    whole, got = space @ space.T, term[:v].astype(float) @ term[:v].T
    assert np.linalg.norm(got - whole) <= 0.01 * np.linalg.norm(whole), np.linalg.norm(got - whole) / np.linalg.norm(whole)
