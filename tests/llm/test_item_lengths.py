"""Verbatim copies of very long and very short benchmark items."""

import random

from tessera.llm import decontamination


def test_items_of_any_length(spark):
    rng = random.Random(4)
    common = [f"c{i}" for i in range(8)]
    rare = [f"r{i}" for i in range(40_000)]
    filler = lambda n: rng.sample(rare, n)
    # of common words in a benchmark that also names every rare word around their copies
    short = {k: [rng.choice(common) for _ in range(k)] for k in (1, 2, 4, 6, 12, 20, 40)}
    long = {k: filler(k) for k in (100, 1500, 3000)}
    docs, items, truth, around = [], [], set(), []
    for k, words in (short | long).items():
        before, after = filler(61), filler(67)
        around += before + after
        docs.append((k, " ".join(before + words + after)))
        items.append((k, " ".join(words)))
        truth.add((k, k))
    items.append((9999, " ".join(around)))
    docs += [(10_000 + i, " ".join(common + filler(30))) for i in range(150)]
    docs, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.op7(docs, bench).collect()}
    assert truth <= got, sorted(truth - got)
