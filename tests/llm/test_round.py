"""A round of op7's fit against sums cell by cell, and the places of words."""

import time

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontamination
from tessera.llm.decontamination import PASSAGE, SLICE


def plain(texts, basis, weight, vocabulary):
    """The same sums over all cells by grouped additions, 1,024 cells at a time."""
    t, v = decontamination.Texts(texts, vocabulary), len(vocabulary)
    at, passage, n = t.at[:-1], [], 0
    for size in np.diff(t.first):
        passage.append(n + np.arange(size) // PASSAGE)
        n += -(-size // PASSAGE)
    passage = np.concatenate(passage)
    cells, count = np.unique(passage[at < v] * v + at[at < v], return_counts=True)
    passage, place = cells // v, cells % v
    value = count * weight[place].astype(float)
    value = (value / np.sqrt(np.bincount(passage, value**2, n)[passage])).astype(np.float32)
    product, into = np.zeros((n, basis.shape[1]), np.float32), np.zeros((v, basis.shape[1]), np.float32)
    order = np.argsort(place, kind="stable")
    for target, row, x, source, of in ((product, passage, value, basis, place), (into, place[order], value[order], product, passage[order])):
        for lo in range(0, len(row), 1024):
            own = row[lo : lo + 1024]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            target[own[first]] += np.add.reduceat(x[lo : lo + 1024, None] * source[of[lo : lo + 1024]], first, axis=0)
    return into, n


def corpus(words: int, texts: int, known: int, seed: int):
    """Words as frequent as in prose, of which every other is known until there are as many."""
    rng = np.random.default_rng(seed)
    own = [" ".join(f"w{x}" for x in np.minimum(rng.zipf(1.15, rng.integers(1, 2 * words // texts)), 10**7)) for _ in range(texts)]
    vocabulary = decontamination.items_of([(0, " ".join(f"w{2 * i + 1}" for i in range(known)), None)]).vocabulary
    weight = decontamination.Texts(pa.array(own), vocabulary).at[:-1]
    weight = np.log((1 + words) / (1 + np.bincount(weight, minlength=known + 1))).astype(np.float32)
    basis = np.linalg.qr(rng.standard_normal((known, min(known, 272))).astype(np.float32))[0].astype(np.float32)
    return own, vocabulary, weight, basis


@pytest.mark.parametrize("known", [1, 40, 192, 193, SLICE * 4])
@pytest.mark.parametrize("texts", [1, 30])
def test_round_sums_every_cell(known, texts):
    own, vocabulary, weight, basis = corpus(30_000, texts, known, known)
    for some in ([*own, None, "", "."], [" ".join(["w1"] * 70_000)], [None], []):
        some = pa.array(some, pa.string())
        into = np.zeros((known, basis.shape[1]), np.float32)
        n = decontamination._round(some, basis, weight, vocabulary, into)
        if decontamination.Texts(some, vocabulary).first[-1] == 0:
            assert (n, into.any()) == (0, False)
            continue
        want, count = plain(some, basis, weight, vocabulary)
        assert n == count
        assert np.allclose(into, want, rtol=1e-4, atol=1e-5 * np.abs(want).max())


def test_round_takes_less_time_than_grouped_additions():
    own, vocabulary, weight, basis = corpus(150_000, 600, 4000, 3)
    texts = pa.array(own)

    def spent(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    into = np.zeros((len(vocabulary), basis.shape[1]), np.float32)
    pairs = [(spent(lambda: decontamination._round(texts, basis, weight, vocabulary, into)), spent(lambda: plain(texts, basis, weight, vocabulary))) for _ in range(5)]
    assert min(a for a, _ in pairs) < 0.8 * min(b for _, b in pairs), pairs


@pytest.mark.parametrize("known", [1, 3, 1000])
def test_places_of_many_words(known):
    rng = np.random.default_rng(known)
    vocabulary = np.unique(np.concatenate([rng.integers(0, 2**64, known, np.uint64), np.array([0, 1, 2, 2**64 - 1], np.uint64)[:known]]))
    near = np.concatenate([vocabulary, vocabulary + np.uint64(1), vocabulary - np.uint64(1)])
    h = np.concatenate([rng.choice(near, 60_000), rng.integers(0, 2**64, 60_000, np.uint64)])
    place = {x: i for i, x in enumerate(vocabulary.tolist())}
    want = [place.get(x, len(vocabulary)) for x in h.tolist()]
    assert decontamination._ids(h, vocabulary).tolist() == want
    assert decontamination._ids(h[:5], vocabulary).tolist() == want[:5]
