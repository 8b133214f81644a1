"""Benchmark decontamination by latent semantic retrieval, confirmed by common subsequences and answers.

1. Document frequencies of the benchmark's words are counted over all documents.
2. The passages of all documents and of the items, by TF-IDF, are A. A randomised SVD finds ``RANK`` latent directions: tasks multiply their
   passages into ``A'(A W)``, a bounded matrix each, which are added up by slices of its rows; after a few power rounds its orthonormal basis
   spans the space. A round reads all documents.
3. Each whole document is cut into passages of ``PASSAGE`` words, one every ``STRIDE``; a passage within ``LEAST_COSINE`` of an item in latent
   space is a candidate. Cosines are against the passage's whole length, words outside the benchmark included. Items of two passages or more
   are cut too, and any passage of theirs makes a candidate. Items that needn't hold a whole passage also meet shorter ones (``WINDOWS``), so that
   some passage over a copy has no foreign words.
4. A candidate counts if the longest common subsequence of item and passage surroundings holds ``LEAST_LCS`` of the item's words by IDF
   weight, and ``LEAST_ANSWER`` of its answer's words (the ``answer`` column, else the item's last fourth). Dropped,
   inserted or replaced words lower these shares but don't break the match as they break an n-gram.

Items are taken in blocks of ``ITEM_BLOCK``, so a task's model is bounded by the block, however long the benchmark is.

Defined results: null or empty documents and items match nothing; repeated rows give a row each; an empty benchmark or table gives an
empty result; items are told apart by item_id.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowwords import Words, chunks
from .common import durable, packed
from .licenses import BETWEEN

RANK, EXTRA, POWER = 256, 16, 1
STRIDE, BLOCKS = 16, 3
PASSAGE = STRIDE * BLOCKS
#: (stride, blocks) of document passages. One lies wholly in any run of stride * (blocks + 1) - 1 words, so none but the item's words are in it.
WINDOWS = ((STRIDE, BLOCKS), (8, 3), (4, 3), (1, 6), (1, 3), (1, 1))
LEAST_COSINE, LEAST_LCS, LEAST_ANSWER, ITEM_BLOCK = 0.25, 0.7, 0.5, 256
#: Energy of the items in the fit, as a multiple of the documents'; passages multiplied at a time.
ITEM_ENERGY, AT_ONCE = 4, 256
#: Sums made at a time; the most frequent words, whose cells of A are multiplied as whole blocks; passages of such a block.
SUMS, HEAD, DENSE = 256, 192, 512
#: Rows of a slice of the tasks' matrices; tasks of a round of the fit for each core, as each returns a matrix.
SLICE, TASKS = 256, 2
#: Passages whose vectors are held at a time.
SLAB = 8192
SEED = 7


class Items(NamedTuple):
    """A block of the benchmark."""

    ids: list[int]
    words: list[np.ndarray]  # hashes, in order
    answers: list[int]  # where the answer's words begin
    vocabulary: np.ndarray  # sorted hashes


def items_of(rows) -> Items:
    """rows: (item_id, text, answer or None)."""
    rows = sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0])
    texts = [r[1] if r[2] is None else f"{r[1]} {r[2]}" for r in rows]
    w = Words(pa.array(texts, pa.string()), lower=True, space=BETWEEN)
    h = w.hashes()
    own = [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
    tail = [len(Words(pa.array([r[2] or ""]), lower=True, space=BETWEEN).starts) or -(-len(x) // 4) for r, x in zip(rows, own)]
    keep = [i for i, x in enumerate(own) if len(x)]
    return Items([rows[i][0] for i in keep], [own[i] for i in keep], [len(own[i]) - tail[i] for i in keep], np.unique(h))


def _ids(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Each word's place in the vocabulary, or len(vocabulary)."""
    v, bits = len(vocabulary), (16 * len(vocabulary)).bit_length()
    if len(h) < 1 << bits:
        at = np.minimum(np.searchsorted(vocabulary, h), v - 1)
    else:
        # where the hashes with the same first bits begin; nearly always that's the place
        shift = np.uint64(64 - bits)
        count = np.bincount((vocabulary >> shift).astype(np.int64), minlength=1 << bits)
        at = np.minimum(np.cumsum(count) - count, v - 1)[(h >> shift).astype(np.int64)]
        late = np.flatnonzero(vocabulary[at] < h)
        at[late] = np.minimum(np.searchsorted(vocabulary, h[late]), v - 1)
    return np.where(vocabulary[at] == h, at, v)


class Texts:
    """The words of texts: their hashes and their places in the vocabulary."""

    def __init__(self, texts: pa.Array, vocabulary: np.ndarray):
        w = Words(texts, lower=True, space=BETWEEN)
        self.first, self.words = w.first, w.hashes()
        self.at = np.append(_ids(self.words, vocabulary), len(vocabulary) + 1)  # the last is past any text's end


class Passages:
    """The passages of each text: ``blocks`` blocks of ``stride`` words from each block on; shorter near a text's end."""

    def __init__(self, texts: Texts, stride: int = STRIDE, blocks: int = BLOCKS):
        self.first, self.words, self.at, self.stride, self.blocks = texts.first, texts.words, texts.at, stride, blocks
        n = np.diff(self.first)
        per = -(-n // stride)
        self.text = np.repeat(np.arange(len(n)), per)
        inner = np.arange(len(self.text)) - np.repeat(np.cumsum(per) - per, per)
        self.starts = self.first[self.text] + inner * stride
        #: How many blocks follow a block in its text.
        self.after = np.repeat(per, per) - 1 - inner

    def around(self, rows: np.ndarray, n: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From and to which word a match of n words, some in the passages rows, is looked for."""
        lo, hi = self.starts[rows] - n - STRIDE, self.starts[rows] + self.stride * self.blocks + n + STRIDE
        return np.maximum(lo, self.first[self.text[rows]]), np.minimum(hi, self.first[self.text[rows] + 1])

    def places(self, blocks: np.ndarray) -> np.ndarray:
        """Vocabulary places of the blocks' words, ``stride`` a row, filled up with a place past the vocabulary."""
        at = self.starts[blocks][:, None] + np.arange(self.stride)
        return self.at[np.where(at < self.first[self.text[blocks] + 1][:, None], at, len(self.words))]

    def over(self, x: np.ndarray, lo: int, rows: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
        """Sums over the passages that begin at rows (blocks after lo; all by default), as far as x has their blocks: x[at] are the rows' own, and what follows a row in its passage follows there."""
        rows = np.arange(len(x)) if rows is None else rows
        at = rows if at is None else at
        total, after = x[at], np.minimum(self.after[lo + rows], len(x) - 1 - at)
        for ahead in range(1, self.blocks):
            has = np.flatnonzero(after >= ahead)
            total[has] += x[at[has] + ahead]
        return total


def _frequencies(vocabulary: np.ndarray):
    def count(batches):
        for b in chunks(batches):
            w = Words(b.column("text"), lower=True, space=BETWEEN)
            at = _ids(w.hashes(), vocabulary)
            row = np.repeat(np.arange(b.num_rows), np.diff(w.first))
            known = at < len(vocabulary)
            cells = np.unique(row[known] * len(vocabulary) + at[known]) % len(vocabulary) if known.any() else np.zeros(0, np.int64)
            term, n = np.unique(cells, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(term, -1)), pa.array(np.append(n, b.num_rows).astype(np.int64))], ["term", "n"])

    return count


def idf(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Over all documents; its last place is for words outside the vocabulary: the vocabulary's median."""
    rows = docs.select("text").mapInArrow(_frequencies(vocabulary), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each word of the block
    n = {r.term: r.n for r in rows}
    total = n.pop(-1, 0)
    df = np.zeros(len(vocabulary))
    for t, c in n.items():
        df[t] = c
    out = np.log((1 + total) / (1 + df)) + 0.05
    return np.append(out, np.median(out)).astype(np.float32)


def _add(into: np.ndarray, row: np.ndarray, value: np.ndarray, source: np.ndarray, at: np.ndarray) -> None:
    """into[row] += value * source[at]; row is sorted."""
    first = np.flatnonzero(np.diff(row, prepend=-1))
    size = np.diff(np.append(first, len(row)))
    # rows of most cells first: the k-th cells of those that have as many are added at once
    order = np.argsort(-size, kind="stable")
    for lo in range(0, len(order), SUMS):
        own, less = first[order[lo : lo + SUMS]], -size[order[lo : lo + SUMS]]
        total = source[at[own]] * value[own, None]
        for k in range(1, -less[0]):
            cell = own[: np.searchsorted(less, -k)] + k
            part = source[at[cell]]
            part *= value[cell, None]
            total[: len(cell)] += part
        into[row[own]] += total


def _round(texts: pa.Array, basis: np.ndarray, weight: np.ndarray, vocabulary: np.ndarray, into: np.ndarray) -> int:
    """Adds A'(A basis) of the texts' passages (one every PASSAGE words, each of unit length) to into. Returns how many there were."""
    t, v = Texts(texts, vocabulary), len(vocabulary)
    n = np.diff(t.first)
    per = -(-n // PASSAGE)
    passage = np.repeat(np.cumsum(per) - per, n) + (np.arange(len(t.words)) - np.repeat(t.first[:-1], n)) // PASSAGE
    known = t.at[:-1] < v
    cells, count = np.unique(passage[known] * v + t.at[:-1][known], return_counts=True)
    passage, place = cells // v, cells % v
    value = count * weight[place].astype(float)
    value = (value / np.maximum(np.sqrt(np.bincount(passage, value**2))[passage], 1e-9)).astype(np.float32) if len(cells) else np.zeros(0, np.float32)
    # cells of frequent words as blocks of passages by words; the others one by one
    head = np.argsort(weight[:v], kind="stable")[:HEAD]
    column = np.full(v, -1)
    column[head] = np.arange(len(head))
    column = column[place]
    often, rest = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
    product, lead = np.zeros((int(per.sum()), basis.shape[1]), np.float32), basis[head]
    _add(product, passage[rest], value[rest], basis, place[rest])
    ends = np.searchsorted(passage[often], np.arange(0, len(product) + DENSE, DENSE))
    for k, lo in enumerate(range(0, len(product), DENSE)):
        few, own = often[ends[k] : ends[k + 1]], product[lo : lo + DENSE]
        block = np.zeros((len(own), len(head)), np.float32)
        block[passage[few] - lo, column[few]] = value[few]
        own += block @ lead
        into[head] += block.T @ own
    rest = rest[np.argsort(place[rest], kind="stable")]
    _add(into, place[rest], value[rest], product, passage[rest])
    return len(product)


def _sum(batches):
    """The sums of the tasks' slices, which come in order."""
    last, n, total = None, 0, None
    for b in batches:
        for slice_, own, m in zip(*(b.column(c).to_pylist() for c in ("slice", "n", "m"))):
            if slice_ != last:
                if last is not None:
                    yield _slice(last, n, total)
                last, n, total = slice_, 0, 0
            n, total = n + own, total + np.frombuffer(m, np.float32).astype(float)
    if last is not None:
        yield _slice(last, n, total)


def _slice(slice_: int, n: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([slice_], pa.int32()), pa.array([n], pa.int64()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["slice", "n", "m"])


def latent(docs: DataFrame, items: Items, texts: list[str], weight: np.ndarray) -> np.ndarray:
    """Orthonormal directions, a row for each word of the vocabulary."""
    v = len(items.vocabulary)
    rank = min(RANK + EXTRA, v)
    basis = np.random.default_rng(SEED).standard_normal((v, rank)).astype(np.float32)
    own = pa.array(texts, pa.string())
    vocabulary = items.vocabulary
    dealt = docs.select("text").coalesce(TASKS * docs.sparkSession.sparkContext.defaultParallelism)
    for _ in range(POWER + 1):
        q = np.linalg.qr(basis)[0].astype(np.float32)

        def part(batches, q=q):
            into, n = np.zeros((v, rank), np.float32), 0
            for b in chunks(batches):
                n += _round(b.column("text"), q, weight, vocabulary, into)
            for lo in range(0, v, SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([lo // SLICE], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n]), pa.array([into[lo : lo + SLICE].tobytes()], pa.binary())], ["slice", "part", "n", "m"])

        parts = dealt.mapInArrow(part, "slice int, part int, n bigint, m binary").repartition("slice").sortWithinPartitions("slice", "part")
        basis, n = np.zeros((v, rank), np.float32), 1
        for r in parts.mapInArrow(_sum, "slice int, n bigint, m binary").toLocalIterator():  # one matrix in all
            basis[r.slice * SLICE : (r.slice + 1) * SLICE] = np.frombuffer(r.m, np.float32).reshape(-1, rank)
            n = 1 + r.n
        mine = np.zeros((v, rank), np.float32)
        count = _round(own, q, weight, vocabulary, mine)
        basis += mine * (ITEM_ENERGY * n / max(1, count))
    # Rayleigh-Ritz: q'(A'A q) is small; its leading vectors give the leading directions
    small = q.T.astype(float) @ basis
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    lead = np.argsort(values)[::-1][: min(RANK, rank)]
    return (q @ vectors[:, lead]).astype(np.float32)


def common_subsequence(item: np.ndarray, near: np.ndarray, weight: np.ndarray, tail: int) -> tuple[float, float]:
    """The largest weight of a common subsequence, as a share of the item's, and the share of its places from tail on that such a subsequence holds."""
    n, m = len(item), len(near)
    # the way back needs a bit for each step up and left, not the weights: items of thousands of words fit
    above, up, left = np.zeros(m + 1), [b""], [b""]
    for i in range(1, n + 1):
        best = np.zeros(m + 1)
        hit = np.where(near == item[i - 1], above[:-1] + weight[i - 1], 0)
        best[1:] = np.maximum.accumulate(np.maximum(hit, above[1:]))
        up.append(np.packbits(best == above).tobytes())
        left.append(np.packbits(best[1:] == best[:-1]).tobytes())
        above = best
    i, j, kept = n, m, np.zeros(n, bool)
    while i and j:
        if up[i][j >> 3] >> (7 - (j & 7)) & 1:
            i -= 1
        elif left[i][(j - 1) >> 3] >> (7 - ((j - 1) & 7)) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            kept[i] = True
    return float(above[m] / weight.sum()), float(kept[tail:].mean())


class Group(NamedTuple):
    """Item passages that are held against document passages of one length."""

    stride: int
    blocks: int
    items: np.ndarray  # item indexes, a run of columns each
    first: np.ndarray  # where each item's columns begin
    column: np.ndarray  # unit vectors of the item passages, a row each
    score: np.ndarray | None  # each word's share in each column's scores; None where that would be wider than the vectors


def groups_of(items: Items, term: np.ndarray) -> list[Group]:
    """Whole items at PASSAGE words and, if shorter than what always holds a whole passage, at shorter WINDOWS; long items also cut into passages."""
    parts: dict = {x: {} for x in WINDOWS}
    for k, own in enumerate(items.words):
        n = len(own)
        cut = [*range(0, n - PASSAGE + 1, PASSAGE), n - PASSAGE] if n >= 2 * PASSAGE else []
        parts[WINDOWS[0]][k] = [(0, n), *((a, a + PASSAGE) for a in dict.fromkeys(cut))]
        if (fit := next(x for x in WINDOWS if x[0] * (x[1] + 1) - 1 <= n)) != WINDOWS[0]:
            parts[fit][k] = [(0, n)]
    out = []
    for (stride, blocks), own in parts.items():
        if own:
            places = {k: _ids(items.words[k], items.vocabulary) for k in own}
            column = np.stack([term[places[k][a:b]].sum(axis=0) for k, cut in own.items() for a, b in cut])
            column /= np.maximum(np.linalg.norm(column, axis=1, keepdims=True), 1e-9)
            first = np.cumsum([0, *(len(cut) for cut in own.values())])[:-1]
            out.append(Group(stride, blocks, np.array(list(own)), first, column, term @ column.T if len(column) <= term.shape[1] else None))
    return out


class Bound(NamedTuple):
    """For each item its rarest words, as few as weigh more than a match may miss: a text part with none of them can't match."""

    first: np.ndarray  # vocabulary place -> where its items begin
    items: np.ndarray

    @staticmethod
    def of(items: Items, weight: np.ndarray) -> Bound:
        word, item = [], []
        for k, own in enumerate(items.words):
            places, n = np.unique(_ids(own, items.vocabulary), return_counts=True)
            order = np.argsort(-weight[places], kind="stable")
            weighs = np.cumsum((weight[places] * n)[order])
            need = np.searchsorted(weighs, (1 - LEAST_LCS) * weighs[-1] * (1 + 1e-5)) + 1
            word.append(places[order[:need]])
            item.append(np.full(len(word[-1]), k))
        word, item = np.concatenate(word), np.concatenate(item)
        order = np.lexsort((item, word))
        return Bound(np.searchsorted(word[order], np.arange(len(items.vocabulary) + 3)), item[order])


class Met:
    """Where a batch of texts has the words of a bound."""

    def __init__(self, bound: Bound, texts: Texts):
        self.n = len(texts.at)
        count = np.diff(bound.first)[texts.at]
        at = np.flatnonzero(count)
        inner = np.arange(count[at].sum()) - np.repeat(np.cumsum(count[at]) - count[at], count[at])
        item = bound.items[np.repeat(bound.first[texts.at[at]], count[at]) + inner]
        self.cells = np.sort(item * self.n + np.repeat(at, count[at]))
        self.before = np.concatenate([[0], np.cumsum(count > 0)])

    def any(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether words lo to hi have a word of any item."""
        return self.before[hi] > self.before[lo]

    def of(self, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether words lo to hi have a word of that item."""
        return np.searchsorted(self.cells, item * self.n + hi) > np.searchsorted(self.cells, item * self.n + lo)


class Search(NamedTuple):
    items: Items
    weight: np.ndarray
    term: np.ndarray  # word vectors in latent space; the two last rows (other words, no word) are zero
    groups: list[Group]
    bound: Bound

    def candidates(self, texts: Texts, group: Group, met: Met):
        """(passages, rows, item indexes, cosines): the passages that some passage of an item comes near to, by slabs of rows."""
        p, v = Passages(texts, group.stride, group.blocks), len(self.items.vocabulary)
        widest = max(len(self.items.words[k]) for k in group.items)
        energy = np.append(self.weight**2, 0).astype(np.float32)
        by_word = self.term if group.score is None else group.score
        for lo in range(0, len(p.starts), SLAB):
            rows = np.arange(lo, min(lo + SLAB + group.blocks - 1, len(p.starts)))
            own = p.places(rows)
            square, part = p.over(energy[own].sum(axis=1), lo), p.over(np.where(own < v, energy[own], 0).sum(axis=1), lo)
            # passages whose known words can't reach the cosine need no vector: the latent part is at most the known part
            # nor do those around which no item of the group can have enough of its words
            able = (part >= LEAST_COSINE**2 * square) & met.any(*p.around(rows, widest))
            able[SLAB:] = False  # these begin the next slab
            needed = able.copy()
            for ahead in range(1, group.blocks):
                has = np.flatnonzero(able & (p.after[rows] >= ahead))
                needed[has + ahead] = True
            needed = np.flatnonzero(needed)
            sums = np.zeros((len(needed), by_word.shape[1]), np.float32)
            step = AT_ONCE * STRIDE // group.stride
            for at in range(0, len(needed), step):
                sums[at : at + step] = by_word[own[needed[at : at + step]]].sum(axis=1)
            able = np.flatnonzero(able)
            sums = p.over(sums, lo, able, np.searchsorted(needed, able))
            for at in range(0, len(able), step := AT_ONCE if group.score is None else SLAB):
                few = sums[at : at + step]
                cosine = few @ group.column.T if group.score is None else few
                if len(group.first) < cosine.shape[1]:
                    cosine = np.maximum.reduceat(cosine, group.first, axis=1)
                cosine = cosine / np.sqrt(np.maximum(square[able[at : at + step]], 1e-9))[:, None]
                a, k = np.nonzero(cosine >= LEAST_COSINE)
                yield p, lo + able[at + a], group.items[k], cosine[a, k]

    def find(self, texts: pa.Array) -> list[tuple]:
        """(text index, item index, cosine, share, answer share) of confirmed matches, the best for each pair."""
        read, found = Texts(texts, self.items.vocabulary), {}
        met = Met(self.bound, read)
        places = [_ids(own, self.items.vocabulary) for own in self.items.words]
        weights = [self.weight[x] for x in places]
        least = [LEAST_LCS * x.sum() for x in weights]
        there = np.zeros(len(self.items.vocabulary) + 2, bool)

        def confirm(text: int, k: int, near: list[tuple[int, int, float]]) -> None:
            """near: (from, to, cosine) in order. What fails in all their words together fails in each."""
            best = found.get((text, k), (0.0, 0.0, 0.0))
            if best[1] >= 0.999:
                return
            lo, hi = near[0][0], near[-1][1]
            # what the two share, order aside, bounds their common subsequence
            there[read.at[lo:hi]] = True
            shared = weights[k][there[places[k]]].sum()
            there[read.at[lo:hi]] = False
            if shared < least[k]:
                return
            share, answer = common_subsequence(self.items.words[k], read.words[lo:hi], weights[k], self.items.answers[k])
            if len(near) == 1:
                if share >= LEAST_LCS and answer >= LEAST_ANSWER:
                    found[text, k] = max(best, (near[0][2], share, answer), key=lambda x: (x[1], x[0]))
            elif share >= LEAST_LCS and share > best[1] - 1e-9:
                top = max(range(len(near)), key=lambda i: near[i][2])
                confirm(text, k, [near[top]])
                if found.get((text, k), best)[1:2] >= (share - 1e-9,) and found[text, k][0] >= near[top][2]:
                    return  # none has a larger share, nor a larger cosine
                for some in (near[: len(near) // 2], near[len(near) // 2 :]):
                    confirm(text, k, some)

        sizes = np.array([len(own) for own in self.items.words])
        for group in self.groups:
            for p, rows, ks, cosines in self.candidates(read, group, met):
                lo, hi = p.around(rows, sizes[ks])
                # by item and text, in order; near one another they are confirmed together if the item is long
                order = np.lexsort((rows, ks))
                order = order[met.of(ks[order], lo[order], hi[order])]
                near, last = [], None
                for text, k, a, b, cosine in zip(*(x[order].tolist() for x in (p.text[rows], ks, lo, hi, cosines))):
                    if near and (last != (text, k) or sizes[k] < 2 * PASSAGE or b - near[0][0] > 4 * (sizes[k] + STRIDE)):
                        confirm(*last, near)
                        near = []
                    near.append((a, b, cosine))
                    last = text, k
                if near:
                    confirm(*last, near)
        return [(t, k, *x) for (t, k), x in found.items()]


KIND = "doc_id bigint, item_id bigint, cosine double, common double, answer double"


def _block(docs: DataFrame, rows: list) -> DataFrame:
    items = items_of(rows)
    weight = idf(docs, items.vocabulary)
    texts = [r[1] if r[2] is None else f"{r[1]} {r[2]}" for r in rows if r[1]]
    basis = latent(docs, items, texts, weight)
    term = np.concatenate([basis * weight[:-1, None], np.zeros((2, basis.shape[1]), np.float32)])
    search = Search(items, weight, term, groups_of(items, term), Bound.of(items, weight))

    def find(batches):
        for b in chunks(batches):
            found = search.find(b.column("text"))
            ids = b.column("doc_id").to_pylist()
            columns = ([ids[f[0]] for f in found], [search.items.ids[f[1]] for f in found], *([f[i] for f in found] for i in (2, 3, 4)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], ["doc_id", "item_id", "cosine", "common", "answer"])

    return docs.mapInArrow(find, KIND)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, common, answer) of every match. benchmark: item_id, text and perhaps answer."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    listed = durable(benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text", answer.alias("answer")).where("item_id IS NOT NULL AND text IS NOT NULL"))
    parts, block = [], []
    for r in listed.orderBy("item_id").toLocalIterator():
        if any(c.isalnum() for c in r.text):
            block.append((r.item_id, r.text, r.answer))
        if len(block) == ITEM_BLOCK:
            parts.append(_block(docs, block))
            block = []
    if block:
        parts.append(_block(docs, block))
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], KIND)


def op7(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a match, columns as they were."""
    gone = contaminated(docs, benchmark).select(F.col("doc_id").alias("id")).distinct()
    return docs.select(packed(docs), F.col("doc_id").cast("bigint").alias("id")).join(gone, "id", "left_anti").select("_doc.*")
