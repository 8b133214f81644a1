"""Repeated passages: relative Lempel-Ziv parsing of every document against indexed blocks of smaller ids.

A passage counts from ``WINDOW`` words on. Reference blocks are cut by content: a window's anchor is the leftmost least hash among its
``GRAM``-word grams, and a block is a run of windows with one anchor (about one in twenty words begins a block). Equal passages are cut
alike, wherever they stand, but for their ends.

1. One pass gives each document its digest (documents of equal words form a class, judged once) and its blocks, with the hash of
   the anchor and of all the block's words. Anchors held by documents of one id only can't be shared and end here.
2. The index: each block's words with their smallest (id, position). A block that a smaller id has too is matched whole.
3. At factor boundaries passages agree in a part of a block only. Blocks that no smaller id has whole, under an anchor that
   others have too, are looked up window by window: the smallest (id, position) of each window is its reference. One block of
   each kind is enough for that, so a passage shared by a third of all documents is listed once, not once for each.
4. Each document is parsed greedily: a factor begins at a window with a smaller reference and goes on while the reference goes on
   there. Where a block or window has its reference elsewhere, a new factor begins, though it may overlap the one before. Every factor
   is at least ``WINDOW`` words; the words of all factors are removed.

References are the smallest (id, position), not the ones that go on longest, so a parse may have more factors than one of longest matches;
the words they cover are the same. Passages are compared by 96 bits of hash over word hashes of 64 bits, documents by SHA-256.

Defined results: null text has no words; texts under ``WINDOW`` words lose nothing; a null id is neither reference nor
removed; rows with the same id don't refer to each other, whatever their texts; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowwords import Runs, Words, chunks, joined_hash
from .common import stored, with_totals

WINDOW, GRAM = 50, 12
SEEDS = (0, 0x5851F42D4C957F2D)
NOTHING = hashlib.sha256(b"").hexdigest()
_BLOCK = pa.struct([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int32()), ("at", pa.int32()), ("len", pa.int32())])


def _least_places(x: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost least of every width values in a row, by doubling."""
    done, value, place = 1, x, np.arange(len(x), dtype=np.int64)
    while done < width:
        step = min(done, width - done)
        right = value[step:] < value[:-step]
        value = np.where(right, value[step:], value[:-step])
        place = np.where(right, place[step:], place[:-step])
        done += step
    return place


class Passages:
    """The windows of the texts of an Arrow array: starts (in all texts' words), their texts, and two hashes for any of them."""

    def __init__(self, texts: pa.Array):
        self.words = Words(texts)
        self.hashes, first = self.words.hashes(), self.words.first
        per = np.maximum(np.diff(first) - WINDOW + 1, 0)
        self.text = np.repeat(np.arange(len(per)), per)
        self.starts = np.arange(len(self.text)) + np.repeat(first[:-1] - (np.cumsum(per) - per), per)
        self._runs = [Runs(self.hashes, s) for s in SEEDS]

    def of(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(r.of(WINDOW)[starts] for r in self._runs) if len(starts) else (np.zeros(0, np.uint64),) * 2

    def blocks(self) -> tuple[np.ndarray, pa.Array]:
        """(text, block) in order."""
        if not len(self.starts):
            return np.zeros(0, np.int64), pa.array([], _BLOCK)
        grams = self._runs[0].of(GRAM)
        anchor = _least_places(grams, WINDOW - GRAM + 1)[self.starts]
        begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        size = np.diff(np.append(begin, len(anchor)))
        # the first and the last window overlap, so that both together are all words of the block
        h1, h2 = (joined_hash(joined_hash(a, b), size.astype(np.uint64)) for a, b in zip(self.of(self.starts[begin]), self.of(self.starts[begin + size - 1])))
        text = self.text[begin]
        columns = (grams[anchor[begin]].view(np.int64), h1.view(np.int64), halved(h2), (self.starts[begin] - self.words.first[text]).astype(np.int32), size.astype(np.int32))
        return text, pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(_BLOCK))


def halved(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _first_pass(batches):
    for b in chunks(batches):
        p = Passages(b.column("text"))
        w, (text, blocks) = p.words, p.blocks()
        ends = np.searchsorted(text, np.arange(b.num_rows + 1)).astype(np.int32)
        sha = [hashlib.sha256(w.joined(i)).hexdigest() for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("t"), pa.array(np.diff(w.first).astype(np.int64)), pa.array(sha, pa.string()), pa.ListArray.from_arrays(pa.array(ends), blocks)], ["id", "t", "n", "sha", "blocks"])


def _windows(batches):
    """(h1, h2, id, t, at) of the windows of the blocks in open."""
    for b in chunks(batches):
        p, spots, rows = Passages(b.column("text")), [], []
        for i, own in enumerate(b.column("open")):
            at, size = (own.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "len"))
            spots.append(_spread(at, size))
            rows.append(np.full(len(spots[-1]), i))
        at, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (spots, rows))
        h1, h2 = p.of(at + p.words.first[row])
        yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(halved(h2)), b.column("id").take(pa.array(row)), b.column("t").take(pa.array(row)), pa.array(at.astype(np.int32))], ["h1", "h2", "id", "t", "at"])


def _spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at, at + 1, ... size numbers for each."""
    return np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())


def factors(at: np.ndarray, ref: np.ndarray, ref_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (in words) of the greedy factors over windows at ``at`` (sorted) with their references."""
    goes_on = (at[1:] == at[:-1] + 1) & (ref[1:] == ref[:-1]) & (ref_at[1:] == ref_at[:-1] + 1)
    first = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(at) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:] - 1, [len(at) - 1]]) if len(at) else first
    return at[first], at[last] + WINDOW


def _cut(with_text: bool):
    def cut(batches):
        for b in chunks(batches):
            w = Words(b.column("text"))
            out = []
            for i, (s, e) in enumerate(zip(w.first[:-1], w.first[1:])):
                x = b.column("found")[i].values
                at, size, ref, ref_at = (x.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "len", "ref", "ref_at"))
                # repeated rows of an id list their windows again
                spots, once = np.unique(_spread(at, size), return_index=True)
                starts, ends = factors(spots, np.repeat(ref, size)[once], _spread(ref_at, size)[once])
                edge = np.zeros(e - s + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, ends, -1)
                keep = np.cumsum(edge)[: e - s] == 0
                text = w.joined(i, keep)
                out.append((int(e - s), int((~keep).sum()), hashlib.sha256(text).hexdigest(), len(starts), text.decode() if with_text else None))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors", "kept_text"])

    return cut


def _open_windows(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, t, at, ref) of the windows of blocks, which no smaller id has whole, with their references."""
    shared = with_totals(blocks, ["key"], ["id", "at"], _h=("min", "h1"), _g=("max", "h1"), _lo=("min", "id"), _hi=("max", "id"))
    open_ = shared.where("_h < _g AND _lo < _hi").groupBy("id", "t").agg(F.collect_set(F.struct("at", "len")).alias("open"))
    windows = rows.repartition("id", "t").join(open_, ["id", "t"]).select("id", "t", "text", "open").mapInArrow(_windows, "h1 bigint, h2 int, id bigint, t bigint, at int")
    # nearly all of these are in one document only: shuffled once, they are counted and met where they lie
    dealt = windows.repartition("h1", "h2")
    shared = dealt.groupBy("h1", "h2").agg(F.min(F.struct("id", "at")).alias("ref"), F.max("id").alias("_hi")).where("ref.id < _hi").drop("_hi")
    return dealt.join(shared, ["h1", "h2"]).where("ref.id < id").select("id", "t", "at", F.lit(1).alias("len"), "ref")


def remove_repeats(docs: DataFrame, key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_removed, kept_sha256, n_factors, kept_text (null unless asked for)."""
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.xxhash64("text").alias("t"), "text")
    slim = stored(rows.mapInArrow(_first_pass, "id bigint, t bigint, n bigint, sha string, blocks array<struct<key:bigint,h1:bigint,h2:int,at:int,len:int>>"))
    # the least id of a class stands for it; of null ids nothing is said
    long = slim.where(F.col("id").isNotNull() & (F.col("n") >= WINDOW)).withColumn("d", F.xxhash64("sha"))
    copies = stored(with_totals(long.select("id", "t", "sha"), ["sha"], ["id", "t"], least=("min", "id")).where("least < id").select("id", "t").distinct())
    # anchors that different documents hold
    own = long.join(copies, ["id", "t"], "left_anti")
    held = own.select("d", F.explode(F.array_distinct("blocks.key")).alias("key")).groupBy("key").agg(F.min("d").alias("_lo"), F.max("d").alias("_hi"))
    blocks = own.select("id", "t", F.inline("blocks")).join(held.where("_lo < _hi").select("key"), "key", "left_semi")
    met = stored(with_totals(blocks, ["h1", "h2"], ["id", "at"], ref=("min", "struct(id, at)")))
    later = met.where("ref.id < id").select("id", "t", "at", "len", "ref").unionByName(_open_windows(rows, met.where("ref.id = id").drop("ref")))
    entry = F.struct("at", "len", F.col("ref.id").alias("ref"), F.col("ref.at").alias("ref_at"))
    # not written: in one plan with the cut, texts are shuffled once for both
    found = later.groupBy("id", "t").agg(F.collect_list(entry).alias("found"))
    cut = rows.repartition("id", "t").join(found, ["id", "t"]).select("id", "text", "found").mapInArrow(_cut(with_text), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, n_factors bigint, kept_text string")
    told = found.select("id", "t", F.lit("cut").alias("as")).unionByName(copies.select("id", "t", F.lit("copy").alias("as")))
    rest = slim.select("id", "t", "n", "sha").join(told, ["id", "t"], "left").where("as IS NULL OR as = 'copy'").withColumn("_all", F.col("as").isNotNull())
    rest = rest.select(F.col("id").alias("doc_id"), F.col("n").alias("n_words"), F.when(F.col("_all"), F.col("n")).otherwise(F.lit(0).cast("bigint")).alias("n_removed"), F.when(F.col("_all"), NOTHING).otherwise(F.col("sha")).alias("kept_sha256"), F.col("_all").cast("bigint").alias("n_factors"), F.lit(None).cast("string").alias("kept_text"))
    return cut.unionByName(rest)


def op8(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", "n_factors")
