"""Near-duplicate documents: MinHash signatures under a multi-index Hamming join, links confirmed on whole shingle sets.

1. Every whole text gives its set of 5-word shingles (64-bit hashes), a signature of ``POSITIONS`` minima of
   16 bits each, and a digest of the set. Equal sets form a class; only its smallest id goes on.
2. The signature is split into ``CHUNKS`` chunks of ``LANES`` positions. Two signatures that differ in at most ``2 * CHUNKS - 1`` positions
   have by pigeonhole a chunk with at most one error; the errors allowed in a chunk are enumerated by leaving out
   each position in turn, so such a pair has an equal key. No pair under that distance is missed. At the linking
   threshold of 0.85 a pair lies over the distance with probability under 2e-8, at 0.8 under 6e-6, and less above it.
3. Pairs of a bucket aren't all listed. Each member first meets the bucket's smallest id; confirmed links give components. Then only
   pairs that share a bucket, lie within the distance and are still in different components come into question; two exact bounds, the
   difference of their distances from the bucket's hub and the bits in which their odd sketches differ, rule out all but the few near
   the threshold before any is listed, and these are confirmed.
   A link left out joins two documents already joined, so components are those of all links.
4. Confirming compares whole sets: 100 * intersection >= 85 * union.

Classes are told apart by a number of their own, never by an id, so rows of one id with different texts are judged by their own texts.

Defined results: null, empty or blank texts have no shingles and link with nothing; with fewer than five words the whole
sequence is the one shingle; every row is a document of its own, repeated ids included (a row is kept if its id is its component's); a null id
links with nothing, its component null, but where near-duplicates are dropped null ids link as any other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowwords import Runs, Words, chunks, mixed
from .common import packed, stored, with_totals
from .components import components, joined_components

SHINGLE, POSITIONS, LANES = 5, 48, 4
CHUNKS = POSITIONS // LANES
DISTANCE = 2 * CHUNKS - 1
LINK, OF = 85, 100
ODD_BITS = 2048
#: Members of a bucket that a task compares with the bucket's others at a time.
AT_ONCE = 4096
_rng = np.random.default_rng(6)
_MULT = (_rng.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_PLUS = _rng.integers(1, 1 << 63, POSITIONS, dtype=np.uint64)
_ROWS = 256  # shingles hashed at a time: the block of POSITIONS columns stays in cache


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    w = Words(texts, lower=True)
    runs = Runs(w.hashes())
    whole = {k: mixed(runs.of(k) + np.uint64(k)) for k in range(1, SHINGLE + 1)}
    out = []
    for a, b in zip(w.first[:-1], w.first[1:]):
        k = min(SHINGLE, b - a)
        out.append(np.unique(whole[k][a : b - k + 1]) if k else np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """CHUNKS longs of four 16-bit minima."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), _ROWS):
        np.minimum(least, (s[i : i + _ROWS, None] * _MULT + _PLUS).min(axis=0), out=least)
    bits = (mixed(least) & np.uint64(0xFFFF)).reshape(CHUNKS, LANES)
    return (bits << (np.arange(LANES, dtype=np.uint64) * np.uint64(16))).sum(axis=1, dtype=np.uint64).view(np.int64)


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """A bit for each of ODD_BITS cells: whether an odd number of the set's hashes fall there.

    Two sketches differ in at most as many bits as the sets have elements not in common, as each of these flips one bit.
    """
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % ODD_BITS, minlength=ODD_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(batches):
    for b in chunks(batches):
        sets = shingle_sets(b.column("text"))
        sigs = np.concatenate([signature(s) for s in sets]) if sets else np.zeros(0, np.int64)
        n = np.array([len(s) for s in sets], np.int64)
        digest = [np.array([mixed(s ^ np.uint64(x)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64) for x in (1, 2)]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * CHUNKS), pa.array(sigs))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("t"), pa.array(n), pa.array(digest[0]), pa.array(digest[1]), lists], ["id", "t", "n", "d1", "d2", "sig"])


def _set_rows(batches):
    for b in chunks(batches):
        sets = shingle_sets(b.column("text"))
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        odd = np.concatenate([odd_sketch(s) for s in sets]) if sets else np.zeros(0, np.int64)
        odds = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (ODD_BITS // 64)), pa.array(odd))
        yield pa.RecordBatch.from_arrays([b.column("r"), pa.ListArray.from_arrays(pa.array(at), pa.array(values)), odds], ["r", "shingles", "odd"])


def _rows(docs: DataFrame, key: str) -> list[Column]:
    """id, and t: what tells rows of one id apart by their text."""
    return [F.col(key).cast("bigint").alias("id"), F.xxhash64("text").alias("t")]


def signatures(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(id, t, n, d1, d2, sig) of every row of docs."""
    return docs.select(*_rows(docs, key), "text").mapInArrow(_signed, "id bigint, t bigint, n bigint, d1 bigint, d2 bigint, sig array<bigint>")


def _lane(lane: int) -> str:
    """The bits of one position in a chunk, as a literal."""
    return f"{int(np.uint64(0xFFFF << (16 * lane)).view(np.int64))}L"


def _differ(x: str) -> str:
    """How many positions of a chunk differ, from the exclusive or of two chunks."""
    return " + ".join(f"CAST(({x} & {_lane(k)}) <> 0L AS INT)" for k in range(LANES))


def _keys(reps: DataFrame) -> DataFrame:
    """(key, place, r, n) for each chunk of a signature and each position left out of it. place is chunk * LANES + position."""
    left_out = ((c, k) for c in range(CHUNKS) for k in range(LANES))
    keys = (f"named_struct('key', xxhash64({c * LANES + k}, sig[{c}] & ~({_lane(k)})), 'place', {c * LANES + k})" for c, k in left_out)
    return reps.select("r", "n", F.expr(f"inline(array({', '.join(keys)}))"))


def distance(a: str, b: str) -> Column:
    """Positions in which two signatures differ."""
    return F.expr(" + ".join(_differ(f"({a}[{c}] ^ {b}[{c}])") for c in range(CHUNKS)))


def first_place(a: str, b: str) -> Column:
    """The first place whose key two signatures share: each pair is listed in that bucket alone. In lambdas, as unrolled it outgrows a method."""
    lane = "".join(f" WHEN (x & {_lane(k)}) <> 0L THEN {k}" for k in range(1, LANES))
    chunks_ = f"transform(zip_with({a}, {b}, (x, y) -> x ^ y), (x, i) -> IF({_differ('x')} <= 1, i * {LANES} + CASE{lane} ELSE 0 END, NULL))"
    return F.expr(f"array_min({chunks_})")


def _close(n: Column, m: Column, link: int) -> Column:
    """Set sizes that a link allows."""
    return F.least(n, m) * OF >= F.greatest(n, m) * link


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (u, v) with the sizes of both whole sets' intersection and union."""
    a, b = sets.select(F.col("r").alias("u"), F.col("shingles").alias("_a")), sets.select(F.col("r").alias("v"), F.col("shingles").alias("_b"))
    met = pairs.join(a, "u").join(b, "v").withColumn("both", F.size(F.array_intersect("_a", "_b")))
    return met.select("u", "v", "both", (F.size("_a") + F.size("_b") - F.col("both")).alias("either"))


def _later_links(shared: DataFrame, stars: DataFrame, label: DataFrame, reps: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """Links (u, v) between members of a bucket that the hubs' links have left in different components."""
    at = shared.join(label, F.col("r") == F.col("node"), "left").select("key", "place", "r", "n", "hub", F.coalesce("component", "r").alias("c"))
    split = at.groupBy("key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.count("*").alias("_m")).where("_lo < _hi").select("key", F.ceil(F.col("_m") / AT_ONCE).cast("int").alias("parts"))
    far = stars.select(F.col("u").alias("r"), F.col("v").alias("hub"), (1 - F.col("both") / F.col("either")).alias("far"))
    # what meets in a bucket across components, with its distance from the hub and its signature
    rows = stored(at.join(split, "key").where(F.col("r") != F.col("hub")).join(far, ["r", "hub"]).join(reps.select("r", "sig"), "r").join(sets.select("r", "odd"), "r"))
    # a bucket of many members is met in parts: one side's members are dealt over them, the other's go to each
    a = rows.withColumn("part", F.pmod(F.xxhash64("r"), F.col("parts")).cast("int")).alias("a")
    b = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    # Jaccard distance is a metric: two sets can't be closer than the difference of their distances from a third
    near_enough = F.abs(F.col("a.far") - F.col("b.far")) <= (OF - link) / OF + 1e-9
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.part") == F.col("b.part"))
    apart = same & (F.col("a.r") > F.col("b.r")) & (F.col("a.c") != F.col("b.c")) & near_enough & _close(F.col("a.n"), F.col("b.n"), link)
    differ = F.expr("aggregate(zip_with(a.odd, b.odd, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)")
    # a link leaves at most this many elements not in common, and no fewer than the sketches' bits differ
    alike = differ * (OF + link) <= (F.col("a.n") + F.col("b.n")) * (OF - link)
    rest = a.join(b, apart & (distance("a.sig", "b.sig") <= DISTANCE) & alike & (first_place("a.sig", "b.sig") == F.col("a.place"))).select(F.col("a.r").alias("u"), F.col("b.r").alias("v"))
    return stored(compared(rest, sets).where(F.col("both") * OF >= F.col("either") * link).select("u", "v"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", link: int = LINK, null_ids: bool = False) -> DataFrame:
    """(id, t, n, c, component) of every row of docs. c numbers the component, component is its smallest id. c is null for rows that link with nothing: those without shingles and, unless null_ids, without an id."""
    slim = stored(signatures(docs, key))
    judged = (F.col("n") > 0) & (F.lit(null_ids) | F.col("id").isNotNull())
    some = slim.where(judged)
    # a class is met by one of its rows: that with the smallest (id, t)
    classes = some.groupBy("d1", "d2", "n").agg(F.min(F.struct(F.col("id").isNull(), "id", "t")).alias("row"), F.first("sig").alias("sig"))
    reps = stored(classes.select("d1", "d2", "n", "row.id", "row.t", "sig", F.monotonically_increasing_id().alias("r")))
    keys = _keys(reps)
    buckets = keys.groupBy("key").agg(F.min("r").alias("hub"), F.count("*").alias("members")).where("members > 1").select("key", "hub")
    shared = stored(keys.join(buckets, "key").select("key", "place", "r", "n", "hub"))
    met = reps.join(shared.select("r").distinct(), "r", "left_semi").select("r", "id", "t")
    texts = docs.select(*_rows(docs, key), "text").alias("d").join(met.alias("m"), F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.t") == F.col("m.t"))).select("r", "text")
    sets = stored(texts.mapInArrow(_set_rows, "r bigint, shingles array<bigint>, odd array<bigint>").dropDuplicates(["r"]))
    # every member against its bucket's hub; the distance to the hub is kept, linked or not
    stars = stored(compared(shared.where(F.col("r") != F.col("hub")).select(F.col("r").alias("u"), F.col("hub").alias("v")).distinct(), sets))
    label = components(stars.where(F.col("both") * OF >= F.col("either") * link).select("u", "v"))
    more = _later_links(shared, stars, label, reps, sets, link)
    if not more.isEmpty():
        label = joined_components(label, more)
    of_class = reps.join(label, F.col("r") == F.col("node"), "left").select("d1", "d2", "n", "id", F.coalesce("component", "r").alias("c"), "r")
    of_class = with_totals(of_class, ["c"], ["r"], component=("min", "id")).select("d1", "d2", "n", "c", "component")
    linked = some.join(of_class, ["d1", "d2", "n"]).select("id", "t", "n", "c", "component")
    return linked.unionByName(slim.where(~judged).select("id", "t", "n", F.lit(None).cast("bigint").alias("c"), F.col("id").alias("component")))


def op6(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, link: int = LINK) -> DataFrame:
    """One row of each component (that with the smallest id, nulls last, then text hash), columns as they were. Rows without shingles all stay."""
    found = stored(near_duplicates(docs, link=link, null_ids=True).where(F.col("c").isNotNull()).groupBy("c", "id", "t").agg(F.count("*").alias("copies")))
    told = with_totals(found, ["c"], ["id", "t"], first=("min", "struct(id IS NULL AS a, id, t)")).withColumn("stays", F.struct("id", "t").eqNullSafe(F.struct("first.id", "first.t")))
    verdicts = told.where("NOT stays OR copies > 1").select("id", "t", "stays")
    rows = docs.select(packed(docs), *_rows(docs, "doc_id")).alias("d")
    judged = rows.join(verdicts.alias("v"), F.col("d.id").eqNullSafe(F.col("v.id")) & (F.col("d.t") == F.col("v.t")), "left").select("_doc", "d.id", "d.t", "stays")
    # repeated rows of the one that stays are the only ones put together
    once = judged.where("stays").groupBy("id", "t").agg(F.first("_doc").alias("_doc"))
    return judged.where("stays IS NULL").select("_doc.*").union(once.select("_doc.*"))
