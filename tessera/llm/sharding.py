"""Extendible hashing: shards of at most a given number of bytes, cut by hash-prefix bits.

A document's key is hashed to 60 bits. The directory starts at depth 0, one shard for everything; a
shard over the byte limit splits on its next hash bit, its siblings stay as they are. Rather than split
level by level with one job each, a round aggregates bytes per prefix ``STEP`` bits further down (the only
pass over the rows; partial sums before the shuffle), rolls these sums up to all depths in between and
takes for each cell the shallowest depth that fits. Only cells that still don't fit go into the next round.

Equal keys can't be told apart by any bit. Where such a group alone is over the limit, its rows go to
numbered overflow pages, from running sums over blocks of rows, so no task needs the whole group.

Defined results: null size or text counts 0 bytes; a null key is a key of its own; a row over the limit gets a
page of its own and ``oversize`` true (the one case in which a shard exceeds the limit); repeated rows are
kept; an empty table gives an empty result. ``max_bytes`` below 1 raises ValueError. Columns of the input
called as the added ones (see ADDED) give way to them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, packed

BITS, STEP, BLOCK_ROWS = 60, 12, 4096
ADDED = ("shard", "depth", "shard_bytes", "shard_rows", "oversize")


def key_hash(key: Column) -> Column:
    """60 bits of the key's md5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\x00null"))), 1, 15), 16, 10).cast("bigint")


def _bits(value: Column, depth: Column) -> Column:
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(value), depth, "0"))


def _round(sizes: DataFrame, top: int, low: int, max_bytes: int) -> DataFrame:
    """sizes: (_cell at depth low, _bytes, _rows). Each cell with the shallowest depth from top to low that fits, or null."""
    nodes = sizes.select("_cell", "_bytes", "_rows", F.explode(F.sequence(F.lit(top), F.lit(low))).alias("_depth")).withColumn("_node", F.expr(f"shiftright(_cell, {low} - _depth)"))
    fits = nodes.groupBy("_depth", "_node").agg(F.sum("_bytes").alias("_sum"), F.sum("_rows").alias("_count")).where(F.col("_sum") <= max_bytes)
    best = F.min(F.when(F.col("_sum").isNotNull(), F.struct("_depth", "_node", "_sum", "_count")))
    return nodes.join(fits, ["_depth", "_node"], "left").groupBy("_cell").agg(best.alias("_leaf"), F.first("_bytes").alias("_bytes"))


def directory(rows: DataFrame, max_bytes: int) -> list[tuple[int, DataFrame]]:
    """rows: (_hash, _size). For each round the cells' depth and a frame (_cell, _leaf); a null _leaf goes on below."""
    rounds, left = [], rows
    for low in range(STEP, BITS + 1, STEP):
        sizes = left.groupBy(F.expr(f"shiftright(_hash, {BITS - low})").alias("_cell")).agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
        top = 0 if low == STEP else low - STEP + 1
        cells = durable(_round(sizes, top, low, max_bytes))
        rounds.append((low, cells))
        over = cells.where(F.col("_leaf").isNull()).select("_cell")
        if over.isEmpty():
            break
        left = left.withColumn("_cell", F.expr(f"shiftright(_hash, {BITS - low})")).join(over, "_cell", "left_semi").select("_hash", "_size")
    return rounds


def _pages(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Overflow pages of rows whose whole hash is the same. Rows over half the limit stand alone; the others fill pages by where they start in a running sum cut at half the limit."""
    rows = durable(rows.withColumn("_id", F.monotonically_increasing_id()))
    alone = F.col("_size") * 2 > max_bytes
    small = rows.where(~alone).withColumn("_block", F.floor(F.col("_id") / BLOCK_ROWS))
    before = Window.partitionBy("_hash").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = small.groupBy("_hash", "_block").agg(F.sum("_size").alias("_b")).withColumn("_base", F.coalesce(F.sum("_b").over(before), F.lit(0))).drop("_b")
    inside = Window.partitionBy("_hash", "_block").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_base") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    paged = small.join(blocks, ["_hash", "_block"]).withColumn("_page", F.concat(F.lit("p"), F.floor(start / max(1, max_bytes // 2)).cast("string"))).drop("_block", "_base")
    return paged.unionByName(rows.where(alone).withColumn("_page", F.concat(F.lit("r"), F.col("_id").cast("string")))).drop("_id")


def shard(docs: DataFrame, max_bytes: int, key: str = "doc_id", size: Column | None = None) -> DataFrame:
    """docs with shard (its bits, and a page where equal keys overflow), depth, shard_bytes, shard_rows and oversize."""
    if max_bytes < 1:
        raise ValueError("max_bytes must be positive")
    size = F.octet_length("text") if size is None else size
    columns = [f"_doc.`{c}`" for c in docs.columns if c not in ADDED]
    rows = docs.select(packed(docs), key_hash(F.col(key)).alias("_hash"), F.coalesce(size.cast("bigint"), F.lit(0)).alias("_size"))
    big, fine = rows.where(F.col("_size") > max_bytes), rows.where(F.col("_size") <= max_bytes)
    rounds = directory(durable(fine.select("_hash", "_size")), max_bytes)
    parts, left = [], fine
    for low, cells in rounds:
        joined = left.withColumn("_cell", F.expr(f"shiftright(_hash, {BITS - low})")).join(cells.select("_cell", "_leaf"), "_cell")
        leaf = F.col("_leaf")
        parts.append(joined.where(leaf.isNotNull()).select(*columns, _bits(leaf["_node"], leaf["_depth"]).alias("shard"), leaf["_depth"].alias("depth"), leaf["_sum"].alias("shard_bytes"), leaf["_count"].alias("shard_rows"), F.lit(False).alias("oversize")))
        left = joined.where(leaf.isNull()).drop("_cell", "_leaf")
    deepest = rounds[-1][1]
    if rounds[-1][0] == BITS and not deepest.where(F.col("_leaf").isNull()).isEmpty():
        paged = durable(_pages(left, max_bytes))
        per = paged.groupBy("_hash", "_page").agg(F.sum("_size").alias("shard_bytes"), F.count("*").alias("shard_rows"))
        parts.append(paged.join(per, ["_hash", "_page"]).select(*columns, F.concat(_bits(F.col("_hash"), F.lit(BITS)), F.lit("+"), "_page").alias("shard"), F.lit(BITS).alias("depth"), "shard_bytes", "shard_rows", F.lit(False).alias("oversize")))
    lone = F.concat(_bits(F.col("_hash"), F.lit(BITS)), F.lit("+o"), F.monotonically_increasing_id().cast("string"))
    parts.append(big.select(*columns, lone.alias("shard"), F.lit(BITS).alias("depth"), F.col("_size").alias("shard_bytes"), F.lit(1).cast("bigint").alias("shard_rows"), F.lit(True).alias("oversize")))
    return reduce(DataFrame.unionByName, parts)


#: Bytes of text a shard of the query may hold.
OP1_MAX_BYTES = 1 << 20


def op1(docs: DataFrame) -> DataFrame:
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text").cast("bigint"), F.lit(0)).alias("n_bytes"))
    return shard(sized, OP1_MAX_BYTES, size=F.col("n_bytes"))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, COALESCE(strlen(text), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, chr(0) || 'null')), 1, 15))::BIGINT AS h FROM documents),
n AS (SELECT k.depth, d.h >> (60 - k.depth) AS node, sum(n_bytes)::BIGINT AS b, count(*) AS c
    FROM d, (SELECT unnest(range(0, 61))::INTEGER AS depth) k GROUP BY 1, 2 HAVING sum(n_bytes) <= {OP1_MAX_BYTES}),
f AS (SELECT d.doc_id, d.n_bytes, d.h, min(n.depth) AS depth FROM d JOIN n ON n.node = d.h >> (60 - n.depth) GROUP BY 1, 2, 3)
SELECT f.doc_id, f.n_bytes, CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(n.node), f.depth, '0') END AS shard, f.depth, n.b AS shard_bytes,
    n.c AS shard_rows, false AS oversize FROM f JOIN n ON n.depth = f.depth AND n.node = f.h >> (60 - f.depth)
"""
