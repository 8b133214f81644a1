"""Mixing sources to target weights with Pareto order sampling.

Sources get integer weights by their rank in code-point order; targets share the total size by weight, none
above ``cap`` times its source's size (the excess goes to the others by weight: a water level over the table of
sources). A document first gets the certain whole copies ``floor(target / source size)``. The fraction left is a sample of unequal
probabilities: a document's inclusion odds go with its preference (in the query the binary digits of its size, so that long documents are
likelier than short ones, though less than in proportion), scaled so that the expected words are the rest of the target; those whose scaled
probability would reach one are certain. Each other document draws random odds from its key; divided by its inclusion odds these are its Pareto rank, and
the lowest ranks whose sizes come nearest to the rest are taken once more.

Rank order within a source isn't sorted as a whole: ranks fall into ``BUCKETS`` slices, slice sizes are summed
(partial sums first), and only the one slice in which the target ends is put in order. Tables of a row for each source, and for each source and preference, are
put in order in windows; texts and documents aren't.

Defined results: null text or source is size 0 or a source of its own, ordered last; a source of size 0 has target 0;
equal keys tie in rank and are ordered by size; repeated rows each count; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, stored, unit, words

WEIGHTS, CAP, BUCKETS, SEED = (5, 2, 1), 3, 4096, "mix:"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes: (source, source_size), a row for each source. Adds weight, target, copies and rest (words of the fraction)."""
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int"))
    ranked = sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", weight)
    total, earlier = F.sum("source_size").over(whole), level.rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("source_size").over(earlier), F.lit(0)) * cap
    heavy = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    filled = ranked.withColumn("_level", (total - used).cast("double") / heavy).withColumn("_capped", F.col("weight") * F.col("_level") > F.col("source_size") * cap)
    water = F.min(F.when(~F.col("_capped"), F.struct("_order", "_level"))).over(whole)["_level"]
    filled = filled.withColumn("_order", F.row_number().over(level))
    target = F.when(F.col("_capped"), (F.col("source_size") * cap).cast("double")).otherwise(F.col("weight") * water)
    target = F.least(target, (F.col("source_size") * cap).cast("double"))
    out = filled.withColumn("target", target)
    out = out.withColumn("copies", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.when(F.col("source_size") != 0, F.col("source_size")))).cast("bigint"))
    return out.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")).select("source", "source_size", "weight", "target", "copies", "rest")


def inclusion(sizes: DataFrame) -> DataFrame:
    """sizes: (source, rest, preference, size), a row for each source and preference. Adds odds: the probability that a document is taken once more.

    The largest preferences are certain (1.0) as long as the scale that the others need lifts theirs to one.
    """
    down = Window.partitionBy("source").orderBy(F.col("preference").desc())
    before, after = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("rest") - F.coalesce(F.sum("size").over(before), F.lit(0))
    out = sizes.withColumn("_scale", left / F.nullif(F.sum(F.col("preference") * F.col("size")).over(after), F.lit(0))).withColumn("_sure", F.col("preference") * F.col("_scale") >= 1)
    first = F.max(F.when(~F.col("_sure"), F.struct("preference", "_scale"))).over(Window.partitionBy("source"))["_scale"]
    return out.withColumn("_first", first).select("source", "preference", F.when(F.col("_sure"), 1.0).otherwise(F.coalesce(F.col("preference") * F.col("_first"), F.lit(0.0))).alias("odds"))


def mix(sized: DataFrame, key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, preference: str = "1", figures: DataFrame | None = None) -> DataFrame:
    """sized: key, source, size (long) and any other columns. Adds source_size, target, copies (times the mix takes the row) and inclusion (its probability of the last one).

    preference is SQL over key, source and size that gives a positive whole number; by default all documents are alike. Reruns agree, as random odds come from the key alone.
    Sizes are summed several times, over figures: the key, source and size of the same rows, a durable frame. Without it sized should be one.
    """
    figures = sized if figures is None else figures
    goal = targets(figures.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    kinds = figures.withColumn("preference", F.expr(preference).cast("bigint")).groupBy("source", "preference").agg(F.sum("size").alias("size"))
    same = F.col("k.source").eqNullSafe(F.col("g.source"))
    odds = inclusion(kinds.alias("k").join(goal.alias("g"), same).select("k.source", "rest", "preference", "size"))
    goal = stored(odds.alias("k").join(goal.alias("g"), same).select("g.*", "preference", "odds"))
    rank = (F.col("_u") / (1 - F.col("_u"))) / (F.nullif("odds", F.lit(0.0)) / (1 - F.col("odds")))

    def ranked(rows: DataFrame) -> DataFrame:
        out = rows.withColumns({"_u": unit(F.col(key), SEED), "_preference": F.expr(preference).cast("bigint")}).alias("a")
        out = out.join(goal.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a._preference") == F.col("b.preference"))).drop(F.col("b.source"))
        # rank / (1 + rank) keeps the order and lies in [0, 1), so that equal slices of it are even enough; the certain are a slice of their own
        out = out.withColumn("_rank", F.when(F.col("odds") < 1, F.coalesce(rank / (1 + rank), F.lit(1.0))))
        return out.withColumn("_slice", F.when(F.col("odds") < 1, F.least(F.floor(F.col("_rank") * BUCKETS), F.lit(BUCKETS - 1)).cast("int")).otherwise(-1))

    rows = ranked(sized)
    running = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = ranked(figures).groupBy("source", "_slice").agg(F.sum("size").alias("_in"), F.first("rest").alias("_rest")).withColumn("_before", F.coalesce(F.sum("_in").over(running), F.lit(0)))
    ends = slices.where((F.col("_slice") >= 0) & (F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_in") > F.col("_rest"))).select(F.col("source").alias("_source"), F.col("_slice").alias("_end"), "_before")
    rows = rows.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    at_end = F.coalesce(F.col("_slice") == F.col("_end"), F.lit(False))
    # without an end every slice lies below the rest
    sure = rows.where(~at_end).withColumn("_more", F.coalesce(F.col("_slice") < F.col("_end"), F.col("rest") > 0))
    inner = Window.partitionBy("source").orderBy("_rank", "size", key).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    edge = rows.where(at_end).withColumn("_more", 2 * start + F.col("size") <= 2 * F.col("rest"))
    out = sure.unionByName(edge)
    return out.select(*sized.columns, "source_size", "target", (F.col("copies") + F.col("_more").cast("bigint")).alias("copies"), F.col("odds").alias("inclusion"))


#: Of the query and the stage: binary digits of the size.
PREFERENCE = "length(bin(size))"


def op2(docs: DataFrame) -> DataFrame:
    sized = stored(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size")))
    return mix(sized, preference=PREFERENCE).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "inclusion", "source")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Texts stay where they are: only the slice in which a target ends is shuffled.

    Words are counted once, for the sums; the pass over the texts counts those of that slice alone.
    """
    size = F.size(words(F.col("text"))).cast("bigint").alias("size")
    taken = mix(docs.select(packed(docs), "doc_id", "source", size), preference=PREFERENCE, figures=stored(docs.select("doc_id", "source", size))).where(F.col("copies") > 0)
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_doc.*")


OP2_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('{SEED}' || doc_id::VARCHAR), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
s1 AS (SELECT *, ([5, 2, 1])[((place - 1) % 3 + 1)::INTEGER] AS weight FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () - {CAP} * COALESCE(sum(source_size) OVER e, 0))::DOUBLE / (sum(weight) OVER () - COALESCE(sum(weight) OVER e, 0))::DOUBLE AS lvl,
    row_number() OVER (ORDER BY source_size::DOUBLE / weight, place) AS o FROM s1
    WINDOW e AS (ORDER BY source_size::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, weight * lvl > {CAP} * source_size AS capped FROM s2),
s4 AS (SELECT *, least({CAP} * source_size::DOUBLE, CASE WHEN capped THEN {CAP} * source_size::DOUBLE
    ELSE weight * (SELECT arg_min(lvl, o) FROM s3 WHERE NOT capped) END) AS target FROM s3),
s5 AS (SELECT source, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS copies FROM s4),
s6 AS (SELECT *, target - copies * source_size AS rest FROM s5),
k AS (SELECT d.source, any_value(rest) AS rest, length(bin(d.size)) AS p, sum(d.size)::BIGINT AS s FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source GROUP BY d.source, p),
k1 AS (SELECT *, (rest - COALESCE(sum(s) OVER (PARTITION BY source ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / NULLIF(sum(p * s) OVER (PARTITION BY source ORDER BY p DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS scale FROM k),
k2 AS (SELECT source, p, CASE WHEN p * scale >= 1 THEN 1.0::DOUBLE ELSE COALESCE(p * max_by(scale, p) FILTER (WHERE (p * scale >= 1) IS NOT TRUE) OVER (PARTITION BY source), 0.0::DOUBLE) END AS odds FROM k1),
r0 AS (SELECT d.*, k2.odds, CASE WHEN odds = 0 THEN 1.0::DOUBLE WHEN odds = 1 THEN -1.0::DOUBLE ELSE (u / (1 - u)) / (odds / (1 - odds)) END AS x
    FROM d JOIN k2 ON d.source IS NOT DISTINCT FROM k2.source AND length(bin(d.size)) = k2.p),
r AS (SELECT d.doc_id, d.source, d.size, source_size, target, copies, rest, odds,
    COALESCE(sum(d.size) OVER (PARTITION BY d.source ORDER BY x / (1 + abs(x)), d.size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM r0 d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source)
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN rest > 0 AND (odds = 1 OR 2 * start + size <= 2 * rest) THEN 1 ELSE 0 END))::BIGINT AS taken,
    (copies + CASE WHEN rest > 0 AND (odds = 1 OR 2 * start + size <= 2 * rest) THEN 1 ELSE 0 END)::BIGINT AS copies, odds AS inclusion, source FROM r
"""
