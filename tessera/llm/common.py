"""What the operators of this subpackage share: words, tables, durable cuts of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space ones.
SPACE = r"[\x20\x09-\x0D]+"
#: Tasks that the rows of one key are dealt over.
SPREAD = 16
#: With it Spark deletes the shuffle files of an SQL execution when that ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def words(c: Column) -> Column:
    """The words of a text, in order; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE, -1), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(c: Column) -> Column:
    """The same value, computed once in its own step: what is above can't be merged into that step and name the expression several times, nor can a filter be pushed below it."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def packed(df: DataFrame, name: str = "_doc") -> Column:
    """All columns as one struct, so that columns added beside it can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names. Only a session on this machine alone may go without: it gets a folder of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return named or sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The same rows, of any types, written to the shared checkpoint folder, with no lineage behind them.

    Lost executors then cost a reread of shared files, never a recomputation of the stages before.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As durable, but as a Parquet table: for slim tables of our own columns. Its size is known to the optimiser, and release() deletes it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    # what is shuffled for it is never read again: its files go with the write, not when the JVM happens to collect
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    spark._jvm.System.gc()  # the driver's notes of them go then
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def release(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of tables that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def with_totals(rows: DataFrame, keys: list[str], by: list[str], spread: int = SPREAD, **totals: tuple[str, str]) -> DataFrame:
    """rows with totals over equal keys (none null): name=(kind, expression), kind one of min, max, sum.

    Rows are shuffled once, those of one key dealt over ``spread`` tasks by a hash of the columns ``by``; a key's own task sees at most one row
    for each of these, so a key that holds a third of all rows makes no task large.
    """
    kinds = {"min": F.min, "max": F.max, "sum": F.sum}
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(spread)).cast("int")).repartition(*keys, "_salt")
    parts = salted.groupBy(*keys, "_salt").agg(*(kinds[kind](F.expr(of)).alias(name) for name, (kind, of) in totals.items()))
    whole = Window.partitionBy(*keys)
    parts = parts.select(*keys, "_salt", *(kinds[kind](name).over(whole).alias(name) for name, (kind, _) in totals.items()))
    return salted.join(parts, [*keys, "_salt"]).drop("_salt")


def unit(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the key's md5, the same on every run and in every engine."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("\x00"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 48))
