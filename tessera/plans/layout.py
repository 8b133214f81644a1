"""Slices, encodings and byte layout as relational plans.

Rows carry a global index, so a slice is a division, a run is a gap in it, an encoded size is a sum and an offset
a running sum. Run detection works inside a slice (windows are partitioned by slice, of bounded size); only one row a slice
reaches the running sum, which itself goes by blocks of slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.types import logical, varint_size

BATCH = 5000
RUN = 256
BLOCK = 4096


def indexed(df: DataFrame, name: str = "row_index") -> DataFrame:
    """A Parquet frame with its global row index: files in path order, rows as they stand. One row a file is counted and joined back."""
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.groupBy("_file").agg((F.max("_row") + 1).alias("_rows"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    return rows.join(files, "_file").withColumn(name, F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def read_indexed(spark: SparkSession, path: str, name: str = "row_index") -> DataFrame:
    return indexed(spark.read.parquet(path), name)


def slice_of(row: Column, batch: int = BATCH) -> Column:
    return F.call_function("div", row, F.lit(batch).cast("bigint"))


def running_sum(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """The sum of value over the rows before, by order (whole numbers from 0): within blocks, and over the blocks' sums."""
    block = F.floor(F.col(order) / BLOCK)
    df = df.withColumn("_block", block)
    tops = df.groupBy("_block").agg(F.sum(value).alias("_sum"))
    tops = tops.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inner = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(tops, "_block").withColumn(name, F.col("_base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_block", "_base")


def slice_plan(rows: DataFrame, batch: int = BATCH) -> DataFrame:
    return rows.groupBy(slice_of(F.col("row_index"), batch).alias("slice_id")).agg(F.count("*").alias("n_rows"), F.min("row_index").alias("row_start"))


def normalized(c: Column, name: str) -> Column:
    """Null cells carry a zero or empty value; an index beside them says that they are null."""
    zero = {"String": F.lit(""), "Binary": F.lit(bytearray()), "Boolean": F.lit(False)}.get(name, F.lit(0))
    return F.coalesce(c, zero)


def long_form(rows: DataFrame, types: dict[str, str], batch: int = BATCH) -> DataFrame:
    """(slice_id, row_index, col, kind, width, size, bits, invalid): a row for each value. bits tell two values apart exactly."""
    cells = []
    for at, (c, name) in enumerate(types.items()):
        t, v = logical(name), normalized(F.col(c), name)
        size = F.lit(t.width) if t.width else varint_size(F.octet_length(v)) + F.octet_length(v)
        bits = v.cast("string") if name != "Binary" else F.hex(v)
        cells.append(F.struct(F.lit(at).alias("col"), F.lit(name).alias("kind"), size.cast("bigint").alias("size"), bits.alias("bits"), F.col(c).isNull().alias("invalid")))
    return rows.select(slice_of(F.col("row_index"), batch).alias("slice_id"), "row_index", F.inline(F.array(*cells)))


def column_sizes(cells: DataFrame) -> DataFrame:
    """A row for each slice and column: n, nulls, plain and run-length sizes of the value array, runs."""
    own = Window.partitionBy("slice_id", "col").orderBy("row_index")
    starts = (~F.col("bits").eqNullSafe(F.lag("bits").over(own)) | (F.row_number().over(own) == 1)).cast("int")
    runs = cells.withColumn("_new", starts).withColumn("_run", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    by_run = runs.groupBy("slice_id", "col", "kind", "_run").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.sum(F.col("invalid").cast("int")).alias("nulls")).withColumn("k", F.ceil(F.col("n") / RUN))
    variable = F.col("kind").isin("String", "Binary")
    sums = by_run.groupBy("slice_id", "col", "kind").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("k").alias("runs"), F.sum(F.col("n") * F.col("size")).alias("_plain"), F.sum(F.col("k") * F.col("size")).alias("_rle"))
    lead = F.when(variable, 4).otherwise(0)
    return sums.select("slice_id", "col", "kind", "n", "nulls", "runs", (6 + lead + F.col("_plain")).alias("plain_size"), (14 + F.col("runs") + lead + F.col("_rle")).alias("rle_size"))


def chosen(sizes: DataFrame, encoding: str = "adaptive") -> DataFrame:
    """Adds encoding (1 plain, 2 run-length, 3 bits) and value_size. Binary is always plain, Boolean always bits."""
    bits = F.col("kind") == "Boolean"
    rle = {"plain": F.lit(False), "rle": F.lit(True), "adaptive": F.col("rle_size") < F.col("plain_size")}[encoding] & (F.col("kind") != "Binary")
    code = F.when(bits, 3).when(rle, 2).otherwise(1)
    size = F.when(bits, 6 + F.ceil(F.col("n") / 8)).when(rle, F.col("rle_size")).otherwise(F.col("plain_size"))
    return sizes.withColumn("encoding", code).withColumn("value_size", size.cast("bigint"))


def invalid_size(n: Column, nulls: Column) -> Column:
    """Bytes of a column slice's properties: a count, and the null bits if there are any."""
    return F.when(nulls == 0, 4).otherwise(4 + 4 + 9 + 6 + F.ceil(n / 8)).cast("bigint")


def preamble_size(names: list[str]) -> int:
    return 44 + sum(11 + len(n.encode()) for n in names)


def slice_layout(rows: DataFrame, types: dict[str, str], batch: int = BATCH, encoding: str = "adaptive") -> DataFrame:
    """(slice_id, n_rows, byte_length, byte_offset) of every slice, before anything is encoded."""
    sizes = chosen(column_sizes(long_form(rows, types, batch)), encoding)
    per = sizes.groupBy("slice_id").agg(F.max("n").alias("n_rows"), (7 + F.sum(3 + F.col("value_size") + invalid_size(F.col("n"), F.col("nulls")))).alias("byte_length"))
    out = running_sum(per, "slice_id", "byte_length", "_before")
    return out.select("slice_id", "n_rows", "byte_length", (F.col("_before") + preamble_size(list(types))).alias("byte_offset"))


def coordinates(rows: DataFrame, keys: list[str], layout: DataFrame, table_id: str, file: str, batch: int = BATCH) -> DataFrame:
    """The sidecar's rows: keys, then the nine coordinates. layout has one row a slice."""
    start = F.col("slice_id") * batch
    own = rows.select(*keys, "row_index", slice_of(F.col("row_index"), batch).alias("slice_id")).join(layout, "slice_id")
    return own.select(
        *keys,
        F.lit(table_id).alias("__sbdf_table_id"),
        F.lit(file).alias("__sbdf_file"),
        F.col("slice_id").alias("__sbdf_slice_id"),
        F.col("row_index").alias("__sbdf_row_index"),
        (F.col("row_index") - start).alias("__sbdf_row_in_slice"),
        start.alias("__sbdf_slice_row_start"),
        F.col("n_rows").alias("__sbdf_slice_row_count"),
        F.col("byte_offset").alias("__sbdf_byte_offset"),
        F.col("byte_length").alias("__sbdf_byte_length"),
    )
