"""The named queries over the fixtures, with the same results in SQL."""

from __future__ import annotations

import csv
import itertools
import os
import tempfile
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions.types import CATALOG, boolean_of, canonical, date_ms, fingerprint, fnv1a, instant_ms, of_name, resolve, stored, time_of_day_ms, timestamp_ms, varint_size
from .plans import layout, policy
from .sources import codec, files, sbdf
from .streaming.writer import StreamingWriter

ROWS = "row_number() OVER () - 1"
EPOCH = "62135596800000"


def _shared(spark: SparkSession) -> str:
    """A folder that the driver and the executors both see."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and named.removeprefix("file://").startswith("/"):
        base = named.removeprefix("file://")
    else:
        base = tempfile.gettempdir()
    path = os.path.join(base, f"tessera-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path


def _p(sf_dir: str, t: str) -> str:
    return f"{sf_dir}/{t}.parquet"


def _typed(df: DataFrame) -> DataFrame:
    types = resolve(df.schema)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[canonical(F.col(c), kinds[c], t).cast(stored(t)).alias(c) for c, t in types.items()])


def q01(spark, d):
    return _typed(spark.read.parquet(_p(d, "lineitem")))


def q02(spark, d):
    rows = []
    for t in ("lineitem", "events"):
        for c, name in resolve(spark.read.parquet(_p(d, t)).schema).items():
            rows.append((t, c, name, CATALOG[name].id, CATALOG[name].width))
    return spark.createDataFrame(rows, "table_name string, column_name string, type_name string, type_id int, width int")


def q03(spark, d):
    o = spark.read.parquet(_p(d, "orders")).select(F.col("o_orderkey").alias("id"), timestamp_ms(F.col("o_orderdate")).alias("ms"))
    e = spark.read.parquet(_p(d, "events")).select(F.col("event_id").alias("id"), timestamp_ms(F.col("ts")).alias("ms"))
    return o.withColumn("src", F.lit("orders")).unionByName(e.withColumn("src", F.lit("events")))


def q04(spark, d):
    return spark.read.parquet(_p(d, "orders")).select("o_orderkey", date_ms(F.col("o_orderdate").cast("date")).alias("ms"))


def q05(spark, d):
    return spark.read.parquet(_p(d, "events")).select("event_id", time_of_day_ms(F.unix_micros(F.col("ts").cast("timestamp"))).alias("ms"))


def q06(spark, d):
    l, o = spark.read.parquet(_p(d, "lineitem")), spark.read.parquet(_p(d, "orders"))
    return l.join(o, l.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "l_partkey", (timestamp_ms(F.col("l_shipdate")) - timestamp_ms(F.col("o_orderdate"))).alias("span_ms"))


def _events(spark, d):
    return layout.read_indexed(spark, _p(d, "events")).withColumn("event_type", F.nullif(F.col("event_type"), F.lit("error")))


EVENTS_SQL = f"e AS (SELECT *, nullif(event_type, 'error') AS kind, {ROWS} AS row_index FROM events)"


def q07(spark, d):
    return _events(spark, d).groupBy(layout.slice_of(F.col("row_index"), 1700).alias("slice_id")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("event_type").isNull()).alias("n_null"), F.bool_or(F.col("event_type").isNull()).alias("has_invalid"), layout.invalid_size(F.count("*"), F.count_if(F.col("event_type").isNull())).alias("property_bytes"))


def q08(spark, d):
    return layout.slice_plan(layout.read_indexed(spark, _p(d, "lineitem")))


LINE = {"l_returnflag": "String", "l_linenumber": "Integer"}


def q09(spark, d):
    sizes = layout.column_sizes(layout.long_form(layout.read_indexed(spark, _p(d, "lineitem")), LINE))
    return sizes.select("slice_id", "col", "n", "runs")


EVENT = {"event_type": "String", "user_id": "LongInteger"}


def q10(spark, d):
    sizes = layout.chosen(layout.column_sizes(layout.long_form(_events(spark, d), EVENT, 1700)))
    return sizes.select("slice_id", "col", "n", "nulls", "plain_size", "rle_size", "encoding", "value_size")


def q11(spark, d):
    return layout.slice_layout(_events(spark, d), EVENT, 1700)


def q12(spark, d):
    rows = _events(spark, d)
    return layout.coordinates(rows, ["event_id"], layout.slice_layout(rows, EVENT, 1700), "t", "events.sbdf", 1700)


def q13(spark, d):
    rows = _events(spark, d)
    found = layout.coordinates(rows, ["user_id"], layout.slice_layout(rows, EVENT, 1700), "t", "events.sbdf", 1700)
    return found.groupBy("user_id", F.col("__sbdf_slice_id").alias("slice_id"), F.col("__sbdf_byte_offset").alias("byte_offset"), F.col("__sbdf_byte_length").alias("byte_length")).agg(F.count("*").alias("n_rows"))


def q14(spark, d):
    rows = files.parquet_files(spark, [_p(d, "orders"), _p(d, "orders")], 700)
    return rows.select("file_ordinal", "row_index", "slice_id", "o_orderkey", "o_orderpriority")


def q15(spark, d):
    p = spark.read.parquet(_p(d, "part"))
    types = resolve(p.schema, {"p_size": "LongInteger", "p_retailprice": "SingleReal", "p_partkey": "String", "p_name": "Binary"})
    kinds = {f.name: f.dataType for f in p.schema.fields}
    out = p.select(*[canonical(F.col(c), kinds[c], t).alias(c) for c, t in types.items()])
    return out.select("p_partkey", F.hex("p_name").alias("p_name"), "p_size", F.col("p_retailprice").cast("double").alias("p_retailprice"))


def q16(spark, d):
    e = spark.read.parquet(_p(d, "events")).select("event_id", F.col("ts").alias("event_time"), F.col("user_id").cast("int").alias("wafer_id"))
    types = resolve(e.schema, by_name=True)
    kinds = {f.name: f.dataType for f in e.schema.fields}
    cols = [canonical(F.col(c), kinds[c], types[c]).alias(c) for c in e.columns]
    return e.select(*cols, F.lit(types["event_time"]).alias("event_time_type"), F.lit(of_name("wafer_id")).alias("wafer_id_type"))


def q17(spark, d):
    base = f"{_shared(spark)}/csv"
    c = spark.read.parquet(_p(d, "customer"))
    c.coalesce(1).write.option("header", True).option("escape", '"').csv(f"file://{base}")
    types = {"c_custkey": "LongInteger", "c_name": "String", "c_nationkey": "Integer", "c_acctbal": "Real", "c_mktsegment": "String"}
    return files.read_csv(spark, f"file://{base}", types).drop("row_index")


def q18(spark, d):
    target = f"{_shared(spark)}/lineitem.sbdf"
    rows = layout.read_indexed(spark, _p(d, "lineitem"))
    types = resolve(rows.drop("row_index").schema)
    sbdf.write(files.canonical_rows(rows, types), types, target)
    return sbdf.read(spark, target, row_index=True)


WORKERS = ((3, 1, 1, 135), (3, 21, 21, 75), (3, 74, 74, 535), (3, 147, 147, 1069), (3, 300, 300, 1070), (1, 147, 147, 1069))


def q19(spark, d):
    return spark.createDataFrame([(*v, policy.adaptive_workers(*v[:3], v[3] << 20)) for v in WORKERS], "requested int, row_groups int, most_in_file int, mib int, workers int")


CAPS = ((5000, 300_000, 1_070_623_282), (50_000, 300_000, 1_070_623_282), (50_000, 0, 0), (10, 4, 1 << 30))


def q20(spark, d):
    return spark.createDataFrame([(*v, policy.batch_cap(*v)) for v in CAPS], "requested bigint, n_rows bigint, n_bytes bigint, cap bigint")


def q21(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("toxic") == 1, " TRUE").otherwise("False ")).otherwise(F.col("toxic").cast("string"))
    return spark.read.parquet(_p(d, "labels")).select("doc_id", boolean_of(text).alias("flag"))


def q22(spark, d):
    """Checksums of the regions' names (five by the table's nature) and the fingerprint of a schema of theirs."""
    names = [r[0] for r in spark.read.parquet(_p(d, "region")).select("r_name").orderBy("r_name").collect()]
    of_schema = fingerprint(dict.fromkeys(names, "String"))
    return spark.createDataFrame([(n, f"{fnv1a(n.encode()):016x}", f"{of_schema:016x}") for n in names], "r_name string, checksum string, schema_fingerprint string")


def q23(spark, d):
    n = F.octet_length("text").cast("bigint")
    return spark.read.parquet(_p(d, "documents")).select("doc_id", n.alias("n_bytes"), varint_size(n).alias("varint_bytes"))


def q24(spark, d):
    rows = layout.read_indexed(spark, _p(d, "labels"))
    bit = F.call_function("shiftleft", F.col("toxic").cast("int"), (7 - F.col("row_index") % 8).cast("int"))
    return rows.groupBy(F.floor(F.col("row_index") / 8).alias("byte_index")).agg(F.sum(bit).alias("byte_value"), F.count("*").alias("n_bits"))


MANIFEST = "# parts\n\na.parquet\n  sub/b.parquet  \n#c.parquet\n/abs/d.pq\n"


def q25(spark, d):
    return spark.createDataFrame(list(enumerate(files.manifest_lines(MANIFEST))), "ordinal bigint, path string")


PATHS = ("b.csv", "a.PARQUET", "c.pq", "list.manifest", "x.CSV")


def q26(spark, d):
    return spark.createDataFrame([(i, p, files.input_format(p, is_dir=False)) for i, p in enumerate(sorted(PATHS))], "ordinal int, path string, format string")


def _csv(spark, d, name: str, columns: dict[str, str] | None = None, end: str = "\n") -> str:
    """A table as one CSV file, in the table's order (a scan deals files by size), quoted as usual; columns: name -> SQL. end closes lines."""
    path = f"{_shared(spark)}/{name}.csv"
    df = layout.read_indexed(spark, _p(d, name)).orderBy("row_index").drop("row_index")
    df = df.selectExpr(*[f"{v} AS {k}" for k, v in columns.items()]) if columns else df
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(df.columns)
        for r in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in r])
    return path


def q27(spark, d):
    found = files.infer_csv(_csv(spark, d, "part"))
    return spark.createDataFrame(list(found.items()), "column_name string, type_name string")


def q28(spark, d):
    """Text with quotes, line breaks and other scripts through CSV and a table file."""
    source = _csv(spark, d, "documents")
    target = f"{source}.sbdf"
    api.csv_to_sbdf(source, target, column_types={"doc_id": "LongInteger"}, spark=spark)
    return sbdf.read(spark, target, row_index=True)


WIDE = {f"c{i:02d}": e for i, e in enumerate(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "cast(o_orderdate AS date)", "o_orderpriority"] * 3 + ["o_orderkey % 2 = 0", "if(o_orderkey % 3 = 0, NULL, o_orderkey)"])}


def q29(spark, d):
    """Twenty columns, with CRLF line ends, empty fields and Booleans."""
    source = _csv(spark, d, "orders", WIDE, "\r\n")
    target = f"{source}.sbdf"
    api.csv_to_sbdf(source, target, adaptive_encoding=True, spark=spark)
    return sbdf.read(spark, target)


def _spans(spark, path: str) -> DataFrame:
    """(slice_id, byte_offset, byte_length, n_rows) as a table file's own headers have them."""
    with open(path, "rb") as f:
        found = [(i, *x) for i, x in enumerate(codec.slice_spans(f, codec.read_table(f)))]
    return spark.createDataFrame(found, "slice_id bigint, byte_offset bigint, byte_length bigint, n_rows bigint")


def q30(spark, d):
    """Slices of a list of two files: they end with their file."""
    target = f"{_shared(spark)}/two.sbdf"
    api.parquet_files_to_sbdf([_p(d, "orders"), _p(d, "nation")][:1] * 2, target, batch_size=700, workers=2, spark=spark)
    return _spans(spark, target).select("slice_id", "n_rows")


def _folder(spark, d) -> str:
    """customer in three Parquet files, dealt by key; b.parquet comes between the others."""
    base = _shared(spark)
    rows = pq.read_table(_p(d, "customer"))
    key = rows.column("c_custkey").to_numpy() % 3
    for i, name in enumerate(("a", "b", "c")):
        pq.write_table(rows.filter(pa.array(key == i)), f"{base}/{name}.parquet", row_group_size=97)
    return base


def q31(spark, d):
    base = _folder(spark, d)
    api.convert(base, f"{base}/all.sbdf", spark=spark)
    return sbdf.read(spark, f"{base}/all.sbdf", row_index=True)


def q32(spark, d):
    base = _folder(spark, d)
    with open(f"{base}/list.manifest", "w") as f:
        f.write(f"# the last comes first\n\n{base}/c.parquet\n  a.parquet\n")
    api.convert(f"{base}/list.manifest", f"{base}/some.sbdf", batch_size=50, encoding_rle=False, spark=spark)
    return sbdf.read(spark, f"{base}/some.sbdf", ["c_custkey", "c_mktsegment"], row_index=True)


def _nulls(spark, d) -> DataFrame:
    e = layout.read_indexed(spark, _p(d, "events"))
    return e.selectExpr("row_index", "event_id", "ts", "nullif(event_type, 'error') AS event_type", "if(user_id % 5 = 0, NULL, user_id) AS user_id", "if(event_id % 4 = 0, NULL, value) AS value", "if(event_id % 3 = 0, NULL, event_id % 2 = 0) AS flag", "encode(props, 'utf-8') AS props")


NULLS_SQL = f"""n AS (SELECT {ROWS} AS row_index, event_id, epoch_us(ts) // 1000 + {EPOCH} AS ts, nullif(event_type, 'error') AS event_type, CASE WHEN user_id % 5 <> 0 THEN user_id END AS user_id,
    CASE WHEN event_id % 4 <> 0 THEN value END AS value, CASE WHEN event_id % 3 <> 0 THEN event_id % 2 = 0 END AS flag, hex(encode(props)) AS props FROM events)"""


def q33(spark, d):
    """Every stored kind with nulls, there and back."""
    rows, target = _nulls(spark, d), f"{_shared(spark)}/nulls.sbdf"
    types = resolve(rows.drop("row_index").schema)
    sbdf.write(files.canonical_rows(rows, types), types, target, 1700)
    return sbdf.read(spark, target, row_index=True).withColumn("props", F.hex("props"))


ONE = {"event_type": "String", "flag": "Boolean", "props": "Binary", "user_id": "LongInteger"}


def q34(spark, d):
    """Bytes of each slice for a column alone under each encoding: runs never for binary values, bits always for Booleans."""
    rows, base, out = _nulls(spark, d), _shared(spark), None
    for c, t in ONE.items():
        for mode in codec.MODES:
            target = f"{base}/{c}-{mode}.sbdf"
            sbdf.write(files.canonical_rows(rows.select("row_index", c), {c: t}), {c: t}, target, 1700, mode)
            own = _spans(spark, target).select(F.lit(c).alias("col"), F.lit(mode).alias("mode"), "slice_id", "n_rows", "byte_length")
            out = own if out is None else out.unionByName(own)
    return out


def q35(spark, d):
    """A sidecar's file: a temporal and a text key with nulls, coordinates and byte ranges."""
    base = _shared(spark)
    rows = _nulls(spark, d).select("row_index", "event_type", "ts")
    types = {"event_type": "String", "ts": "DateTime"}
    sbdf.write(files.canonical_rows(rows, types), types, f"{base}/e.sbdf", 1700, "plain")
    return spark.read.parquet(f"file://{api.generate_sidecar(f'{base}/e.sbdf', row_key_columns=['event_type', 'ts'], table_id='t')}")


def q36(spark, d):
    """A pandas frame with NaN, None and overrides."""
    e = pq.read_table(_p(d, "events"), columns=["event_id", "event_type", "value"]).to_pandas()
    e["value"] = e["value"].where(e["event_id"] % 4 != 0)
    e["event_type"] = e["event_type"].where(e["event_type"] != "error", None)
    target = f"{_shared(spark)}/pandas.sbdf"
    api.to_sbdf(e, target, column_types={"event_id": "String"})
    return sbdf.read(spark, target)


def q37(spark, d):
    """A Spark frame: NaN is missing there, and a name with time in it means a point in time."""
    e = spark.read.parquet(_p(d, "events")).selectExpr("event_id", "if(event_id % 4 = 0, double('NaN'), value) AS value", "ts AS event_time", "cast(user_id AS int) AS wafer_id")
    target = f"{_shared(spark)}/frame.sbdf"
    api.dataframe_to_sbdf(e, target)
    return sbdf.read(spark, target)


def q38(spark, d):
    """Batches of Python values, with points in time before 1970: parts of a millisecond go down there, whatever the year."""
    rows = spark.read.parquet(_p(d, "events")).selectExpr("event_id", "ts - INTERVAL 80 YEARS AS ts", "cast(ts AS date) AS day", "event_type").toLocalIterator()
    target = f"{_shared(spark)}/batches.sbdf"
    with StreamingWriter(target, column_types={"event_type": "String"}) as w:
        while some := list(itertools.islice(rows, 900)):
            w.write_batch({"event_id": [r.event_id for r in some], "ts": [r.ts for r in some], "day": [r.day for r in some], "event_type": [None if r.event_type == "error" else r.event_type for r in some]})
    return sbdf.read(spark, target)


def q39(spark, d):
    """Points in time before 1970 from Parquet: parts of a millisecond go towards 1970; from instants they go down."""
    old = spark.read.parquet(_p(d, "events")).select("event_id", F.expr("ts - INTERVAL 80 YEARS").alias("ts"))
    return old.select("event_id", timestamp_ms(F.col("ts")).alias("ms"), instant_ms(F.col("ts")).alias("floor_ms"))


def q40(spark, d):
    """What a conversion says of itself."""
    base = _folder(spark, d)
    r = api.convert_with_result(base, f"{base}/all.sbdf", batch_size=100, workers=2, adaptive_workers=False, spark=spark)
    return spark.createDataFrame([(r.row_count, r.slice_count, len(r.input_files), r.requested_workers, r.effective_workers, r.requested_batch_size)], "n_rows bigint, n_slices bigint, n_files int, asked int, used int, batch int")


def q41(spark, d):
    """Spans of time and times of day as columns of their own types."""
    e = spark.read.parquet(_p(d, "events")).selectExpr("event_id", "cast(ts AS timestamp_ntz) - date_trunc('YEAR', ts) AS since", "ts")
    types = {"event_id": "LongInteger", "since": "TimeSpan", "ts": "Time"}
    kinds = {f.name: f.dataType for f in e.schema.fields}
    return e.select(*[canonical(F.col(c), kinds[c], t).cast(stored(t)).alias(c) for c, t in types.items()])


#: Bytes of values at which q42's slices end.
Q42_BYTES = 20_000


def q42(spark, d):
    """Rows of slices that end early by their bytes."""
    rows, types, target = layout.read_indexed(spark, _p(d, "events")).select("row_index", "event_id", "props"), {"event_id": "LongInteger", "props": "String"}, f"{_shared(spark)}/bytes.sbdf"
    sbdf.write(files.canonical_rows(rows, types), types, target, 1700, most=Q42_BYTES)
    return _spans(spark, target).select("slice_id", "n_rows")


def queries() -> dict:
    names = "scan_parquet_typed type_catalog datetime_to_ms date_to_ms time_to_ms timespan_to_ms null_bitmap slice_plan rle_runs adaptive_choice slice_layout sidecar_coordinates sidecar_lookup ordered_concat cast_overrides name_rules csv_roundtrip sbdf_roundtrip worker_policy batch_cap bool_parse fnv1a_checksum varint_size bit_pack manifest_parse dataset_listing csv_infer_sample convert_csv convert_wide_csv slices_per_file convert_dataset convert_manifest nulls_roundtrip encodings_by_column sidecar_file pandas_frame spark_frame batch_writer before_1970 conversion_result spans_and_times slices_by_bytes".split()
    return {f"q{i:02d}_{n}": globals()[f"q{i:02d}"] for i, n in enumerate(names, 1)}


_LINE_MS = f"(epoch_us(l_shipdate) // 1000 + {EPOCH})"
_LINE = f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, {_LINE_MS} AS l_shipdate"


def _sizes(frame: str, batch: int, cols: list[tuple[str, str]]) -> str:
    """CTEs up to s(slice_id, col, n, nulls, runs, plain_size, rle_size): cols are (value, kind) in SQL."""
    cells = " UNION ALL ".join(
        f"SELECT row_index // {batch} AS slice_id, row_index, {i} AS col, '{k}' AS kind, {v} IS NULL AS nul, COALESCE({v}::VARCHAR, {chr(39) * 2 if k == 'String' else chr(39) + '0' + chr(39)}) AS bits FROM {frame}" for i, (v, k) in enumerate(cols)
    )
    size = "CASE kind WHEN 'String' THEN strlen(bits) + CASE WHEN strlen(bits) < 128 THEN 1 WHEN strlen(bits) < 16384 THEN 2 ELSE 3 END WHEN 'Integer' THEN 4 ELSE 8 END"
    return f"""c AS ({cells}),
b AS (SELECT *, {size} AS size, CASE WHEN bits = lag(bits) OVER w THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY slice_id, col ORDER BY row_index)),
r AS (SELECT *, sum(new) OVER (PARTITION BY slice_id, col ORDER BY row_index) AS run FROM b),
g AS (SELECT slice_id, col, kind, run, count(*) AS n, count(*) FILTER (nul) AS nulls, any_value(size) AS size, (count(*) + 255) // 256 AS k FROM r GROUP BY ALL),
s AS (SELECT slice_id, col, kind, sum(n)::BIGINT AS n, sum(nulls)::BIGINT AS nulls, sum(k)::BIGINT AS runs,
    (6 + CASE kind WHEN 'String' THEN 4 ELSE 0 END + sum(n * size))::BIGINT AS plain_size,
    (14 + sum(k) + CASE kind WHEN 'String' THEN 4 ELSE 0 END + sum(k * size))::BIGINT AS rle_size FROM g GROUP BY slice_id, col, kind)"""


_EVENT = f"WITH {EVENTS_SQL}, {_sizes('e', 1700, [('kind', 'String'), ('user_id', 'LongInteger')])}"
_LAYOUT = _EVENT + f""", p AS (SELECT slice_id, max(n) AS n_rows, (7 + sum(3 + least(plain_size, rle_size) + CASE WHEN nulls = 0 THEN 4 ELSE 23 + (n + 7) // 8 END))::BIGINT AS byte_length FROM s GROUP BY slice_id),
l AS (SELECT slice_id, n_rows, byte_length, (COALESCE(sum(byte_length) OVER (ORDER BY slice_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {layout.preamble_size(list(EVENT))})::BIGINT AS byte_offset FROM p)"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_TYPES = [("lineitem", c, t) for c, t in zip("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split(), ["LongInteger"] * 3 + ["Integer"] + ["Real"] * 4 + ["String"] * 2 + ["DateTime"])] + [("events", c, t) for c, t in zip("event_id ts user_id event_type value props".split(), "LongInteger DateTime LongInteger String Real String".split())]

_WIDE_SQL = {"cast(o_orderdate AS date)": "date_diff('day', DATE '0001-01-01', o_orderdate::DATE) * 86400000", "if(o_orderkey % 3 = 0, NULL, o_orderkey)": "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END"}


def _one_sql() -> str:
    """Sizes of slices of one column: s has plain and run sizes for text and numbers; Booleans are bits, binary values plain."""
    kinds = [(c, "String" if t == "Binary" else t) for c, t in ONE.items() if t != "Boolean"]
    values = [({"props": "CASE WHEN true THEN props_text END"}.get(c, c), k) for c, k in kinds]
    names = ", ".join(f"({i}, '{c}')" for i, (c, _) in enumerate(kinds))
    frame = f"n0 AS (SELECT {ROWS} AS row_index, props AS props_text FROM events), nn AS (SELECT n.*, props_text FROM n JOIN n0 USING (row_index))"
    rest = "7 + 3 + CASE WHEN nulls = 0 THEN 4 ELSE 23 + (n + 7) // 8 END"
    size = "CASE WHEN name = 'props' OR mode = 'plain' THEN plain_size WHEN mode = 'rle' THEN rle_size ELSE least(plain_size, rle_size) END"
    modes = "(VALUES ('plain'), ('rle'), ('adaptive')) m(mode)"
    flags = f"SELECT 'flag' AS col, mode, row_index // 1700 AS slice_id, count(*) AS n_rows, (7 + 3 + 6 + (count(*) + 7) // 8 + CASE WHEN count(flag) = count(*) THEN 4 ELSE 23 + (count(*) + 7) // 8 END)::BIGINT AS byte_length FROM n, {modes} GROUP BY ALL"
    return f"WITH {NULLS_SQL}, {frame}, {_sizes('nn', 1700, values)} SELECT name AS col, mode, slice_id, n AS n_rows, ({rest} + {size})::BIGINT AS byte_length FROM s JOIN (VALUES {names}) v(col, name) USING (col), {modes} UNION ALL {flags}"


_ONE_SQL = _one_sql()

SQL = {
    "q01": f"{_LINE} FROM lineitem",
    "q02": f"SELECT * FROM (VALUES {_values((*t, CATALOG[t[2]].id, CATALOG[t[2]].width) for t in _TYPES)}) v(table_name, column_name, type_name, type_id, width)",
    "q03": f"SELECT o_orderkey AS id, epoch_us(o_orderdate) // 1000 + {EPOCH} AS ms, 'orders' AS src FROM orders UNION ALL SELECT event_id, epoch_us(ts) // 1000 + {EPOCH}, 'events' FROM events",
    "q04": "SELECT o_orderkey, date_diff('day', DATE '0001-01-01', o_orderdate::DATE) * 86400000 AS ms FROM orders",
    "q05": "SELECT event_id, (epoch_us(ts) % 86400000000) // 1000 AS ms FROM events",
    "q06": "SELECT l_orderkey, l_linenumber, l_partkey, epoch_us(l_shipdate) // 1000 - epoch_us(o_orderdate) // 1000 AS span_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "q07": f"WITH {EVENTS_SQL} SELECT row_index // 1700 AS slice_id, count(*) AS n_rows, count(*) FILTER (kind IS NULL) AS n_null, bool_or(kind IS NULL) AS has_invalid, CASE WHEN count(*) = count(kind) THEN 4 ELSE 23 + (count(*) + 7) // 8 END AS property_bytes FROM e GROUP BY 1",
    "q08": f"SELECT i // 5000 AS slice_id, count(*) AS n_rows, min(i) AS row_start FROM (SELECT {ROWS} AS i FROM lineitem) GROUP BY 1",
    "q09": f"WITH f AS (SELECT *, {ROWS} AS row_index FROM lineitem), {_sizes('f', 5000, [('l_returnflag', 'String'), ('l_linenumber', 'Integer')])} SELECT slice_id, col, n, runs FROM s",
    "q10": f"{_EVENT} SELECT slice_id, col, n, nulls, plain_size, rle_size, CASE WHEN rle_size < plain_size THEN 2 ELSE 1 END AS encoding, least(plain_size, rle_size) AS value_size FROM s",
    "q11": f"{_LAYOUT} SELECT * FROM l",
    "q12": f"{_LAYOUT} SELECT event_id, 't' AS __sbdf_table_id, 'events.sbdf' AS __sbdf_file, slice_id AS __sbdf_slice_id, row_index AS __sbdf_row_index, row_index - slice_id * 1700 AS __sbdf_row_in_slice, slice_id * 1700 AS __sbdf_slice_row_start, n_rows AS __sbdf_slice_row_count, byte_offset AS __sbdf_byte_offset, byte_length AS __sbdf_byte_length FROM e JOIN l ON slice_id = row_index // 1700",
    "q13": f"{_LAYOUT} SELECT user_id, slice_id, byte_offset, byte_length, count(*) AS n_rows FROM e JOIN l ON slice_id = row_index // 1700 GROUP BY 1, 2, 3, 4",
    "q14": f"WITH n AS (SELECT *, {ROWS} AS i, count(*) OVER () AS k FROM orders) SELECT f::INTEGER AS file_ordinal, f * k + i AS row_index, f * ((k + 699) // 700) + i // 700 AS slice_id, o_orderkey, o_orderpriority FROM n, (VALUES (0), (1)) v(f)",
    "q15": "SELECT p_partkey::VARCHAR AS p_partkey, hex(encode(p_name)) AS p_name, p_size::BIGINT AS p_size, p_retailprice::FLOAT::DOUBLE AS p_retailprice FROM part",
    "q16": f"SELECT event_id, epoch_us(ts) // 1000 + {EPOCH} AS event_time, user_id::BIGINT AS wafer_id, 'DateTime' AS event_time_type, 'LongInteger' AS wafer_id_type FROM events",
    "q17": "SELECT c_custkey, nullif(c_name, '') AS c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, '') AS c_mktsegment FROM customer",
    "q18": f"{_LINE}, {ROWS} AS row_index FROM lineitem",
    "q19": f"SELECT *, CASE WHEN least(requested, row_groups, most_in_file) <= 1 THEN 1 WHEN mib <= 128 THEN least(2, requested, most_in_file) WHEN mib >= 768 AND mib >= 4 * row_groups AND most_in_file <= 256 THEN least(3, requested, most_in_file) ELSE 1 END AS workers FROM (VALUES {_values(WORKERS)}) v(requested, row_groups, most_in_file, mib)",
    "q20": f"SELECT *, CASE WHEN n_rows = 0 OR n_bytes = 0 THEN requested ELSE least(requested, greatest(1, 67108864 // greatest(1, (n_bytes + n_rows - 1) // n_rows))) END AS cap FROM (VALUES {_values(CAPS)}) v(requested, n_rows, n_bytes)",
    "q21": "SELECT doc_id, toxic = 1 AS flag FROM labels",
    "q23": "SELECT doc_id, strlen(text) AS n_bytes, CASE WHEN strlen(text) < 128 THEN 1 WHEN strlen(text) < 16384 THEN 2 WHEN strlen(text) < 2097152 THEN 3 ELSE 4 END AS varint_bytes FROM documents",
    "q24": f"SELECT i // 8 AS byte_index, sum(toxic::INTEGER << (7 - i % 8)::INTEGER)::BIGINT AS byte_value, count(*) AS n_bits FROM (SELECT toxic, {ROWS} AS i FROM labels) GROUP BY 1",
    "q25": "SELECT * FROM (VALUES (0, 'a.parquet'), (1, 'sub/b.parquet'), (2, '/abs/d.pq')) v(ordinal, path)",
    "q26": "SELECT row_number() OVER (ORDER BY path) - 1 AS ordinal, path, CASE WHEN lower(path) LIKE '%.csv' THEN 'csv' WHEN lower(path) LIKE '%.manifest' THEN 'parquet-manifest' ELSE 'parquet' END AS format FROM (VALUES " + _values((p,) for p in PATHS) + ") v(path)",
    "q27": "SELECT * FROM (VALUES ('p_partkey', 'LongInteger'), ('p_name', 'String'), ('p_brand', 'String'), ('p_type', 'String'), ('p_size', 'LongInteger'), ('p_retailprice', 'Real')) v(column_name, type_name)",
    "q28": f"SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars, {ROWS} AS row_index FROM documents",
    "q29": "SELECT " + ", ".join(f"{_WIDE_SQL.get(e, e)} AS {c}" for c, e in WIDE.items()) + " FROM orders",
    "q30": "WITH n AS (SELECT count(*) AS k FROM orders) SELECT i AS slice_id, least(700, k - (i % ((k + 699) // 700)) * 700) AS n_rows FROM n, unnest(range(2 * ((k + 699) // 700))) u(i)",
    "q31": f"WITH n AS (SELECT *, {ROWS} AS i FROM customer) SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, row_number() OVER (ORDER BY c_custkey % 3, i) - 1 AS row_index FROM n",
    "q32": f"WITH n AS (SELECT *, {ROWS} AS i FROM customer) SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey % 3 DESC, i) - 1 AS row_index FROM n WHERE c_custkey % 3 <> 1",
    "q33": f"WITH {NULLS_SQL} SELECT * FROM n",
    "q34": _ONE_SQL,
    "q35": f"""WITH {NULLS_SQL}, r AS (SELECT *, row_index // 1700 AS s FROM n),
l AS (SELECT s, count(*) AS k, 7 + 2 * 3 + 10 + sum(COALESCE(strlen(event_type), 0) + 1) + 6 + 8 * count(*) + 4 + CASE WHEN count(event_type) = count(*) THEN 4 ELSE 23 + (count(*) + 7) // 8 END AS bytes FROM r GROUP BY s),
o AS (SELECT *, {layout.preamble_size(["event_type", "ts"])} + COALESCE(sum(bytes) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM l)
SELECT event_type, ts, 't' AS __sbdf_table_id, 'e.sbdf' AS __sbdf_file, s AS __sbdf_slice_id, row_index AS __sbdf_row_index, row_index - s * 1700 AS __sbdf_row_in_slice,
    s * 1700 AS __sbdf_slice_row_start, k AS __sbdf_slice_row_count, begins::BIGINT AS __sbdf_byte_offset, bytes::BIGINT AS __sbdf_byte_length FROM r JOIN o USING (s)""",
    "q36": "SELECT event_id::VARCHAR AS event_id, nullif(event_type, 'error') AS event_type, CASE WHEN event_id % 4 <> 0 THEN value END AS value FROM events",
    "q37": f"SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS value, epoch_us(ts) // 1000 + {EPOCH} AS event_time, user_id AS wafer_id FROM events",
    "q38": f"SELECT event_id, floor(epoch_us(ts - INTERVAL 80 YEARS) / 1000.0)::BIGINT + {EPOCH} AS ts, date_diff('day', DATE '0001-01-01', ts::DATE) * 86400000 AS day, nullif(event_type, 'error') AS event_type FROM events",
    "q39": f"SELECT event_id, trunc(epoch_us(ts - INTERVAL 80 YEARS) / 1000.0)::BIGINT + {EPOCH} AS ms, floor(epoch_us(ts - INTERVAL 80 YEARS) / 1000.0)::BIGINT + {EPOCH} AS floor_ms FROM events",
    "q40": "SELECT count(*) AS n_rows, (SELECT sum((k + 99) // 100)::BIGINT FROM (SELECT count(*) AS k FROM customer GROUP BY c_custkey % 3)) AS n_slices, 3 AS n_files, 2 AS asked, 2 AS used, 100 AS batch FROM customer",
    "q41": "SELECT event_id, (epoch_us(ts) - epoch_us(date_trunc('year', ts)::TIMESTAMP)) // 1000 AS since, (epoch_us(ts) % 86400000000) // 1000 AS ts FROM events",
    "q42": f"""WITH RECURSIVE e AS (SELECT {ROWS} AS i, 10 + COALESCE(strlen(props), 0) AS b FROM events),
s AS (SELECT i, i // 1700 AS k, sum(b) OVER (PARTITION BY i // 1700 ORDER BY i)::BIGINT AS t FROM e),
c(k, i, t) AS (SELECT k, min(i) - 1, 0::BIGINT FROM s GROUP BY k UNION ALL SELECT c.k, min(s.i), min(s.t) FROM c JOIN s ON s.k = c.k AND s.t >= c.t + {Q42_BYTES} GROUP BY c.k),
ends AS (SELECT k, i FROM c UNION SELECT k, max(i) FROM s GROUP BY k),
n AS (SELECT i, i - lag(i) OVER (PARTITION BY k ORDER BY i) AS n_rows FROM ends)
SELECT row_number() OVER (ORDER BY i) - 1 AS slice_id, n_rows FROM n WHERE n_rows > 0""",
    "q22": """WITH b AS (SELECT r_name, list_transform(string_split(r_name, ''), lambda x: ascii(x)::HUGEINT) AS bytes FROM region),
s AS (SELECT flatten(list(list_concat(bytes, [0::HUGEINT], list_transform(string_split('String', ''), lambda x: ascii(x)::HUGEINT), [1::HUGEINT, 0::HUGEINT]) ORDER BY r_name)) AS bytes FROM b),
f AS (SELECT r_name, b.bytes AS own, s.bytes AS whole FROM b, s)
SELECT r_name, lower(lpad(to_hex(list_reduce(own, lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT)::UBIGINT), 16, '0')) AS checksum,
    lower(lpad(to_hex(list_reduce(whole, lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT)::UBIGINT), 16, '0')) AS schema_fingerprint FROM f""",
}


def oracle_sql() -> dict[str, str]:
    return {k: SQL[k[:3]] for k in queries() if k[:3] in SQL}
