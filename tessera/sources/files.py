"""Inputs: format resolution, CSV, Parquet files, datasets and manifests, as frames with a global row index."""

from __future__ import annotations

import csv
import itertools
import os
import re
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import NamedTuple
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import FormatError, canonical, logical, missing, of_name, resolve, stored
from ..plans.layout import BATCH
from . import spans

FORMATS = ("csv", "parquet", "parquet-dataset", "parquet-manifest")
ALIASES = {"dataset": "parquet-dataset", "manifest": "parquet-manifest"}
#: Local files are spelled with one slash or three.
LOCAL = re.compile("^file:/+")
BY_SUFFIX = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".manifest": "parquet-manifest"}


def input_format(path: str, asked: str = "auto", is_dir: bool | None = None) -> str:
    name = ALIASES.get(asked.lower().replace("_", "-"), asked.lower().replace("_", "-"))
    if name in FORMATS:
        return name
    if name != "auto":
        raise ValueError(f"unsupported input format {asked!r}")
    if os.path.isdir(path) if is_dir is None else is_dir:
        return "parquet-dataset"
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in BY_SUFFIX:
        raise ValueError(f"can't tell the input format of {path}; name one")
    return BY_SUFFIX[suffix]


def manifest_lines(text: str) -> list[str]:
    """The paths of a manifest, in order; blank lines and comments are passed over."""
    return [x for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")]


def manifest_files(path: str) -> list[str]:
    base = Path(path).parent
    return [str(p if (p := Path(x)).is_absolute() else base / p) for x in manifest_lines(Path(path).read_text())]


def dataset_files(path: str, recursive: bool = False) -> list[str]:
    """Parquet files of a folder in path order, without the indexes that stand beside table files."""
    if not os.path.isdir(path):
        raise ValueError(f"{path} is not a directory")
    found = Path(path).glob("**/*.parquet" if recursive else "*.parquet")
    return [str(p) for p in sorted(found) if p.is_file() and not p.name.endswith(".sidecar.parquet")]


class Shape(NamedTuple):
    """What a Parquet file's footer says."""

    path: str
    rows: int
    groups: int
    bytes: int
    schema: pa.Schema


def parquet_shapes(paths: list[str]) -> list[Shape]:
    """Of each file in the order given; a folder stands for its Parquet files in name order. Schemas must be the same."""
    if not paths:
        raise ValueError("no Parquet files are given")

    def shape(path: str) -> Shape:
        try:
            with pq.ParquetFile(path) as f:
                m = f.metadata
                return Shape(path, m.num_rows, m.num_row_groups, sum(m.row_group(i).total_byte_size for i in range(m.num_row_groups)), f.schema_arrow)
        except Exception as e:
            raise FormatError(f"can't read {path}: {e}") from e

    files = [f for p in map(str, paths) for f in (dataset_files(p) if os.path.isdir(p) else [p])]
    if not files:
        raise ValueError("no Parquet files are given")
    with ThreadPoolExecutor(16) as pool:
        known = dict(zip(dict.fromkeys(files), pool.map(shape, dict.fromkeys(files))))
    for f in files:
        if not known[f].schema.equals(known[files[0]].schema):
            raise ValueError(f"the schemas of {files[0]} and {f} differ")
    return [known[f] for f in files]


def parquet_files(spark: SparkSession, files: list[str], batch: int = BATCH, shapes: list[Shape] | None = None, caps: list[int] | None = None) -> DataFrame:
    """The files' rows in the order given, with file_ordinal, row_index and slice_id: slices are cut per file, at its cap. A file listed twice counts twice.

    One scan of all files, joined with a table of a row for each listed file.
    """
    shapes = shapes or parquet_shapes(files)
    caps = caps or [batch] * len(shapes)
    rows = spark.read.parquet(*dict.fromkeys(s.path for s in shapes))
    resolve(rows.schema)
    spelled = {os.path.realpath(unquote(urlparse(f).path)): LOCAL.sub("file:/", f) for f in rows.inputFiles()}
    listed, row, slice_ = [], 0, 0
    for i, (s, cap) in enumerate(zip(shapes, caps)):
        listed.append((spelled.get(os.path.realpath(s.path), s.path), i, row, slice_, cap))
        row, slice_ = row + s.rows, slice_ - (-s.rows // cap)
    table = spark.createDataFrame(listed, "_path string, file_ordinal int, _row0 bigint, _slice0 bigint, _cap bigint")
    found = rows.select("*", F.regexp_replace("_metadata.file_path", LOCAL.pattern, "file:/").alias("_path"), F.col("_metadata.row_index").alias("_row")).join(table, "_path")
    place = {"row_index": F.col("_row0") + F.col("_row"), "slice_id": F.col("_slice0") + F.call_function("div", F.col("_row"), F.col("_cap"))}
    return found.withColumns(place).drop("_path", "_row", "_row0", "_slice0", "_cap")


def _delimiter(d) -> str:
    if isinstance(d, bytes):
        d = d.decode("latin-1")
    if not isinstance(d, str):
        raise TypeError("delimiter must be text")
    if len(d.encode()) != 1:
        raise ValueError("delimiter must be one byte")
    return d


def infer_csv(path: str, rows: int = 10_000, delimiter: str = ",", header: bool = True) -> dict[str, str]:
    """Column -> logical type from the first rows: the narrowest of Boolean, LongInteger, Real, Date, DateTime that all values allow, else String."""
    if rows < 1:
        raise ValueError("infer_schema_rows must be positive")
    try:
        with open(path, newline="", encoding="utf-8") as f:
            lines = csv.reader(f, delimiter=delimiter, strict=True)
            names = next(lines, []) if header else []
            sample = [x for x in itertools.islice(lines, rows) if x]
    except (OSError, UnicodeDecodeError, csv.Error) as e:
        raise FormatError(f"can't read {path}: {e}") from e
    if not sample:
        raise ValueError("the CSV has no data rows")
    names = names or [f"column_{i + 1}" for i in range(len(sample[0]))]
    out = {}
    for i, name in enumerate(names):
        values = [r[i] for r in sample if i < len(r) and r[i] != ""]
        out[name] = infer_values(values)
    return out


def infer_values(values: list[str]) -> str | None:
    """The logical type of text values; None if there are none."""
    tests = (("Boolean", r"(?i:true|false)"), ("LongInteger", r"[+-]?\d+"), ("Real", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:[+-]?(nan|inf|infinity))"), ("Date", r"\d{4}-\d\d-\d\d"), ("DateTime", r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?"))
    if not values:
        return None
    return next((n for n, p in tests if all(re.fullmatch(p, v) for v in values)), "String")


def csv_types(inferred: dict[str, str | None], overrides: dict[str, str] | None = None) -> dict[str, str]:
    overrides = overrides or {}
    if unknown := [c for c in overrides if c not in inferred]:
        raise ValueError(f"types are given for columns that aren't there: {', '.join(unknown)}")
    out = {}
    for c, found in inferred.items():
        name = overrides.get(c) or of_name(c) or found
        if name is None:
            raise ValueError(f"column {c} has no values in the sample; give its type")
        if logical(name).name in ("Time", "TimeSpan", "Binary"):
            raise ValueError(f"{name} columns can't come from CSV")
        out[c] = name
    return out


#: How Spark parses a CSV field of each type; the rest is a cast.
_CSV_KIND = {"Boolean": T.BooleanType(), "Integer": T.IntegerType(), "LongInteger": T.LongType(), "SingleReal": T.FloatType(), "Real": T.DoubleType(), "Date": T.DateType(), "DateTime": T.TimestampNTZType(), "String": T.StringType()}


def read_csv(spark: SparkSession, path: str, types: dict[str, str], delimiter: str = ",", header: bool = True, piece: int | None = None) -> DataFrame:
    """CSV rows under a fixed schema; a bad field, or a wrong number of fields, is an error; an empty field is null. row_index is the file's order.

    A file is read in pieces of some bytes (by default as many as the session's cores share); one that can't be cut into whole records, or a folder, by
    the multi-line reader, a task a file.
    """
    schema = T.StructType([T.StructField(c, _CSV_KIND[t]) for c, t in types.items()])
    options = {"sep": _delimiter(delimiter), "escape": '"', "multiLine": "true", "mode": "FAILFAST"}
    if os.path.isfile(path) and (cut := spans.pieces(spark, path, options["sep"], piece)):
        return spans.read(spark, path, cut, schema, options, header)
    rows = spark.read.schema(schema).options(header=header, enforceSchema=False, **options).csv(path)
    return rows.withColumn("row_index", F.monotonically_increasing_id())


def canonical_rows(rows: DataFrame, types: dict[str, str], nan_missing: bool = False) -> DataFrame:
    """row_index, slice_id where there is one, and the columns as a table file stores them. nan_missing: whether NaN counts as null, as in data frames."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    index = [c for c in ("slice_id", "row_index") if c in rows.columns and c not in types]

    def cell(c: str):
        value = F.col(f"`{c}`")
        return F.when(~missing(value, kinds[c]), value) if nan_missing else value

    return rows.select(*index, *[canonical(cell(c), kinds[c], t).cast(stored(t)).alias(c) for c, t in types.items()])
