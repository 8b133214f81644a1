"""Conversion of CSV, Parquet and data frames into sliced table files."""

from __future__ import annotations

import datetime as dt
import os
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.types import EPOCH_MS, FormatError, logical, of_dtype, of_name, resolve
from .operators import sidecar
from .plans import policy
from .plans.layout import BATCH
from .sources import files, sbdf


@dataclass(frozen=True, slots=True)
class ConversionResult:
    """What one finished conversion did."""

    output_path: Path
    input_files: tuple[Path, ...]
    requested_workers: int
    effective_workers: int
    requested_batch_size: int
    effective_batch_sizes: tuple[int, ...]
    row_count: int
    slice_count: int
    sidecar_path: Path | None


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _mode(encoding_rle: bool, adaptive_encoding: bool) -> str:
    return "adaptive" if adaptive_encoding else "rle" if encoding_rle else "plain"


def _index(output: str, keys, sidecar_path, table_id) -> Path | None:
    if keys is None:
        return None
    return Path(sidecar.generate(output, list(keys), sidecar_path, table_id))


def _inputs(path: str, kind: str, recursive: bool) -> list[str]:
    if kind == "parquet-dataset":
        return files.dataset_files(path, recursive)
    return files.manifest_files(path) if kind == "parquet-manifest" else [path]


@dataclass(frozen=True, slots=True)
class _Encoding:
    """What every conversion is asked for."""

    batch: int
    types: dict[str, str] | None
    mode: str
    keys: list[str] | None
    sidecar: str | None
    table_id: str | None


def _checked(target: str, paths: list[str], batch_size, column_types, encoding_rle, adaptive_encoding, keys, sidecar_path, table_id) -> _Encoding:
    if isinstance(batch_size, bool) or not isinstance(batch_size, int) or batch_size < 1:
        raise ValueError("batch_size must be positive")
    sidecar.check_request(target, keys, sidecar_path, table_id)
    if any(os.path.realpath(p) == os.path.realpath(target) for p in paths):
        raise ValueError("input and output are the same file")
    return _Encoding(batch_size, column_types, _mode(encoding_rle, adaptive_encoding), keys, sidecar_path, table_id)


def _written(rows: DataFrame, types: dict[str, str], target: str, how: _Encoding, tasks: int | None, most: int | None = None) -> tuple[int, int]:
    """(rows, slices) of the table file that is now there."""
    try:
        n, slices, _ = sbdf.write(files.canonical_rows(rows, types), types, target, how.batch, how.mode, tasks, most)
    except (ValueError, TypeError, FormatError):
        raise
    except Exception as e:
        raise FormatError(str(e).split("\n\nJVM stacktrace")[0]) from e
    return n, slices


def _from_parquet(spark: SparkSession | None, paths: list[str], target: str, how: _Encoding, workers: int | None, adaptive: bool) -> ConversionResult:
    asked = policy.workers(3 if workers is None else workers)
    shapes = files.parquet_shapes(paths)
    caps = [policy.batch_cap(how.batch, s.rows, s.bytes) for s in shapes]
    used = policy.adaptive_workers(asked, sum(s.groups for s in shapes), max(s.groups for s in shapes), sum(s.bytes for s in shapes)) if adaptive else asked
    rows = files.parquet_files(spark or session(), paths, how.batch, shapes, caps)
    types = resolve(rows.drop("file_ordinal", "row_index", "slice_id").schema, how.types)
    # workers given by name bound the tasks that encode; else Spark's own parallelism holds
    n, slices = _written(rows, types, target, how, None if workers is None else used)
    return ConversionResult(Path(target), tuple(Path(s.path) for s in shapes), asked, used, how.batch, tuple(caps), n, slices, _index(target, how.keys, how.sidecar, how.table_id))


def convert_with_result(
    input_path,
    output_path,
    *,
    input_format: str = "auto",
    batch_size: int = BATCH,
    column_types: dict[str, str] | None = None,
    encoding_rle: bool = True,
    adaptive_encoding: bool = False,
    workers: int | None = None,
    adaptive_workers: bool = True,
    infer_schema_rows: int = 10_000,
    delimiter: str = ",",
    has_header: bool = True,
    recursive: bool = False,
    row_key_columns=None,
    sidecar_path=None,
    table_id: str | None = None,
    spark: SparkSession | None = None,
) -> ConversionResult:
    """Writes output_path from a CSV file, a Parquet file, a folder of Parquet files or a manifest. Slices are cut per file, so they don't depend on workers."""
    source, target = str(input_path), str(output_path)
    kind = files.input_format(source, input_format)
    asked = policy.workers(workers if workers is not None else 1 if kind == "csv" else 3)
    paths = _inputs(source, kind, recursive)
    how = _checked(target, paths, batch_size, column_types, encoding_rle, adaptive_encoding, row_key_columns, sidecar_path, table_id)
    if kind != "csv":
        return _from_parquet(spark, paths, target, how, workers, adaptive_workers)
    types = files.csv_types(files.infer_csv(source, infer_schema_rows, files._delimiter(delimiter), has_header), column_types)
    rows = files.read_csv(spark or session(), source, types, delimiter, has_header)
    n, slices = _written(rows, types, target, how, None if workers is None else asked, policy.BATCH_BYTES)
    return ConversionResult(Path(target), tuple(map(Path, paths)), asked, asked, batch_size, (batch_size,), n, slices, _index(target, row_key_columns, sidecar_path, table_id))


def convert(input_path, output_path, **options) -> Path:
    return convert_with_result(input_path, output_path, **options).output_path


def csv_to_sbdf(input_path, output_path, **options) -> Path:
    return convert(input_path, output_path, input_format="csv", **options)


def parquet_to_sbdf(input_path, output_path, **options) -> Path:
    return convert(input_path, output_path, input_format="parquet", **options)


def parquet_dataset_to_sbdf(input_path, output_path, **options) -> Path:
    return convert(input_path, output_path, input_format="parquet-dataset", **options)


def parquet_manifest_to_sbdf(input_path, output_path, **options) -> Path:
    return convert(input_path, output_path, input_format="parquet-manifest", **options)


def parquet_files_to_sbdf(
    paths,
    output_path,
    *,
    batch_size: int = BATCH,
    column_types=None,
    encoding_rle: bool = True,
    adaptive_encoding: bool = False,
    workers: int | None = None,
    adaptive_workers: bool = True,
    row_key_columns=None,
    sidecar_path=None,
    table_id=None,
    spark: SparkSession | None = None,
) -> Path:
    """The files' rows in the order given, one table file."""
    target, listed = str(output_path), [str(p) for p in paths]
    how = _checked(target, listed, batch_size, column_types, encoding_rle, adaptive_encoding, row_key_columns, sidecar_path, table_id)
    return _from_parquet(spark, listed, target, how, workers, adaptive_workers).output_path


def dataframe_to_sbdf(df, output_path, *, column_types: dict[str, str] | None = None, encoding_rle: bool = True, adaptive_encoding: bool = False, row_key_columns=None, sidecar_path=None, table_id=None) -> Path:
    """A pandas, Polars or like frame as one slice; a Spark frame in slices of the usual size, in its own order."""
    target = str(output_path)
    sidecar.check_request(target, row_key_columns, sidecar_path, table_id)
    overrides = column_types or {}
    if isinstance(df, DataFrame):
        types = resolve(df.schema, overrides, by_name=True)
        sbdf.write(files.canonical_rows(_numbered(df), types, nan_missing=True), types, target, BATCH, _mode(encoding_rle, adaptive_encoding))
    else:
        _frame(df, target, overrides, encoding_rle, adaptive_encoding)
    _index(target, row_key_columns, sidecar_path, table_id)
    return Path(target)


to_sbdf = dataframe_to_sbdf


def _numbered(df: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    df = df.withColumn("_id", F.monotonically_increasing_id())
    df = df.withColumn("_part", F.shiftright("_id", 33))
    counts = df.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return df.join(starts, "_part").withColumn("row_index", F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_start")


def _frame(df, target: str, overrides: dict[str, str], rle: bool, adaptive: bool) -> None:
    from .streaming.writer import StreamingWriter, _missing, infer_value, stored_array

    if not all(hasattr(df, x) for x in ("columns", "dtypes")) or not (hasattr(df, "to_dict") or hasattr(df, "to_pylist")):
        raise TypeError("a data frame needs columns, dtypes and to_dict")
    names = [str(c) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError("column names must differ")
    if unknown := [c for c in overrides if c not in names]:
        raise ValueError(f"types are given for columns that aren't there: {', '.join(unknown)}")
    dtypes = dict(zip(names, map(str, df.dtypes)))
    pandas = type(df).__module__.startswith("pandas")
    if type(df).__module__.startswith("polars"):
        data = df.to_dict(as_series=False)
    else:
        data = {} if pandas else {str(k): v for k, v in df.to_dict("list").items()}

    def values(c: str) -> list:
        if c not in data:
            data[c] = next(iter(df.iloc[:, [names.index(c)]].to_dict("list").values()))
        return data[c]

    types = {}
    for c in names:
        if c in overrides:
            types[c] = logical(overrides[c]).name
        elif of_name(c):
            types[c] = of_name(c)
        elif dtypes[c] == "object" and (known := next((v for v in values(c) if not _missing(v)), None)) is not None:
            types[c] = infer_value(known)
        else:
            types[c] = of_dtype(dtypes[c])

    def stored(at: int, c: str) -> pa.Array:
        whole = _whole(df.iloc[:, at], types[c]) if pandas else None
        return stored_array(c, [None if _missing(v) else coerce(v, types[c]) for v in values(c)], types[c]) if whole is None else whole

    arrays = [stored(i, c) for i, c in enumerate(names)]
    with StreamingWriter(target, names, types, rle, adaptive) as w:
        w.open([types[c] for c in names])
        if arrays and len(arrays[0]):
            w.write_arrays(arrays)


#: Types whose values a pandas column of some dtype kind and width already holds as they are stored.
_AS_STORED = {("b", 1): "Boolean", ("i", 4): "Integer", ("i", 8): "LongInteger", ("f", 4): "SingleReal", ("f", 8): "Real"}


def _whole(column, name: str) -> pa.Array | None:
    """A pandas column as stored, if its dtype is its type's own; else None."""
    kind, width = getattr(column.dtype, "kind", ""), getattr(column.dtype, "itemsize", 0)
    if isinstance(column.dtype, np.dtype) and _AS_STORED.get((kind, width)) == name:
        return pa.array(column.to_numpy(), sbdf.codec.arrow_type(name), from_pandas=True)
    if isinstance(column.dtype, np.dtype) and kind == "M" and name == "DateTime":
        unit, count = np.datetime_data(column.dtype)
        per_ms = {"ns": 1_000_000, "us": 1000, "ms": 1}.get(unit)
        if per_ms and count == 1:
            at = column.to_numpy()
            return pa.array(at.view(np.int64) // per_ms + EPOCH_MS, mask=np.isnat(at))
    if name == "String":
        try:
            text = pa.array(column, from_pandas=True)
        except (pa.ArrowInvalid, pa.ArrowTypeError):
            return None
        if not isinstance(text, pa.ChunkedArray) and (pa.types.is_string(text.type) or pa.types.is_large_string(text.type)):
            return text.cast(pa.string())
    return None


def _boolean(v) -> bool:
    known = {"true": True, "1": True, "false": False, "0": False}
    try:
        return known[v.strip().lower()] if isinstance(v, str) else bool(v)
    except KeyError:
        raise ValueError(f"not a boolean: {v}") from None


def _datetime(v) -> dt.datetime:
    if isinstance(v, str):
        return dt.datetime.fromisoformat(v[:-1] + "+00:00" if v.endswith("Z") else v)
    return v if isinstance(v, dt.datetime) else dt.datetime.combine(v, dt.time())


def _part(kind: type, of_datetime: str):
    """Dates and times: from text, or as a part of a point in time."""
    return lambda v: kind.fromisoformat(v) if isinstance(v, str) else getattr(v, of_datetime)() if isinstance(v, dt.datetime) else v


#: How a Python value becomes one of its column's logical type.
CONVERTERS = {
    "Boolean": _boolean,
    "Integer": int,
    "LongInteger": int,
    "SingleReal": float,
    "Real": float,
    "String": str,
    "Binary": lambda v: bytes(v) if isinstance(v, (bytes, bytearray)) else str(v).encode(),
    "DateTime": _datetime,
    "Date": _part(dt.date, "date"),
    "Time": _part(dt.time, "time"),
    "TimeSpan": lambda v: v if isinstance(v, dt.timedelta) else dt.timedelta(seconds=float(v)),
}


def coerce(v, name: str):
    """A Python value as one of its column's type. pandas' own points and spans of time count as Python's."""
    plain = getattr(v, "to_pydatetime", None) or getattr(v, "to_pytimedelta", None)
    return CONVERTERS[name](plain() if plain and name in ("DateTime", "Date", "Time", "TimeSpan") else v)


def generate_sidecar(path, *, row_key_columns, sidecar_path=None, table_id=None) -> Path:
    return Path(sidecar.generate(str(path), row_key_columns, sidecar_path, table_id))


def register_dataframe_type(cls: type, overwrite: bool = False) -> bool:
    """Gives a data-frame class a to_sbdf method. False if it has one of another origin and overwrite isn't set."""
    if hasattr(cls, "to_sbdf") and not overwrite:
        return False
    cls.to_sbdf = lambda self, output_path, **options: dataframe_to_sbdf(self, output_path, **options)
    return True


def install_dataframe_methods(overwrite: bool = False) -> tuple[str, ...]:
    """Gives the data-frame classes installed here a to_sbdf method; only on request."""
    done = []
    for module, name in (("pandas", "DataFrame"), ("polars", "DataFrame"), ("pyspark.sql", "DataFrame")):
        try:
            cls = getattr(__import__(module, fromlist=[name]), name)
        except ImportError:
            continue
        if register_dataframe_type(cls, overwrite):
            done.append(f"{module}.{name}")
    return tuple(done)
