"""The eleven logical types of a sliced table file, and how inputs get theirs: explicit override, then name rule, then inference."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FormatError(RuntimeError):
    """A file or value that the format can't hold or that isn't what it says."""


class Logical(NamedTuple):
    name: str
    id: int
    width: int  # bytes of a value in memory; 0: variable


#: Fixed values of the file format: name, type id, width.
CATALOG = {
    t.name: t
    for t in (
        Logical("Boolean", 0x01, 1),
        Logical("Integer", 0x02, 4),
        Logical("LongInteger", 0x03, 8),
        Logical("SingleReal", 0x04, 4),
        Logical("Real", 0x05, 8),
        Logical("DateTime", 0x06, 8),
        Logical("Date", 0x07, 8),
        Logical("Time", 0x08, 8),
        Logical("TimeSpan", 0x09, 8),
        Logical("String", 0x0A, 0),
        Logical("Binary", 0x0C, 0),
    )
}
BY_ID = {t.id: t for t in CATALOG.values()}
TEMPORAL = ("DateTime", "Date", "Time", "TimeSpan")
#: Days and milliseconds from 0001-01-01 to 1970-01-01.
EPOCH_DAYS, DAY_MS = 719_162, 86_400_000
EPOCH_MS = EPOCH_DAYS * DAY_MS
#: Spark's types of the values a file holds; temporal ones are milliseconds.
STORED = {"Boolean": "boolean", "Integer": "int", "SingleReal": "float", "Real": "double", "String": "string", "Binary": "binary"}


def logical(name: str) -> Logical:
    if name not in CATALOG:
        raise ValueError(f"unknown logical type {name!r}; known: {', '.join(CATALOG)}")
    return CATALOG[name]


def stored(name: str) -> str:
    return STORED.get(name, "bigint")


def of_name(column: str) -> str | None:
    """The name rule: wafer_id is a LongInteger, a name with time in it a DateTime."""
    low = column.lower()
    return "LongInteger" if low == "wafer_id" else "DateTime" if "time" in low else None


def of_dtype(dtype: str) -> str:
    """The logical type of a data frame's dtype string."""
    d = dtype.lower()
    rules = (
        (d in ("bool", "boolean"), "Boolean"),
        ("datetime" in d or d.startswith("timestamp"), "DateTime"),
        (d == "date", "Date"),
        (d == "time", "Time"),
        ("timedelta" in d or d.startswith("duration"), "TimeSpan"),
        (d in ("int8", "int16", "int32", "uint8", "uint16"), "Integer"),
        (d.startswith(("int", "uint")) and not d.startswith("interval"), "LongInteger"),
        (d == "float32", "SingleReal"),
        (d.startswith("float"), "Real"),
        ("binary" in d or "bytes" in d, "Binary"),
        (d in ("object", "string", "str", "utf8", "category", "categorical", "enum", "null"), "String"),
    )
    for fits, name in rules:
        if fits:
            return name
    raise TypeError(f"no logical type for dtype {dtype!r}; name one in column_types")


def of_spark(kind: T.DataType) -> str:
    """The logical type of a column of a file; nested and null types are refused."""
    plain = {T.BooleanType: "Boolean", T.ByteType: "Integer", T.ShortType: "Integer", T.IntegerType: "Integer", T.LongType: "LongInteger", T.FloatType: "SingleReal", T.DoubleType: "Real", T.DateType: "Date", T.TimestampType: "DateTime", T.TimestampNTZType: "DateTime", T.StringType: "String", T.BinaryType: "Binary", T.DayTimeIntervalType: "TimeSpan"}
    if isinstance(kind, T.DecimalType):
        return "LongInteger" if kind.precision == 20 and kind.scale == 0 else "Real"
    if type(kind).__name__ == "TimeType":
        return "Time"
    for k, name in plain.items():
        if isinstance(kind, k):
            return name
    raise ValueError(f"a column of type {kind.simpleString()} can't be held")


def resolve(schema: T.StructType, overrides: dict[str, str] | None = None, by_name: bool = False) -> dict[str, str]:
    """Column -> logical type. by_name: whether the name rule applies (text and data-frame inputs, not Parquet)."""
    overrides = overrides or {}
    if unknown := [c for c in overrides if c not in schema.names]:
        raise ValueError(f"types are given for columns that aren't there: {', '.join(unknown)}")
    return {f.name: logical(overrides[f.name]).name if f.name in overrides else (by_name and of_name(f.name)) or of_spark(f.dataType) for f in schema.fields}


def date_ms(c: Column) -> Column:
    return (F.unix_date(c).cast("bigint") + EPOCH_DAYS) * DAY_MS


def timestamp_ms(c: Column) -> Column:
    """Milliseconds since year 1; below a millisecond towards 1970, as whole units are divided."""
    return _div(F.unix_micros(c.cast("timestamp")), 1000) + EPOCH_MS


def _div(a: Column, by: int) -> Column:
    """Whole division towards zero."""
    return F.call_function("div", a, F.lit(by).cast("bigint"))


def instant_ms(c: Column) -> Column:
    """As timestamp_ms, for values from Python: below a millisecond always down."""
    return F.unix_millis(c.cast("timestamp")) + EPOCH_MS


def time_of_day_ms(micros: Column) -> Column:
    """Milliseconds of the day from microseconds since 1970."""
    return _div(F.pmod(micros, F.lit(DAY_MS * 1000)), 1000)


def boolean_of(c: Column) -> Column:
    """true, 1, false and 0 in any case; other text is an error; null stays."""
    t = F.lower(F.trim(c))
    return F.when(c.isNull(), F.lit(None).cast("boolean")).when(t.isin("true", "1"), F.lit(True)).when(t.isin("false", "0"), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean"))


def canonical(c: Column, kind: T.DataType, name: str) -> Column:
    """A column as the file stores it under a logical type: a real cast, never a relabelling."""
    if name == "DateTime":
        return c.cast("bigint") if isinstance(kind, T.IntegralType) else timestamp_ms(c.cast("timestamp"))
    if name == "Date":
        return c.cast("bigint") if isinstance(kind, T.IntegralType) else date_ms(c.cast("date"))
    if name == "Time":
        if isinstance(kind, T.IntegralType):
            return c.cast("bigint")
        if type(kind).__name__ == "TimeType":
            return (F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint") * 1000 + _div((F.call_function("extract", F.lit("SECOND"), c) * 1_000_000).cast("bigint"), 1000)
        return time_of_day_ms(F.unix_micros(c.cast("timestamp")))
    if name == "TimeSpan":
        if isinstance(kind, T.IntegralType):
            return c.cast("bigint")
        return _div((F.call_function("extract", F.lit("DAY"), c).cast("bigint") * 86_400_000_000 + F.call_function("extract", F.lit("HOUR"), c).cast("bigint") * 3_600_000_000 + F.call_function("extract", F.lit("MINUTE"), c).cast("bigint") * 60_000_000 + (F.call_function("extract", F.lit("SECOND"), c) * 1_000_000).cast("bigint")), 1000)
    if name == "Boolean" and isinstance(kind, T.StringType):
        return boolean_of(c)
    if name == "Binary" and isinstance(kind, T.StringType):
        return F.encode(c, "utf-8")
    return c.cast(stored(name))


def varint_size(n: Column) -> Column:
    """Bytes of a length in groups of seven bits."""
    return F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).when(n < 1 << 28, 4).otherwise(5)


def missing(c: Column, kind: T.DataType) -> Column:
    """Missing in a data frame: null, or NaN."""
    return c.isNull() | F.isnan(c) if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else c.isNull()


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return h


def fingerprint(types: dict[str, str], encoding_rle: bool = True, adaptive_encoding: bool = False) -> int:
    """A checksum of a table's columns, their types and how they are encoded."""
    flags = bytes([encoding_rle, adaptive_encoding])
    return fnv1a(b"".join(c.encode() + b"\0" + t.encode() + flags for c, t in types.items()))
