"""CSV files cut into spans of whole records, which tasks read on their own.

1. Tasks look at pieces of a file, each for both cases, that it begins outside or inside quotes: how many records begin there, and whether its
   quotes stand only where fields begin and end. A doubled quote leaves the state as it is, so the number of quotes before a piece decides the
   case; the driver sums a row a piece.
2. Tasks then read their pieces' records, a record belonging to the piece in which it begins, and Spark's own CSV parser takes the records.

A file with stray quotes, lone carriage returns, mixed line ends or a byte order mark isn't cut: what ends a record there depends on all that is before it.
"""

from __future__ import annotations

import os
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import FormatError

QUOTE, LF, CR = 0x22, 0x0A, 0x0D
BOM = b"\xef\xbb\xbf"
#: Bytes of a piece, at least and at most; between them a file is dealt over the session's cores.
LEAST, MOST = 1 << 20, 32 << 20
#: Bytes read at a time past a piece's end, for its last record, and records handed on at a time.
AHEAD, AT_ONCE = 1 << 16, 1 << 14


class Piece(NamedTuple):
    start: int
    end: int
    inside: bool  # whether it begins inside quotes
    first_row: int


def _bytes(path: str, start: int, end: int) -> np.ndarray:
    with open(path, "rb") as f:
        f.seek(start)
        return np.frombuffer(f.read(end - start), np.uint8)


def _ends(data: np.ndarray, inside: bool) -> np.ndarray:
    """Where records end: line feeds outside quotes."""
    at = np.flatnonzero(data == LF)
    return at[(np.searchsorted(np.flatnonzero(data == QUOTE), at) + inside) % 2 == 0]


def _starts(data: np.ndarray, inside: bool, begins: bool) -> np.ndarray:
    """Where records of data begin, blank lines aside. begins: whether its first byte follows a line feed, or nothing."""
    at = _ends(data, inside) + 1
    if begins and not inside:
        at = np.concatenate([[0], at])
    at = at[at < len(data)]
    following = data[np.minimum(at + 1, len(data) - 1)]
    return at[(data[at] != LF) & ~((data[at] == CR) & (following == LF) & (at + 1 < len(data)))]


def _regular(data: np.ndarray, inside: bool, delimiter: int, lead: bool, trail: bool) -> bool:
    """Whether quotes open where a field begins and close where one ends. data has a byte more before and behind, if lead and trail."""
    at = np.flatnonzero(data == QUOTE)
    at = at[(at >= lead) & (at < len(data) - trail)]
    opens = (np.arange(len(at)) + inside) % 2 == 0
    before, after = at[opens] - 1, at[~opens] + 1
    b, a = data[np.maximum(before, 0)], data[np.minimum(after, len(data) - 1)]
    # a doubled quote closes and opens again
    opened = (before < 0) | (b == delimiter) | (b == LF) | (b == QUOTE)
    closed = (after >= len(data)) | (a == delimiter) | (a == LF) | (a == CR) | (a == QUOTE)
    return bool(opened.all() and closed.all())


def _look(path: str, size: int, delimiter: int):
    def look(batches):
        for batch in batches:
            out = []
            for piece, start, end in zip(*(batch.column(c).to_pylist() for c in ("piece", "start", "end"))):
                lead, trail = int(start > 0), int(end < size)
                data = _bytes(path, start - lead, end + trail)
                own = data[lead : len(data) - trail]
                returns = np.flatnonzero(own == CR)
                pairs = int((data[np.minimum(returns + lead + 1, len(data) - 1)] == LF).sum())
                row = {"piece": piece, "quotes": int((own == QUOTE).sum()), "lone": len(returns) - pairs}
                for name, inside in (("out", False), ("in", True)):
                    ends = _ends(own, inside)
                    row[f"ends_{name}"] = len(ends)
                    row[f"pairs_{name}"] = int((data[np.maximum(ends + lead - 1, 0)] == CR).sum())
                    # the byte behind tells a blank line whose two bytes lie in two pieces
                    begun = _starts(data[lead:], inside, not lead or data[0] == LF)
                    row[f"rows_{name}"] = int((begun < len(own)).sum())
                    row[f"regular_{name}"] = _regular(data, inside, delimiter, bool(lead), bool(trail))
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, _LOOK)

    return look


_CASES = [(f"{what}_{case}", kind) for case in ("out", "in") for what, kind in (("ends", pa.int64()), ("pairs", pa.int64()), ("rows", pa.int64()), ("regular", pa.bool_()))]
_LOOK = pa.schema([("piece", pa.int64()), ("quotes", pa.int64()), ("lone", pa.int64()), *_CASES])
_LOOK_DDL = ", ".join(f"`{f.name}` {'boolean' if f.type == pa.bool_() else 'bigint'}" for f in _LOOK)


def _dealt(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A task for each row, in order."""
    return spark.createDataFrame(rows, ddl).repartitionByRange(len(rows), "piece")


def pieces(spark: SparkSession, path: str, delimiter: str, length: int | None = None) -> list[Piece] | None:
    """The pieces of a file; None if it can't be cut. An error if its last quotes are never closed."""
    size = os.path.getsize(path)
    if not size or bytes(_bytes(path, 0, 3)) == BOM or delimiter in '"\r\n':
        return None
    length = length or min(MOST, max(LEAST, -(-size // spark.sparkContext.defaultParallelism)))
    cuts = [(i, at, min(size, at + length)) for i, at in enumerate(range(0, size, length))]
    looked = _dealt(spark, cuts, "piece bigint, start bigint, end bigint").mapInArrow(_look(path, size, ord(delimiter)), _LOOK_DDL).collect()  # a row a piece
    out, quotes, row, ends, pairs = [], 0, 0, 0, 0
    for (_, start, end), r in zip(cuts, sorted(looked, key=lambda r: r.piece)):
        case = "in" if quotes % 2 else "out"
        if r.lone or not r[f"regular_{case}"]:
            return None
        out.append(Piece(start, end, case == "in", row))
        quotes, row, ends, pairs = quotes + r.quotes, row + r[f"rows_{case}"], ends + r[f"ends_{case}"], pairs + r[f"pairs_{case}"]
    if quotes % 2:
        raise FormatError(f"{path}: a quoted field is never closed")
    return out if pairs in (0, ends) else None


def _read(path: str, size: int):
    def records(start: int, end: int, inside: bool, row: int):
        lead = int(start > 0)
        data = _bytes(path, start - lead, min(size, end + AHEAD))
        at = start - lead + len(data)
        begins, data = not lead or data[0] == LF, data[lead:]
        starts = _starts(data, inside, begins)
        starts = starts[starts < end - start]
        if not len(starts):
            return
        while not len(ends := (own := _ends(data, inside))[own >= starts[-1]]) and at < size:
            more = _bytes(path, at, min(size, at + max(AHEAD, len(data))))
            data, at = np.concatenate([data, more]), at + len(more)
        stops = own[np.searchsorted(own, starts[:-1])] if len(starts) > 1 else own[:0]
        stops = np.append(stops, ends[0] if len(ends) else len(data))
        stops = stops - ((stops > 0) & (data[np.maximum(stops - 1, 0)] == CR) & (stops < len(data)))
        for lo in range(0, len(starts), AT_ONCE):
            a, b = starts[lo : lo + AT_ONCE], stops[lo : lo + AT_ONCE]
            # what lies between two records is dropped from a copy of their bytes
            part, keep = data[a[0] : b[-1]], np.zeros(int(b[-1] - a[0]) + 1, np.int8)
            np.add.at(keep, a - a[0], 1)
            np.add.at(keep, b - a[0], -1)
            text = part[np.cumsum(keep[:-1], dtype=np.int8) > 0].tobytes()
            offsets = np.concatenate([[0], np.cumsum(b - a)]).astype(np.int32)
            lines = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text)]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row + lo, row + lo + len(a))), lines], ["row_index", "line"])

    def read(batches):
        for batch in batches:
            for own in zip(*(batch.column(c).to_pylist() for c in ("start", "end", "inside", "first_row"))):
                yield from records(*own)

    return read


def read(spark: SparkSession, path: str, cut: list[Piece], schema: T.StructType, options: dict[str, str], header: bool) -> DataFrame:
    """row_index and the columns of schema, of every record but the header."""
    rows = _dealt(spark, [(i, *p) for i, p in enumerate(cut)], "piece bigint, start bigint, end bigint, inside boolean, first_row bigint")
    lines = rows.mapInArrow(_read(path, os.path.getsize(path)), "row_index bigint, line string")
    if header:
        lines = lines.where("row_index > 0").withColumn("row_index", F.col("row_index") - 1)
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    # generated, as a struct named once for each of its fields could be parsed as often
    return lines.select("row_index", F.inline(F.array(F.from_csv("line", ddl, options))))
