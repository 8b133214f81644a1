"""Sliced table files as a sink and a Spark data source.

Sink: rows are dealt by blocks of ``BLOCK`` consecutive slices; each task sorts its rows, encodes one slice at a time and writes a fragment a block
into a folder beside the target, which executors and driver must share. A repeated task replaces its own fragments. The driver gets a row a
fragment and copies fragments, never rows, in order into a file beside the target that then takes the target's name. Source: the driver
walks slice headers, tasks decode ranges of slices, reading payloads of wanted columns only.
"""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.types import FormatError, stored
from ..plans.layout import BATCH, slice_of
from . import codec


#: Slices of a fragment, and bytes that a source's task reads at least (but for a small file, which is dealt over TASKS).
BLOCK, TASK_BYTES, TASKS = 16, 4 << 20, 8


def publish(target: str, pieces) -> int:
    """Writes the pieces (bytes, or paths of files to copy) to a file beside target and moves it there; on any error target is left as it was. Returns its bytes."""
    target = os.path.abspath(target)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    partial = f"{target}.{uuid.uuid4().hex}.partial"
    try:
        with open(partial, "wb") as f:
            for p in pieces:
                if isinstance(p, bytes):
                    f.write(p)
                else:
                    with open(p, "rb") as own:
                        shutil.copyfileobj(own, f, 1 << 20)
            f.flush()
            os.fsync(f.fileno())
            size = f.tell()
        os.replace(partial, target)
    except BaseException:
        Path(partial).unlink(missing_ok=True)
        raise
    return size


def cuts_by_bytes(sizes: np.ndarray, held: int, most: int) -> list[int]:
    """After which of the rows (how many lead up to it) a slice ends, each with the row whose bytes bring it to most. held: bytes the slice has before these rows."""
    total, out, goal = np.cumsum(sizes), [], most - held
    while (at := int(np.searchsorted(total, goal))) < len(total):
        out.append(at + 1)
        goal = int(total[at]) + most
    return out


def fragments(rows: DataFrame, types: dict[str, str], folder: str, mode: str, tasks: int | None = None, most: int | None = None) -> DataFrame:
    """rows: slice_id, row_index and canonical columns. Writes fragments into folder; (block, path, n_rows, n_slices) of each. tasks: how many encode at a time.

    most: bytes of values at which a slice ends early. The rows of one slice_id then make several slices; a task holds no more than one of them.
    """
    names, kinds = [f"c{i}" for i in range(len(types))], list(types.values())
    block = F.call_function("div", F.col("slice_id"), F.lit(BLOCK).cast("bigint"))
    cells = rows.select(block.alias("block"), "slice_id", "row_index", *[F.col(f"`{c}`").alias(n) for c, n in zip(types, names)])
    dealt = cells.repartition(tasks, "block") if tasks else cells.repartition("block")

    def write(batches):
        held, size, done, f = [], 0, None, None

        def flush():
            nonlocal size
            size = 0
            slice_ = pa.Table.from_batches(held).combine_chunks()
            f.write(codec.encode_slice(slice_.select(names), kinds, mode))
            done[2], done[3] = done[2] + slice_.num_rows, done[3] + 1
            held.clear()

        def finish():
            f.close()
            os.replace(f.name, done[1])
            return pa.RecordBatch.from_pylist([dict(zip(("block", "path", "n_rows", "n_slices"), done))], _FRAGMENT)

        for b in batches:
            ids = b.column("slice_id").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                own = b.slice(lo, hi - lo)
                if held and held[-1].column("slice_id")[0].as_py() != ids[lo]:
                    flush()
                at = int(ids[lo]) // BLOCK
                if done is None or done[0] != at:
                    if done is not None:
                        yield finish()
                    path = f"{folder}/{at}.fragment"
                    f, done = open(f"{path}.{uuid.uuid4().hex}", "wb"), [at, path, 0, 0]
                if most:
                    sizes, start = codec.decoded_bytes(own.select(names), kinds), 0
                    for stop in cuts_by_bytes(sizes, size, most):
                        held.append(own.slice(start, stop - start))
                        flush()
                        start = stop
                    own, size = own.slice(start), size + int(sizes[start:].sum())
                if own.num_rows:
                    held.append(own)
        if held:
            flush()
        if done is not None:
            yield finish()

    return dealt.sortWithinPartitions("slice_id", "row_index").mapInArrow(write, "block bigint, path string, n_rows bigint, n_slices bigint")


_FRAGMENT = pa.schema([("block", pa.int64()), ("path", pa.string()), ("n_rows", pa.int64()), ("n_slices", pa.int64())])


def write(rows: DataFrame, types: dict[str, str], target: str, batch: int = BATCH, mode: str = "adaptive", tasks: int | None = None, most: int | None = None) -> tuple[int, int, int]:
    """(rows, slices, bytes) written. rows: row_index, canonical columns and perhaps slice_id; without it a slice is batch rows. most: as for fragments."""
    if mode not in codec.MODES:
        raise ValueError(f"encoding must be one of {', '.join(codec.MODES)}")
    if "slice_id" not in rows.columns or "slice_id" in types:
        rows = rows.withColumn("slice_id", slice_of(F.col("row_index"), batch))
    folder = f"{os.path.abspath(target)}.{uuid.uuid4().hex}.fragments"
    os.makedirs(folder)
    try:
        done = sorted(tuple(r) for r in fragments(rows, types, folder, mode, tasks, most).collect())  # a row for each BLOCK slices
        size = publish(target, [codec.preamble(list(types), list(types.values())), *(r[1] for r in done), codec.END])
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return sum(r[2] for r in done), sum(r[3] for r in done), size


class _Range(InputPartition):
    def __init__(self, start: int, count: int, rows: int):
        super().__init__((start, count))
        self.start, self.count, self.rows = start, count, rows


class _Slices(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.columns = [c for c in options.get("columns", "").split(",") if c] or None
        self.index = options.get("rowindex", "false").lower() == "true"
        self.per_task = int(options.get("slicespertask", "0"))

    def partitions(self):
        out, rows, size = [], 0, 0
        with open(self.path, "rb") as f:
            table = codec.read_table(f)
            enough = max(1 << 16, min(TASK_BYTES, os.fstat(f.fileno()).st_size // TASKS))
            for at, length, n in codec.slice_spans(f, table):
                if not out or (out[-1].count >= self.per_task if self.per_task else size >= enough):
                    out.append(_Range(at, 0, rows))
                    size = 0
                out[-1].count += 1
                rows, size = rows + n, size + length
        return out or [_Range(table.first, 0, 0)]

    def read(self, part):
        with open(self.path, "rb") as f:
            table = codec.read_table(f)
            f.seek(part.start)
            row = part.rows
            for _ in range(part.count):
                batch = codec.read_slice(f, table, self.columns)
                if self.index:
                    batch = batch.append_column("row_index", pa.array(np.arange(row, row + batch.num_rows)))
                row += batch.num_rows
                yield batch


class SbdfSource(DataSource):
    """spark.read.format("sbdf").option("columns", "a,b").option("rowIndex", "true").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "sbdf"

    def schema(self) -> str:
        with open(self.options["path"], "rb") as f:
            table = codec.read_table(f)
        wanted = [c for c in self.options.get("columns", "").split(",") if c] or table.names
        kinds = dict(zip(table.names, table.types))
        if gone := [c for c in wanted if c not in kinds]:
            raise FormatError(f"no column {', '.join(gone)}")
        index = ["`row_index` bigint"] if self.options.get("rowIndex", "false").lower() == "true" else []
        return ", ".join([*(f"`{c}` {stored(kinds[c])}" for c in wanted), *index])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Slices(dict(self.options))


def read(spark: SparkSession, path: str, columns: list[str] | None = None, row_index: bool = False) -> DataFrame:
    spark.dataSource.register(SbdfSource)
    reader = spark.read.format("sbdf").option("rowIndex", str(row_index).lower())
    if columns:
        reader = reader.option("columns", ",".join(columns))
    return reader.load(path)
