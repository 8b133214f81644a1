import datetime as dt
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera import FormatError, api, cli
from tessera import queries as own
from tessera.functions import types
from tessera.operators import sidecar
from tessera.plans import layout, policy
from tessera.sources import codec, files, sbdf
from tessera.streaming.writer import StreamingWriter, batch_sink

from .oracle import differences

SQL = own.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, small_dir, name):
    assert differences(own.queries()[name](spark, small_dir), SQL[name], small_dir) == ""


def test_csv_of_a_table_of_several_files(spark, small_dir, tmp_path):
    """Rows stand in the order of the files' names, though the later file is the larger one."""
    docs = pq.read_table(f"{small_dir}/documents.parquet")
    (tmp_path / "documents.parquet").mkdir()
    pq.write_table(docs.slice(0, 20), tmp_path / "documents.parquet" / "part-0.parquet")
    pq.write_table(docs.slice(20), tmp_path / "documents.parquet" / "part-1.parquet")
    name = "q28_convert_csv"
    assert differences(own.queries()[name](spark, str(tmp_path)), SQL[name], str(tmp_path)) == ""


def test_checksum():
    assert types.fnv1a(b"") == 0xCBF29CE484222325 and types.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def contents(path):
    with open(path, "rb") as f:
        table = codec.read_table(f)
        return table, [b for *_, b in codec.slices(f, table)]


def test_name_and_dtype_rules():
    assert types.of_name("WAFER_ID") == "LongInteger" and types.of_name("runtime") == "DateTime" and types.of_name("x") is None
    known = {"bool": "Boolean", "Int32": "Integer", "Int64": "LongInteger", "float64": "Real", "datetime64[ns]": "DateTime", "object": "String", "timedelta64[ns]": "TimeSpan", "float32": "SingleReal"}
    assert {k: types.of_dtype(k) for k in known} == known
    with pytest.raises(TypeError):
        types.of_dtype("complex128")
    with pytest.raises(TypeError):
        types.of_dtype("interval[int64]")


def test_epochs_before_1970(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'1969-12-31 23:59:59.9995' AS t").select(types.timestamp_ms(own.F.col("t")).alias("file"), types.instant_ms(own.F.col("t")).alias("python")).first()
    assert row.file == types.EPOCH_MS and row.python == types.EPOCH_MS - 1


def test_policies():
    assert [policy.adaptive_workers(*v[:3], v[3] << 20) for v in own.WORKERS] == [1, 2, 1, 3, 1, 1]
    assert policy.batch_cap(5000, 300_000, 1_070_623_282) == 5000 and policy.batch_cap(50_000, 300_000, 1_070_623_282) < 19_000 and policy.batch_cap(50_000, 0, 0) == 50_000
    for bad, error in ((True, TypeError), ("2", TypeError), (0, ValueError), (9, ValueError)):
        with pytest.raises(error):
            policy.workers(bad)


def test_layout_is_the_file(spark, tmp_path, small_dir):
    rows = own._events(spark, small_dir)
    for mode in codec.MODES:
        target = str(tmp_path / f"{mode}.sbdf")
        n, slices, size = sbdf.write(rows.select("row_index", *own.EVENT), own.EVENT, target, 170, mode)
        plan = layout.slice_layout(rows, own.EVENT, 170, mode).orderBy("slice_id").collect()
        assert len(plan) == slices and plan[-1].byte_offset + plan[-1].byte_length + 3 == size == os.path.getsize(target)
        with open(target, "rb") as f:
            found = [(at, k) for at, k, _ in codec.slices(f, codec.read_table(f))]
        assert found == [(p.byte_offset, p.byte_length) for p in plan]


@pytest.mark.parametrize("most", [1, 60, 61, 400, 10**9])
def test_slices_end_by_bytes(spark, tmp_path, most):
    kinds, batch = {"id": "LongInteger", "text": "String"}, 7
    values = [(i, None if i % 5 == 3 else "é" * (i * 13 % 29) + "x" * (300 * (i == 11))) for i in range(40)]
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "row_index bigint, id bigint, text string").repartition(3)
    n, slices, _ = sbdf.write(rows, kinds, str(tmp_path / "o.sbdf"), batch, most=most)
    want, size = [[]], 0
    for i, (key, text) in enumerate(values):
        if want[-1] and (size >= most or i % batch == 0):
            want.append([])
            size = 0
        want[-1].append((key, text))
        size += 8 + 1 + len((text or "").encode()) + 1
    _, got = contents(tmp_path / "o.sbdf")
    assert [list(zip(b["id"].to_pylist(), b["text"].to_pylist())) for b in got] == want
    assert (n, slices) == (40, len(want))


def test_csv_slices_end_by_bytes(spark, tmp_path, monkeypatch):
    src = tmp_path / "in.csv"
    src.write_text("id,text\n" + "".join(f"{i},{'y' * 50}\n" for i in range(10)))
    monkeypatch.setattr(api.policy, "BATCH_BYTES", 120)
    r = api.convert_with_result(src, tmp_path / "o.sbdf", row_key_columns=["id"], spark=spark)
    assert (r.row_count, r.slice_count) == (10, 5)
    assert pq.read_table(r.sidecar_path).column("__sbdf_slice_id").to_pylist() == [i // 2 for i in range(10)]


def test_csv(spark, tmp_path):
    src = tmp_path / "in.csv"
    src.write_text('wafer_id,event_time,flag,value,text,date\n1,1970-01-01T00:00:01,true,1.5,"first\nsecond",2024-01-02\n2,1970-01-01T00:00:02,FALSE,,"say ""hi""",\n3,1970-01-01T00:00:03,True,2,,2024-01-03\n')
    r = api.convert_with_result(src, tmp_path / "o.sbdf", batch_size=2, row_key_columns=["wafer_id"], spark=spark)
    assert (r.row_count, r.slice_count, r.effective_workers, r.effective_batch_sizes) == (3, 2, 1, (2,))
    table, got = contents(r.output_path)
    assert table.types == ["LongInteger", "DateTime", "Boolean", "Real", "String", "Date"]
    assert [v for b in got for v in b["text"].to_pylist()] == ["first\nsecond", 'say "hi"', None]
    assert got[0]["event_time"].to_pylist() == [types.EPOCH_MS + 1000, types.EPOCH_MS + 2000]
    side = pq.ParquetFile(r.sidecar_path)
    assert side.num_row_groups == 2 and side.read().column("__sbdf_slice_id").to_pylist() == [0, 0, 1]
    data = r.output_path.read_bytes()
    assert all(data[o : o + 3] == codec.SLICE for o in side.read().column("__sbdf_byte_offset").to_pylist())
    assert side.schema_arrow.metadata[b"sbdf.sidecar.version"] == b"1"


def test_csv_errors(spark, tmp_path):
    def run(text, **options):
        (tmp_path / "in.csv").write_text(text)
        return api.convert(tmp_path / "in.csv", tmp_path / "o.sbdf", spark=spark, **options)

    for text, error, options in (("a,b\n", ValueError, {}), ("a,b\n1,\n", ValueError, {}), ("a\n1\n", ValueError, {"column_types": {"z": "String"}}), ("a\n1\nx\n", FormatError, {"infer_schema_rows": 1}), ("a\n1\n", ValueError, {"delimiter": ";;"}), ("a\n1\n", TypeError, {"delimiter": 3}), ("a\n1\n", ValueError, {"batch_size": 0}), ("a\n1\n", ValueError, {"column_types": {"a": "Time"}}), ("a\n1\n", ValueError, {"sidecar_path": "x"})):
        with pytest.raises(error):
            run(text, **options)
        assert not (tmp_path / "o.sbdf").exists()
    with pytest.raises(FormatError):
        api.convert(tmp_path / "none.csv", tmp_path / "o.sbdf", spark=spark)


def test_parquet_inputs(spark, tmp_path):
    for name, ids in (("b", [3, 4]), ("a", [1, 2, 5])):
        pq.write_table(pa.table({"id": pa.array(ids, pa.int64()), "label": ["x"] * len(ids)}), tmp_path / f"{name}.parquet", row_group_size=1)
    (tmp_path / "list.manifest").write_text(f"# two\n\nb.parquet\n{tmp_path}/a.parquet\n")

    def ids(path):
        return [v for b in contents(path)[1] for v in b["id"].to_pylist()]

    out = tmp_path / "o"
    assert ids(api.convert(tmp_path / "list.manifest", out / "m.sbdf", spark=spark)) == [3, 4, 1, 2, 5]
    assert ids(api.convert(tmp_path, out / "d.sbdf", batch_size=2, spark=spark)) == [1, 2, 5, 3, 4]
    assert ids(api.parquet_files_to_sbdf([tmp_path / "b.parquet"] * 2, out / "f.sbdf", spark=spark)) == [3, 4, 3, 4]
    pq.write_table(pa.table({"id": pa.array([1], pa.int32()), "label": ["x"]}), tmp_path / "c.parquet")
    with pytest.raises(ValueError, match="differ"):
        api.convert(tmp_path, out / "e.sbdf", spark=spark)
    with pytest.raises(ValueError):
        api.convert(tmp_path / "a.parquet", tmp_path / "a.parquet", spark=spark)
    pq.write_table(pa.table({"v": [[1]]}), tmp_path / "n.parquet")
    with pytest.raises(ValueError):
        api.convert(tmp_path / "n.parquet", out / "n.sbdf", spark=spark)


def test_capped_slices(spark, tmp_path):
    pq.write_table(pa.table({"id": range(4), "p": ["x" * 10] * 4}), tmp_path / "a.parquet")
    rows = files.parquet_files(spark, [str(tmp_path / "a.parquet")] * 2, caps=[3, 2])
    got = rows.orderBy("file_ordinal", "id").collect()
    assert [r.slice_id for r in got] == [0, 0, 0, 1, 2, 2, 3, 3] and [r.row_index for r in got] == list(range(8))


@pytest.mark.parametrize("batch, slices", [(5000, 2), (3, 4)])
def test_slices_end_with_their_file(spark, tmp_path, batch, slices):
    for name in "ab":
        pq.write_table(pa.table({"id": range(4), "p": [name] * 4}), tmp_path / f"{name}.parquet")
    for workers in (None, 1, 2):
        r = api.convert_with_result(tmp_path, tmp_path / "o.sbdf", input_format="parquet-dataset", batch_size=batch, workers=workers, spark=spark)
        assert (r.row_count, r.slice_count) == (8, slices)
    with pytest.raises(ValueError):
        api.parquet_files_to_sbdf([tmp_path / "a.parquet"], tmp_path / "a.parquet", spark=spark)
    with pytest.raises(ValueError):
        api.parquet_files_to_sbdf([tmp_path / "a.parquet"], tmp_path / "x.sbdf", workers=9, spark=spark)


def test_no_command(capsys):
    assert cli.main([]) == 2


def test_formats(tmp_path):
    assert files.input_format("x.PQ") == "parquet" and files.input_format("x", "parquet_dataset") == "parquet-dataset" and files.input_format(str(tmp_path)) == "parquet-dataset"
    for path, asked in (("x.txt", "auto"), ("x.csv", "orc")):
        with pytest.raises(ValueError):
            files.input_format(path, asked)


def test_read_back(spark, tmp_path):
    df = spark.range(12).selectExpr("CAST(id AS INT) AS a", "IF(id % 3 = 0, NULL, CAST(id AS STRING)) AS b")
    api.dataframe_to_sbdf(df, tmp_path / "s.sbdf", row_key_columns=["a"])
    got = sbdf.read(spark, str(tmp_path / "s.sbdf"), columns=["b"], row_index=True)
    assert [(r.b, r.row_index) for r in got.orderBy("row_index").collect()] == [(None if i % 3 == 0 else str(i), i) for i in range(12)]


FRAMES = {
    "numbers": lambda: pd.DataFrame({"i4": np.array([1, -2, 3], "i4"), "i8": [1 << 40, 0, -1], "u1": np.array([1, 2, 255], "u1"), "f4": np.array([0.1, np.nan, np.inf], "f4"), "f8": [np.nan, -0.0, 0.0], "b": [True, False, True]}),
    "moments": lambda: pd.DataFrame({"ns": pd.to_datetime(["1969-12-31T23:59:59.999999999", None, "2024-01-02T03:04:05.678901"]), "s": np.array(["1960-01-01", "NaT", "2000-02-29"], "M8[s]"), "us": np.array(["1950-01-01T00:00:00.000001", "2020-01-01", "NaT"], "M8[us]"), "utc": pd.to_datetime(["2024-01-01", None, "1960-01-01"], utc=True), "d": pd.to_timedelta([1, None, -1], unit="ms")}),
    "texts": lambda: pd.DataFrame({"plain": ["é", "", None], "nan": ["x", np.nan, "y"], "none": [None, None, None], "kind": pd.Categorical(["a", "b", "a"]), "typed": pd.array(["x", pd.NA, ""], "string"), "binary": [b"x", None, b""]}),
    "mixed": lambda: pd.DataFrame({"text": ["a", 1, b"z"], "numbers": pd.Series([1, None, np.int64(3)], dtype="object"), "nullable": pd.array([1, pd.NA, 3], "Int64"), "flags": pd.array([True, pd.NA, False], "boolean"), "wafer_id": [1.0, 2.0, np.nan]}),
    "overridden": lambda: pd.DataFrame({"text": [1, 2, 3], "real": [1, 2, 3], "whole": [1.0, np.nan, 3.0]}),
    "none": lambda: pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="object")}),
}


@pytest.mark.parametrize("name", FRAMES)
def test_whole_columns_are_as_their_values(tmp_path, monkeypatch, name):
    types = {"text": "String", "real": "Real", "whole": "LongInteger"} if name == "overridden" else None
    for mode in ({}, {"encoding_rle": False}, {"adaptive_encoding": True}):
        files = []
        for way in ("whole", "values"):
            with monkeypatch.context() as m:
                if way == "values":
                    m.setattr(api, "_whole", lambda column, kind: None)
                try:
                    files.append(api.dataframe_to_sbdf(FRAMES[name](), tmp_path / f"{way}.sbdf", column_types=types, **mode).read_bytes())
                except (ValueError, TypeError) as e:
                    files.append(f"{type(e).__name__}: {e}")
        assert files[0] == files[1] and isinstance(files[0], bytes)


def test_pandas(tmp_path):
    df = pd.DataFrame({"n": [1, 2], "f": [1.5, float("nan")], "when": pd.to_datetime(["1970-01-01", None]), "o": [dt.date(1970, 1, 1), None], "s": ["a", None]})
    table, got = contents(api.to_sbdf(df, tmp_path / "p.sbdf"))
    assert table.types == ["LongInteger", "Real", "DateTime", "Date", "String"] and len(got) == 1
    assert got[0].to_pydict() == {"n": [1, 2], "f": [1.5, None], "when": [types.EPOCH_MS, None], "o": [types.EPOCH_MS, None], "s": ["a", None]}
    assert contents(api.to_sbdf(df[:0], tmp_path / "e.sbdf"))[1] == []
    with pytest.raises(TypeError):
        api.to_sbdf([1], tmp_path / "x.sbdf")

    class Frame(pd.DataFrame):
        pass

    assert api.register_dataframe_type(Frame) and not api.register_dataframe_type(Frame)


def test_writer(tmp_path):
    with StreamingWriter(tmp_path / "w.sbdf", column_types={"b": "Date"}) as w:
        w.write_batch({"a": [1, None], "b": [dt.date(1, 1, 1), None]})
        w.write_batch({"a": [], "b": []})
        w.write_batch({"a": [3], "b": [dt.date(1, 1, 2)]})
        with pytest.raises(ValueError):
            w.write_batch({"a": [1], "b": []})
        with pytest.raises(ValueError):
            w.write_batch({"a": [1]})
    assert [b.to_pydict() for b in contents(tmp_path / "w.sbdf")[1]] == [{"a": [1, None], "b": [0, None]}, {"a": [3], "b": [types.DAY_MS]}]
    with pytest.raises(RuntimeError):
        w.write_batch({"a": [1], "b": [None]})
    bad = StreamingWriter(tmp_path / "bad.sbdf")
    bad.write_batch({"a": [1]})
    with pytest.raises(FormatError):
        bad.write_batch({"a": ["x"]})
    bad.close()
    assert sorted(os.listdir(tmp_path)) == ["w.sbdf"]


def test_stream(spark, tmp_path):
    pq.write_table(pa.table({"id": range(30)}), tmp_path / "in.parquet")
    os.makedirs(tmp_path / "src")
    os.rename(tmp_path / "in.parquet", tmp_path / "src" / "in.parquet")
    query = spark.readStream.schema("id bigint").parquet(str(tmp_path / "src")).writeStream.foreachBatch(batch_sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(v for b in contents(tmp_path / "out" / "batch-000000000.sbdf")[1] for v in b["id"].to_pylist()) == list(range(30))


def test_sidecar_errors(tmp_path):
    with StreamingWriter(tmp_path / "w.sbdf") as w:
        w.write_batch({"a": [1], "__sbdf_file": ["x"]})
    path = str(tmp_path / "w.sbdf")
    stale = tmp_path / "w.sbdf.sidecar.parquet"
    for keys, error in ((["z"], FormatError), (["__sbdf_file"], FormatError), ([], ValueError), (["a", "a"], ValueError), ("a", TypeError)):
        stale.write_text("old")
        with pytest.raises(error):
            sidecar.generate(path, keys)
    with pytest.raises(ValueError):
        sidecar.generate(path, ["a"], path)
    assert sidecar.generate(path, ["a"]) == str(stale)


def test_cli(tmp_path, capsys, spark):
    (tmp_path / "in.csv").write_text("a;b\n1;x\n")
    assert cli.main(["convert", str(tmp_path / "in.csv"), str(tmp_path / "o.sbdf"), "--delimiter", ";", "--column-type", "a=String"]) == 0
    assert contents(tmp_path / "o.sbdf")[0].types == ["String", "String"]
    assert cli.main(["convert", str(tmp_path / "in.csv"), str(tmp_path / "o.sbdf"), "--column-type", "a=String", "--column-type", "a=Real"]) == 2
    assert cli.main(["init", str(tmp_path / "p")]) == 0 and cli.main(["init", str(tmp_path / "p")]) == 2 and cli.main(["init", str(tmp_path / "p"), "--force"]) == 0
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0
