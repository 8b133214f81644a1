"""Each stage of the pipeline against SQL or a plain version over that stage's own input."""

import re
from collections import Counter

import duckdb

import corpus_pipeline
from tessera.llm import mixing, quality, sharding

from . import brute


def sql(text, docs_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{docs_path}/*.parquet'")
    return con.execute(text)


def test_stages(spark, small_dir, tmp_path):
    columns, paths = None, [f"{tmp_path}/documents"]
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns, bench = docs.columns, spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()
    # an exact copy, a null text and a benchmark passage in an otherwise clean document
    clean = " ".join(f"term{i}" for i in range(90))
    longest = max(bench, key=lambda r: len(r.text.split())).text
    planted = [(10**6, clean, "en", "web", 1), (10**6 + 1, clean, "en", "web", 1), (10**6 + 2, None, "en", None, 0), (10**6 + 3, f"{clean} other end {longest}" + "".join(f" more{i}" for i in range(60)), "en", "web", 1)]
    docs.union(spark.createDataFrame(planted, docs.schema)).write.parquet(paths[0])
    for name, stage in corpus_pipeline.STAGES:
        paths.append(f"{tmp_path}/{name}")
        stage(spark, spark.read.parquet(paths[-2]), small_dir).write.parquet(paths[-1])
    rows = [spark.read.parquet(p).collect() for p in paths]
    ids = [Counter(r.doc_id for r in own) for own in rows]
    assert all(spark.read.parquet(p).columns == columns for p in paths[:-1])

    assert ids[1] == Counter(r[0] for r in sql(f"SELECT doc_id FROM ({quality.OP9_SQL}) WHERE kept", paths[0]).fetchall())
    assert ids[2] == Counter(r[0] for r in brute.near_duplicates([(r.doc_id, r.text) for r in rows[1]], link=80) if r[3])
    assert 10**6 in ids[2] and 10**6 + 1 not in ids[2] and 10**6 + 2 not in ids[1]

    flat = {r.doc_id: f" {' '.join(re.findall(r'[^\W_]+', r.text.lower()))} " for r in rows[2]}
    held = {i for i, t in flat.items() if any(f" {' '.join(re.findall(r'[^\W_]+', b.text.lower()))} " in t for b in bench)}
    gone = set(ids[2]) - set(ids[3])
    assert 10**6 + 3 in held and len(held & gone) >= 0.95 * len(held) and len(gone - held) <= 1 and 10**6 in ids[3]

    mixed = {r[0]: r[1] for r in sql(f"SELECT doc_id, copies FROM ({mixing.OP2_SQL}) WHERE copies > 0", paths[3]).fetchall()}
    assert ids[4] == Counter(mixed)

    shards = sql(f"SELECT doc_id, shard, shard_bytes FROM ({sharding.OP1_SQL})", paths[4]).fetchall()
    # the SQL has a row for each document; how often each row comes is held against the mix below
    assert {(r.doc_id, r.shard, r.shard_bytes) for r in rows[5]} == set(shards)
    assert Counter(r.doc_id for r in rows[5]) == ids[4]


def test_run_is_its_stages(spark, small_dir):
    got = corpus_pipeline.run(spark, small_dir)
    assert {"doc_id", "text", "source", "shard"} <= set(got.columns) and got.count() > 0
