"""Operators with SQL against it on the smallest table; others against brute force, round trips or held-out rows; odd inputs for all."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontamination, licenses, mixing, quality, queries, sharding, toxicity, urls

from ..oracle import differences

SQL = queries.oracle_sql()
ODD = [(1, "a", "s"), (1, "a", "s"), (2, None, None), (3, "", "s"), (4, "x y " * 4000, "t"), (None, "free text", None), (5, "é ß\x1cz\t\n", "t")]


def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, text string, source string")
    return df.selectExpr("*", "7 AS shard", "8 AS `_doc`", "9 AS size", "10 AS copies", "'k' AS host")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, small_dir, name):
    assert differences(queries.queries()[name](spark, small_dir), SQL[name], small_dir) == ""


def test_odd_rows(spark):
    docs = odd(spark)
    for f in (sharding.op1, mixing.op2, quality.op9, licenses.op10):
        assert f(docs).count() == len(ODD) and f(docs.where("false")).count() == 0
    assert quality.keep_good(docs).columns == docs.columns and mixing.mix_documents(docs).columns == docs.columns


def test_shards_fit(spark):
    docs = spark.range(400).selectExpr("IF(id < 150, 7, id) AS doc_id", "repeat('x', CAST(id % 40 AS INT)) AS text").union(spark.sql("SELECT 9999L, repeat('y', 500)"))
    got = sharding.shard(docs, 300).groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.max("shard_bytes").alias("said"), F.max("oversize").alias("big")).collect()
    assert all(r.b == r.said and (r.b <= 300 or r.big) for r in got) and sum(r.big for r in got) == 1


def test_mix_copies(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    decided = {r.doc_id: r for r in mixing.op2(docs).collect()}
    got = {r.doc_id: r["count"] for r in mixing.mix_documents(docs).groupBy("doc_id").count().collect()}
    assert got == {i: r.copies for i, r in decided.items() if r.copies}
    assert all(r.taken <= 3 * r.size for r in decided.values())
    for s in {r.source for r in decided.values()}:
        own = [r for r in decided.values() if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://Listed.example.org/A/?q"), (4, "https://listed.example.org/A#x"), (5, "http://notexample.com/en/"), (6, "http://example.com"), (7, "http://x.example.com/en/1"), (8, "a://www.example.com/en/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.op3(spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "IF(page_id IN (1, 3), '<title>a ### b</title>', '<title>a</title>###') AS html", "'x' AS host", "1 AS url_key")).collect()}
    assert got[1] == got[2] == ("", "", None, "allow") and got[3][3] == got[4][3] == "block" and got[5][2:] == ("com/", "allow")
    assert got[6] == ("example.com", "", None, "allow") and got[7][2:] == ("example.com/en/", "block") and got[8][2:] == ("www.example.com/en/", "allow")


def test_chat_round_trip(spark):
    texts = ["<|end|>", "<\\|end|>", "<\\\\|text|>x", "[INST]", "</s>", None, "a\n<|start|>", "<", "\\"]
    rows = [(i % 2, i, ("user", "assistant", "assistant", "<|text|>")[i % 4], t) for i, t in enumerate(texts)]
    done = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    for r in done.select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss")).collect():
        own = [(x[2], x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [tuple(t) for t in r.turns] == own and r.loss == "".join(t for role, t in own if role == "assistant")


def test_licenses(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(-1, "CC-BY-NC cc by nc; under the MIT license"), (-2, "Copyright (c) 2020 A. Body, all rights reserved")]
    got = {r.doc_id: r for r in licenses.op10(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [(p, k) for phrase, k in licenses.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({k for _, k in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None)) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[-2].labels == "all-rights-reserved"


def test_automaton():
    a = licenses.compiled("grant <<opt>>all <<opt>>of<</opt>> <</opt>>rights <<var;max=2>> here")
    for text, fits in (("grant rights here", 1), ("grant all rights x y here", 1), ("grant all of rights x here", 1), ("grant of rights here", 0), ("grant rights x y z here", 0)):
        assert (a.accepts_from(licenses.word_hash(text.split()), 0) >= 0) == bool(fits)


def test_toxicity_held_out(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 4 != 0"))
    got = toxicity.score(docs, model).join(labels.where("doc_id % 4 = 0").select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    assert sum(r.toxic == (r.y == 1) for r in got) >= 0.93 * len(got)
    assert list(model.thresholds) == sorted(model.thresholds)


def test_decontamination(spark, small_dir):
    docs, bench = spark.read.parquet(f"{small_dir}/documents.parquet"), spark.read.parquet(f"{small_dir}/benchmark.parquet")
    items = {r.item_id: re.findall(r"[^\W_]+", r.text.lower()) for r in bench.collect()}
    words = items[max(items, key=lambda k: len(items[k]))]
    changed = " ".join(["opening", "words"] + [w for i, w in enumerate(words) if i % 9 != 4] + ["closing"])
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(-5, changed), (-6, None)], "doc_id bigint, text string"))
    got = {(r.doc_id, r.item_id) for r in decontamination.op7(docs, bench).collect()}
    flat = {r.doc_id: f" {' '.join(re.findall(r'[^\W_]+', (r.text or '').lower()))} " for r in docs.collect()}
    truth = {(d, k) for d, t in flat.items() for k, w in items.items() if f" {' '.join(w)} " in t}
    assert len(truth & got) >= 0.95 * len(truth) and any(d == -5 for d, _ in got)
    assert len(got - truth) <= 1
    assert decontamination.op7(docs, bench.where("false")).count() == 0


@pytest.mark.parametrize("max_broadcast", [0, 1 << 20])
def test_false_positives_are_removed(spark, max_broadcast):
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://h', id % 900, '.example.org/p') AS url")
    listed = pages.where("page_id < 300").select("url").union(spark.sql("SELECT CAST(NULL AS STRING)"))
    # one filter bit for each listed URL: nearly every page passes it
    got = urls.judge(pages, listed, rules=(), bits=1, max_broadcast=max_broadcast).select("_doc.page_id", "verdict").collect()
    assert len(got) == 3000 and all((r.verdict == "block") == (r.page_id % 900 < 300) for r in got)
    marks = urls.bloom(listed.where("url IS NOT NULL").selectExpr("substr(url, 8) AS u").distinct(), "u", 4)
    assert marks.count() == 4


def test_urls_odd(spark):
    rows = [(1, "http://a.com/" + "x" * 100_000), (1, "http://a.com/"), (1, "http://a.com/"), (None, "http://b.org")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "CAST(NULL AS STRING) AS html", "'c' AS verdict")
    assert sorted((str(r.page_id), r.verdict, len(r.path)) for r in urls.op3(pages).collect()) == [("1", "allow", 1), ("1", "allow", 1), ("1", "allow", 100_001), ("None", "allow", 0)]
    assert urls.op3(pages.where("false")).count() == 0


def test_inclusion_odds(spark):
    """Documents come as often as their odds say, over many seeds; the certain always."""
    docs = spark.range(600).selectExpr("id AS doc_id", "'s' AS source", "CASE WHEN id % 50 = 0 THEN 400L ELSE 5 + id % 40 END AS size").union(spark.sql("SELECT -1L, 't', 3000L"))
    docs = docs.cache()
    taken, runs = {}, 12
    seed = mixing.SEED
    try:
        for i in range(runs):
            mixing.SEED = f"{seed}{i}:"
            for r in mixing.mix(docs, weights=(1, 1), preference="size").collect():
                odds, n = taken.get(r.doc_id, (r.inclusion, 0))
                taken[r.doc_id] = (odds, n + r.copies)
    finally:
        mixing.SEED = seed
    own = {k: x for k, x in taken.items() if k >= 0}
    copies = min(n for _, n in own.values()) // runs
    extra = {k: (odds, n - copies * runs) for k, (odds, n) in own.items()}
    assert all(0 < odds <= 1 for odds, _ in extra.values()) and len({round(o, 6) for o, _ in extra.values()}) > 10
    assert all(n == runs for odds, n in extra.values() if odds == 1)
    for lo in (0, 0.2, 0.4, 0.6, 0.8):
        band = [(odds, n / runs) for odds, n in extra.values() if lo <= odds < lo + 0.2]
        if len(band) > 30:
            assert abs(sum(o for o, _ in band) - sum(n for _, n in band)) < 0.08 * len(band)


def test_long_conversation(spark):
    n = 20_000
    rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('t', id) AS text")
    done = chat.format_chats(rows)
    r = done.select(chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss")).first()
    assert [t.text for t in r.turns] == [f"t{i}" for i in range(n)] and r.loss == "".join(f"t{i}" for i in range(n) if i % 3)


def test_chat_odd(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (1, None, None, None), (1, 1, "assistant", None), (1, 1, "assistant", "z"), (2, 0, "assistant", "x" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS turns", "2 AS loss")
    got = {r.conv_id: r for r in chat.op5(df).collect()}
    assert got[None].n_turns == 2 and got[1].n_turns == 3 and got[1].loss_chars == 1 and got[2].loss_chars == 200_000
    assert [r.conv_id for r in chat.op5(df.where("false")).collect()] == [-7]


def test_cascade_order(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")

    def order(df):
        sample = quality.with_repeat_words(quality.sampled(df).withColumn("_w", quality.words(F.col("text"))))
        return [r.name for r in quality.order_rules(sample, quality.rules(F.col("text"), F.col("_w")))]

    first = order(docs)
    assert first == order(docs.repartition(7)) == order(docs.orderBy(F.desc("doc_id")))
    # rejections per cost decide: a rule that rejects most texts comes first unless it costs as much more
    loud = docs.withColumn("text", F.when(F.xxhash64("doc_id") % 2 == 0, F.upper("text")).otherwise(F.col("text")))
    assert order(loud).index("capitals") < order(docs.withColumn("text", F.lower("text"))).index("capitals")
    again = docs.withColumn("text", F.concat_ws(" ", "text", "text", "text"))
    assert order(again).index("repeat") < first.index("repeat")
