"""Near-duplicates and repeated passages against brute force."""

import random

import pytest

from tessera.llm import components, neardup, substrings

from . import brute


def frame(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.selectExpr("*", "1 AS id", "'x' AS sig", "2 AS `_doc`", "3 AS key")


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "ß", "A", "Zz"]
    base = [[rng.choice(vocab) for _ in range(n)] for n in (1, 3, 4, 5, 6, 60, 80, 120, 300, 700)]
    passages = [[rng.choice(vocab) for _ in range(n)] for n in (49, 50, 51, 75)]
    rows = []
    for _ in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 4, 9, 20))):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.4:
            at = rng.randrange(len(w))
            w[at:at] = rng.choice(passages)
        if rng.random() < 0.2:
            w = w[rng.randrange(len(w)) :]
        rows.append(rng.choice((" ", "\n", "\t ")).join(w))
    rows += [None, "", " \n\t", "one", "ONE", "one two three four five", "one\x1ctwo\xa0three", "x " * 3000, "x " * 120]
    rng.shuffle(rows)
    return [(3 * i - 90, t) for i, t in enumerate(rows)]


def test_near_duplicates_small(spark):
    rows = corpus()
    got = sorted(tuple(r) for r in neardup.op6(frame(spark, rows)).collect())
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in neardup.op6(docs).collect())
    assert got == brute.near_duplicates(rows)


def test_drop_near_duplicates_keeps_columns(spark):
    rows = corpus()
    df = frame(spark, rows)
    got = neardup.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [x[0] for x in brute.near_duplicates(rows) if x[3]]


@pytest.mark.parametrize("f", [neardup.op6, substrings.op8])
def test_empty_and_repeated_rows(spark, f):
    assert f(frame(spark, [(1, "a")]).where("false")).count() == 0
    twice = " ".join(f"v{i}" for i in range(70))
    got = sorted(map(tuple, f(frame(spark, [(1, twice), (1, twice), (2, twice), (None, twice)])).collect()), key=str)
    assert len(got) == 4
    by_id = {r[0]: r for r in got}
    if f is neardup.op6:
        assert by_id[1][2:] == (1, True) and by_id[2][2:] == (1, False) and by_id[None][2:] == (None, True)
    else:
        assert by_id[1][2] == 0 and by_id[2][2] == 70 and by_id[None][2] == 0


def test_repeats_small(spark):
    rows = corpus(9)
    got = sorted(tuple(r)[:4] for r in substrings.op8(frame(spark, rows)).collect())
    assert got == brute.repeats(rows)


def test_repeats_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r)[:4] for r in substrings.op8(docs).collect()) == brute.repeats(rows)


def test_kept_text(spark):
    long = " ".join(f"v{i}" for i in range(60))
    got = {r.doc_id: r.kept_text for r in substrings.remove_repeats(frame(spark, [(1, long), (2, "a " + long + " b")]), with_text=True).collect()}
    assert got[2] == "a b"


def test_factors_are_greedy():
    import numpy as np

    starts, ends = substrings.factors(np.array([0, 1, 2, 9]), np.array([7, 7, 3, 7]), np.array([4, 5, 0, 1]))
    assert starts.tolist() == [0, 2, 9] and ends.tolist() == [51, 52, 59]


def smallest_reachable(links):
    nodes = {n: n for link in links for n in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(nodes[a], nodes[b])
            changed |= nodes[a] != low or nodes[b] != low
            nodes[a] = nodes[b] = low
    return nodes


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 560)]
    links = chain + star + [(rng.randrange(1000, 1150), rng.randrange(1000, 1150)) for _ in range(110)] + [(7, 7), (120, 121)]
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in links]
    apart = [(a, b) for a, b in links if a != b]
    label = components.components(spark.createDataFrame(links, "u bigint, v bigint"))
    assert {r.node: r.component for r in label.collect()} == smallest_reachable(apart)
    # links within a component, between components, between nodes that no link had and from these to components
    more = [(130, 101), (110, 520), (90, 560), (2000, 2001), (2001, 2002), (1999, 1100), (555, 90)]
    got = components.joined_components(label, spark.createDataFrame(more, "u bigint, v bigint")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.component for r in got} == smallest_reachable(apart + more)
    none = components.joined_components(label, spark.createDataFrame([], "u bigint, v bigint"))
    assert {r.node: r.component for r in none.collect()} == smallest_reachable(apart)


def patterned():
    """Texts that polynomial hashes modulo 2**64 can't tell apart: Thue-Morse words and sequences, and their swaps."""
    t = brute.thue_morse(2048)
    letters = ["".join("xy"[b ^ swap] for b in t) for swap in (False, True)]
    pairs = [" ".join(f"{'xy'[b ^ swap]} c{i}" for i, b in enumerate(t)) for swap in (False, True)]
    return [*enumerate(letters, 1), *enumerate(pairs, 11)]


@pytest.mark.parametrize("f, plain", [(neardup.op6, brute.near_duplicates), (substrings.op8, brute.repeats)])
def test_patterned_texts(spark, f, plain):
    rows = patterned()
    assert sorted(tuple(r)[:4] for r in f(frame(spark, rows)).collect()) == plain(rows)


@pytest.mark.parametrize("order", [1, -1])
def test_rows_of_one_id(spark, order):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, b + " tail"), (3, a + " end")][::order]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.op6(frame(spark, rows)).collect())
    assert got == [(1, 56, 1, True), (1, 56, 1, True), (2, 57, 1, False), (3, 57, 1, False)]
    assert sorted((r.doc_id, r.text) for r in neardup.drop_near_duplicates(frame(spark, rows)).collect()) == [(1, a), (1, b)]
    got = sorted((r.doc_id, r.n_removed) for r in substrings.op8(frame(spark, rows)).collect())
    assert got == [(1, 0), (1, 0), (2, 60), (3, 60)]


def test_one_row_stays(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    # repeated rows, an id on two texts of which one is a copy, null ids, texts without words
    rows = [(5, a), (5, a), (6, a), (6, b), (None, a), (None, "z " + b), (7, None), (7, None), (8, " ")]
    got = [(r.doc_id, r.text) for r in neardup.drop_near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(5, a), (6, b), (7, None), (7, None), (8, " ")], key=str)


def test_many_members_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(neardup, "AT_ONCE", 3)
    rows = corpus(21)
    assert sorted(tuple(r) for r in neardup.op6(frame(spark, rows)).collect()) == brute.near_duplicates(rows)


def test_forest():
    import numpy as np

    rng = np.random.default_rng(2)
    u, v = rng.integers(0, 60, 70), rng.integers(0, 60, 70)
    keep = u != v
    node, root = components.forest(u[keep], v[keep])
    want = smallest_reachable(list(zip(u[keep].tolist(), v[keep].tolist())))
    assert dict(zip(node.tolist(), root.tolist())) == {n: c for n, c in want.items() if n != c}
