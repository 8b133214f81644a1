"""Edited copies of benchmark items: recall of those that the rules count, and the shares of what is found against a plain common subsequence."""

import math
import random
import re
from collections import Counter, defaultdict

from tessera.llm import decontamination

from . import brute

RATES, KINDS = (0.05, 0.1, 0.2), ("drop", "replace", "insert", "swap")


def edited(words, kind, rate, rng):
    """The edited words, and which of the item's own are still in order there."""
    out, kept = [], [True] * len(words)
    i = 0
    while i < len(words):
        if rng.random() >= rate:
            out.append(words[i])
        elif kind == "drop":
            kept[i] = False
        elif kind == "replace":
            out.append(f"other{rng.randrange(500)}")
            kept[i] = False
        elif kind == "insert":
            out += [f"other{rng.randrange(500)}", words[i]]
        elif i + 1 < len(words):
            out += [words[i + 1], words[i]]
            kept[i] = False
            i += 1
        else:
            out.append(words[i])
        i += 1
    return out, kept


def common(item, text, weight):
    """The largest weight of a common subsequence."""
    above = [0.0] * (len(text) + 1)
    for w in item:
        best = [0.0]
        for j, x in enumerate(text):
            best.append(max(above[j + 1], best[j], above[j] + weight(w) if x == w else 0.0))
        above = best
    return above[-1]


def test_paraphrases(spark, small_dir):
    rng = random.Random(11)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    bench = spark.read.parquet(f"{small_dir}/benchmark.parquet")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(t or ""))
    items = {r.item_id: split(r.text) for r in bench.collect()}
    plants = {}
    for item, words in items.items():
        for kind in KINDS:
            for rate in RATES:
                body, kept = edited(words, kind, rate, rng)
                around = [f"filler{rng.randrange(3000)}" for _ in range(120)]
                plants[10**6 + len(plants)] = (item, kind, kept, around[:60] + body + around[60:])
    docs += [(i, " ".join(p[3])) for i, p in plants.items()]
    frequency = Counter(w for _, t in docs for w in set(split(t)))
    weight = lambda w: math.log((1 + len(docs)) / (1 + frequency[w])) + 0.05
    got = {(r.doc_id, r.item_id): r for r in decontamination.op7(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}

    hits = defaultdict(list)
    for doc, (item, kind, kept, _) in plants.items():
        own = items[item]
        tail = -(-len(own) // 4)
        share = sum(weight(w) for w, k in zip(own, kept) if k) / sum(map(weight, own))
        if share >= decontamination.LEAST_LCS + 0.02 and sum(kept[-tail:]) >= (decontamination.LEAST_ANSWER + 0.1) * tail:
            hits[kind].append((doc, item) in got)
    recall = {kind: (sum(own), len(own)) for kind, own in hits.items()}
    print(recall)
    assert len(recall) == len(KINDS) and all(n >= 20 and found >= 0.9 * n for found, n in recall.values()), recall

    for (doc, item), r in got.items():
        if doc in plants:
            own = items[item]
            whole = common(own, plants[doc][3], weight) / sum(map(weight, own))
            assert decontamination.LEAST_LCS <= r.common <= whole + 1e-4 and (item == plants[doc][0] or whole >= decontamination.LEAST_LCS)
