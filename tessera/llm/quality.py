"""Quality rules as a short-circuit cascade.

Each rule is an expression that rejects a text. A sample of ``SAMPLE_ROWS`` rows, those (repeats aside) whose hashes are lowest in the whole table, tells what
each rule rejects; its cost is the work it names (characters or words gone over, each at the nanoseconds of ``NS``) over the sample's
texts. Rules are put in order greedily: the next one has the most rejections per cost among the sample's texts that are still there. So reruns
agree, and an order follows the table. The order changes the time only, never the verdict: a text is kept if no rule rejects it.

``keep_good`` filters by one rule after the other, so that a text which an early rule rejects never reaches a later one, the count of
repeats included. The query's figures are wanted for every text; there the cascade holds what is left to find out.

Everything is an expression over one row: no shuffle, no Python. Repeated three-word windows are found by
sorting one long a window (hash bits above, position below) and confirming neighbours of equal hash by their words.

Defined results: a null or empty text has no words and fails ``short``; a rule whose value is null doesn't reject; repeated
rows are each judged; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, once, packed, words

SYMBOLS = r"[^#*$%&|<>]+"
#: The query's limits. Base: fewest words; most repeated words in 100.
MIN_WORDS, MAX_REPEAT = 50, 50
#: The cascade's own: symbols in 100 words, capitals in 100 characters, repeated lines in 100 lines, mean word length.
MAX_SYMBOLS, MAX_UPPER, MAX_DUP_LINES, MEAN_CHARS = 20, 40, 30, (2, 25)
#: Any position in an array fits; hashes that share the bits left are told apart by their words.
POSITION_BITS, SAMPLE_ROWS = 31, 256
#: Nanoseconds a row, a character or a word, by what is done: measured on sf0.1 documents, and only their proportions matter.
NS = {"row": 20, "join": 10, "classes": 34, "lines": 40, "pattern": 53, "repeats": 2900}


class Rule(NamedTuple):
    name: str
    rejects: Column
    #: What is done, and over how much of a text: rows, chars or words.
    work: str = "row"
    over: str = "rows"


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, SYMBOLS, "")), F.lit(0)).cast("bigint")


def n_upper(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")), F.lit(0)).cast("bigint")


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("bigint")


def lines(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))


def n_dup_lines(own: Column) -> Column:
    return (F.size(own) - F.size(F.array_distinct(own))).cast("bigint")


def with_repeat_words(df: DataFrame, w: str = "_w", name: str = "n_repeat_words") -> DataFrame:
    """Adds the number of words in three-word windows that the text has twice or more.

    Window hashes that are all distinct end it there, as for most texts. Else the few windows whose hash bits have an equal neighbour are
    put in order by their words, so that equal hashes of different words don't count. Each step is a column
    of its own: sorting and distinct then run as generated code on plain longs, which they don't inside a lambda.
    """
    low = (1 << POSITION_BITS) - 1
    n, word = F.size(w), lambda i: F.get(F.col(w), i)

    def near(e: str, key) -> Column:
        return F.filter(e, lambda x, i: (key(x) == key(F.get(F.col(e), i - 1))) | (key(x) == key(F.get(F.col(e), i + 1))))

    steps = {
        "_h": F.when(n < 4, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))),
        "_e": F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("bigint"))))).otherwise(F.array().cast("array<bigint>")),
        "_p": F.transform(near("_e", lambda x: F.shiftright(x, POSITION_BITS)), lambda x: x.bitwiseAND(F.lit(low)).cast("int")),
        "_g": F.array_sort(F.transform("_p", lambda p: F.struct(F.concat_ws(" ", word(p), word(p + 1), word(p + 2)).alias("g"), p.alias("p")))),
        "_s": F.transform(near("_g", lambda x: x["g"]), lambda x: x["p"]),
        # times 0, an id keeps filters on the count above these columns; pushed below them they would copy each step into the next
        name: F.size(F.array_distinct(F.flatten(F.transform("_s", lambda p: F.array(p, p + 1, p + 2))))).cast("bigint") + F.monotonically_increasing_id() * 0,
    }
    for step, value in steps.items():
        df = df.withColumn(step, value)
    return df.drop(*[x for x in steps if x != name])


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id and text of the rows whose hashes are lowest. A first pass finds up to which hash, keeping that many numbers a task; a second reads the rows."""
    own = docs.select("doc_id", "text").withColumn("_hash", F.xxhash64("doc_id", "text"))
    lowest = own.select("_hash").distinct().orderBy("_hash").limit(rows).collect()  # at most rows numbers
    return own.where(F.col("_hash") <= lowest[-1][0]).dropDuplicates(["_hash"]).drop("_hash") if lowest else docs.select("doc_id", "text").limit(0)


def order_rules(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The rules by rejection per cost. sample: a bounded number of rows with text, _w and what the rules read."""
    sizes = [F.coalesce(F.length("text"), F.lit(0)).alias("_chars"), F.size("_w").alias("_words")]
    got = sample.select(*sizes, *(F.coalesce(r.rejects, F.lit(False)).alias(f"_{i}") for i, r in enumerate(rules))).collect()  # a bounded number of rows of numbers
    units = {"rows": len(got), "chars": sum(x["_chars"] for x in got), "words": sum(x["_words"] for x in got)}
    cost = [NS["row"] * len(got) + NS[r.work] * units[r.over] for r in rules]
    left, rest, out = got, list(range(len(rules))), []
    while rest:
        best = max(rest, key=lambda i: (sum(x[f"_{i}"] for x in left) / max(1, cost[i]), -cost[i], -i))
        rest.remove(best)
        out.append(rules[best])
        left = [x for x in left if not x[f"_{best}"]]
    return out


def verdict(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, or null."""
    out = None
    for r in rules:
        out = F.when(r.rejects, r.name) if out is None else out.when(r.rejects, r.name)
    return F.lit(None).cast("string") if out is None else out


def rules(text: Column, w: Column, symbols: Column | None = None, chars: Column | None = None, dup: Column | None = None, repeats: Column | None = None) -> list[Rule]:
    """The production rules over a text and its words. Columns that hold a figure already can be given; the work on them is done."""
    n, own = F.size(w), lines(text)

    def given(figure: Column | None, work: str, over: str) -> tuple[str, str]:
        return (work, over) if figure is None else ("row", "rows")

    return [
        Rule("short", n < MIN_WORDS),
        Rule("symbols", 100 * (n_symbols(text) if symbols is None else symbols) > MAX_SYMBOLS * n, *given(symbols, "pattern", "chars")),
        Rule("capitals", 100 * n_upper(text) > MAX_UPPER * F.length(text), "classes", "chars"),
        Rule("lines", 100 * (let(own, n_dup_lines) if dup is None else dup) > MAX_DUP_LINES * F.size(own), "lines", "chars"),
        Rule("word_length", let(word_chars(w) if chars is None else chars, lambda c: (c < MEAN_CHARS[0] * n) | (c > MEAN_CHARS[1] * n)), *given(chars, "join", "chars")),
        Rule("repeat", 100 * (F.col("n_repeat_words") if repeats is None else repeats) > MAX_REPEAT * n, *given(repeats, "repeats", "words")),
    ]


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, columns as they were."""
    rows = docs.select(packed(docs), "text").withColumn("_w", once(words(F.col("text"))))
    own = rules(F.col("text"), F.col("_w"))
    for r in order_rules(with_repeat_words(sampled(docs).withColumn("_w", words(F.col("text")))), own):
        if r.name == "repeat":
            rows = with_repeat_words(rows)
        rows = rows.where(~F.coalesce(r.rejects, F.lit(False)))
    return rows.select("_doc.*")


def measured(docs: DataFrame) -> DataFrame:
    """docs with _w, _own and the base figures."""
    w = F.col("_w")
    out = docs.withColumns({"_w": words(F.col("text")), "_own": lines(F.col("text"))})
    out = out.withColumns({"n_words": F.size(w).cast("bigint"), "word_chars": word_chars(w), "n_symbols": n_symbols(F.col("text")), "n_dup_lines": n_dup_lines(F.col("_own"))})
    return with_repeat_words(out)


def op9(docs: DataFrame) -> DataFrame:
    own = rules(F.col("text"), F.col("_w"), *(F.col(c) for c in ("n_symbols", "word_chars", "n_dup_lines", "n_repeat_words")))
    ordered = order_rules(measured(sampled(docs)), own)
    figures = measured(docs.select("doc_id", "text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return figures.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(ordered).isNull()).alias("kept"))


OP9_SQL = rf"""
WITH a AS (SELECT doc_id, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM a),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
k AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM h WHERE c > 1) GROUP BY doc_id),
f AS (SELECT doc_id, text, l, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    COALESCE(k.n, 0) AS n_repeat_words FROM a LEFT JOIN k USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 100 * n_symbols > {MAX_SYMBOLS} * n_words OR 100 * length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) > {MAX_UPPER} * length(text)
    OR 100 * n_dup_lines > {MAX_DUP_LINES} * len(l) OR word_chars < {MEAN_CHARS[0]} * n_words OR word_chars > {MEAN_CHARS[1]} * n_words) AS kept FROM b
"""
