"""Chat formatting with relational expressions only, with a loss mask and an exact way back.

A conversation's rows become turn structs, collected and sorted; adjacent turns of one role merge into one block
(array aggregation: slices between the places where the role changes) and blocks are concatenated::

    <|start|>role<|text|>first text<|turn|>second text of the same role<|end|>

``loss`` lists the (start, length) character spans of the assistant's texts. Control strings inside texts and roles (those above, and
``<s> </s> [INST] [/INST]`` of a common template) get a backslash after their first character; strings that look escaped
already get one more, so that taking one away restores any text.

A conversation's output is one string, so its rows meet in one task by nature; there is no other grouping.

Defined results: null text or role is empty; rows are ordered by (turn, role, text), nulls first, so ties and repeated rows are
kept and reruns agree; null conv_id is a conversation of its own; an empty table gives an empty result; columns other
than the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once

START, TEXT, TURN, END = "<|start|>", "<|text|>", "<|turn|>", "<|end|>"
_TAILS = r"(\|(?:start|text|turn|end)\|>|/?s>|/?INST\])"
ESCAPE, UNESCAPE = r"([<\[])(\\*)" + _TAILS, r"([<\[])\\(\\*)" + _TAILS
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPE, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, UNESCAPE, "$1$2$3")


def _changes(turns: str) -> Column:
    """The places, from 1, of the turns whose role isn't that of the turn before."""
    return F.expr(f"filter(sequence(1, size({turns})), i -> i = 1 OR {turns}[i - 1].role <> {turns}[greatest(i - 2, 0)].role)")


def _merge(turns: str, changes: str) -> Column:
    """Blocks (role, texts) of adjacent turns of one role: from each change to the next."""
    own = f"slice({turns}, s, coalesce(get({changes}, k + 1), size({turns}) + 1) - s)"
    return F.expr(f"transform({changes}, (s, k) -> named_struct('role', {turns}[s - 1].role, 'texts', transform({own}, x -> x.text)))")


def _segments(blocks: Column) -> Column:
    """The output's pieces (text, loss) in order."""

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_block(b: Column) -> Column:
        no = F.lit(False)
        head = F.array(piece(F.concat(F.lit(START), escape(b["role"]), F.lit(TEXT)), no))
        body = F.transform(b["texts"], lambda t, i: F.array(piece(F.when(i > 0, TURN).otherwise(""), no), piece(escape(t), b["role"] == LOSS_ROLE)))
        return F.concat(head, F.flatten(body), F.array(piece(F.lit(END), no)))

    return F.flatten(F.transform(blocks, of_block))


def _spans(segments: str, ends: str) -> Column:
    """(start, length) of the pieces under the loss."""
    kept = f"filter(transform({segments}, (s, i) -> named_struct('start', {ends}[i] - length(s.text), 'length', length(s.text), 'loss', s.loss)), x -> x.loss)"
    return F.expr(f"transform({kept}, x -> named_struct('start', x.start, 'length', x.length))")


def _running(lengths: str) -> Column:
    """Running sums of an array, each number added to those 1, 2, 4, ... places on: passes over the array as its length has binary digits, none grown by an element at a time."""
    added = "transform(a, (x, i) -> x + IF(i >= shiftleft(1, k), a[greatest(i - shiftleft(1, k), 0)], 0))"
    return F.expr(f"aggregate(sequence(0, 30), {lengths}, (a, k) -> IF(size(a) > shiftleft(1, k), {added}, a))")


def format_chats(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text. Gives conv_id, formatted and loss (spans)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # each step is a column of its own, as an expression that names it twice would work it out twice
    steps = [("changes", _changes("turns")), ("blocks", _merge("turns", "changes")), ("segments", _segments(F.col("blocks"))), ("ends", _running("transform(segments, s -> length(s.text))"))]
    for name, value in steps:
        grouped = grouped.withColumn(name, once(value))
    return grouped.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), _spans("segments", "ends").alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation came from."""

    def turns(block: Column) -> Column:
        head = F.substring_index(block, TEXT, 1)
        body = F.substr(block, F.length(head) + len(TEXT) + 1, F.greatest(F.length(block) - F.length(head) - len(TEXT) - len(END), F.lit(0)))
        return F.transform(F.split(body, r"<\|turn\|>", -1), lambda t: F.struct(unescape(head).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.filter(F.split(formatted, r"<\|start\|>", -1), lambda b: b != ""), turns))


def loss_text(formatted: Column, loss: Column) -> Column:
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


PROBE = "</s>[INST] ok [/INST]"


def op5(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    probe = conversations.sparkSession.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    done = format_chats(rows.unionByName(probe))
    back = done.withColumns({"_turns": read_back(F.col("formatted")), "_loss": loss_text(F.col("formatted"), F.col("loss"))})
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("_turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("_loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("_loss"), 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


OP5_SQL = rf"""
WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')),
e AS (SELECT *, length(regexp_replace(text, '{ESCAPE}', '\1\\\2\3', 'g')) AS n, length(regexp_replace(role, '{ESCAPE}', '\1\\\2\3', 'g')) AS m,
    role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS goes_on FROM c),
t AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    COALESCE(string_agg(CASE WHEN role = '{LOSS_ROLE}' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(n + CASE WHEN goes_on THEN {len(TURN)} ELSE m + {len(START) + len(TEXT) + len(END)} END)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM t
"""
