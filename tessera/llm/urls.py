"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join, under host and path rules.

The filter is a table of 64-bit blocks: a URL's hash names one block and four bits in it; blocks of listed URLs
are or-ed together. A page whose block has all its bits set is a possible hit; only possible hits reach the exact
join on the canonical URL, which removes the false positives. With ``bits`` filter bits a listed URL about 2 pages in 1,000 get
past by chance. The table of blocks is broadcast only while its size, known from the count of listed URLs, is
at most ``max_broadcast``; beyond that the same join runs as a shuffle on the block.

Rules decide first: a rule (host, path) fits its host and all subdomains where the url's path starts
with the rule's; the longest rule wins. Rules are parameters (one CASE branch each), meant for up to a few hundred.

Defined results: a null url, or one without ``://``, has empty host and path, is never listed and is allowed;
repeated listed URLs and repeated pages are kept apart as rows; an empty listing blocks nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, packed


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))
BITS, MAX_BROADCAST = 16, 8 << 20
#: The listing of the query: the canonical URLs of pages with a title of junk marks. It depends on what a page holds, not on its URL.
JUNK_TITLE = r"<title>[^<]*(###|%%%|\*\*\*)"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host and path without scheme, query, fragment and closing slashes; null without a host."""
    return F.when(host != "", F.concat(host, F.regexp_replace(path, r"/+$", "")))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _mask(url: Column) -> Column:
    spread = F.xxhash64(url, F.lit("bits"))
    one = F.lit(1).cast("bigint")
    return _or([F.call_function("shiftleft", one, F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)])


def _or(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseOR(c)
    return out


def bloom(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """(_block, _bits) of the listed URLs."""
    return listed.select(_block(F.col(url), blocks).alias("_block"), _mask(F.col(url)).alias("_mask")).groupBy("_block").agg(F.bit_or("_mask").alias("_bits"))


def hits(pages: DataFrame, listed: DataFrame, url: str = "url_key", bits: int = BITS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """pages with _listed: whether its canonical URL is among listed's. Both have the column url; listed may hold it often or null."""
    listed = listed.where(F.col(url).isNotNull()).select(url).distinct()
    blocks = max(1, listed.count() * bits // 64)
    marks = bloom(listed, url, blocks)
    if blocks * 32 <= max_broadcast:
        marks = F.broadcast(marks)
    keyed = pages.withColumns({"_block": F.when(F.col(url).isNotNull(), _block(F.col(url), blocks)), "_mask": _mask(F.col(url))})
    probed = keyed.join(marks, "_block", "left").withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False)))
    probed = probed.drop("_block", "_mask", "_bits")
    exact = listed.select(F.col(url).alias("_url"), F.lit(True).alias("_exact"))
    sure = probed.where("_maybe").join(exact, F.col(url) == F.col("_url"), "left").withColumn("_listed", F.coalesce("_exact", F.lit(False))).drop("_url", "_exact")
    return sure.unionByName(probed.where(~F.col("_maybe")).withColumn("_listed", F.lit(False))).drop("_maybe")


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, bits: int = BITS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """pages (with a url) as _doc, with host, path, rule and verdict. listed: a column url of listed URLs."""
    h, p = F.col("host"), F.col("path")
    own = pages.select(packed(pages), host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("url_key", canonical(h, p))
    other = listed.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).select(canonical(h, p).alias("url_key"))
    found = hits(own, other, bits=bits, max_broadcast=max_broadcast)
    rule = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        rule = F.when(fits(r, h, p), r.name) if rule is None else rule.when(fits(r, h, p), r.name)
        verdict = F.when(fits(r, h, p), r.verdict) if verdict is None else verdict.when(fits(r, h, p), r.verdict)
    by_list = F.when(F.col("_listed"), "block").otherwise("allow")
    return found.select("_doc", "host", "path", (F.lit(None).cast("string") if rule is None else rule).alias("rule"), (by_list if verdict is None else verdict.otherwise(by_list)).alias("verdict"), F.col("_listed").alias("listed"))


def op3(pages: DataFrame) -> DataFrame:
    listed = pages.where(F.rlike("html", F.lit(JUNK_TITLE))).select("url")
    return judge(pages.select("page_id", "url"), listed).select("_doc.page_id", "host", "path", "rule", "verdict", "listed")


OP3_SQL = rf"""
WITH a AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') END AS k FROM b),
r(h, p, v) AS (VALUES {', '.join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)}),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM c, r
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
l AS (SELECT DISTINCT k FROM c WHERE regexp_matches(html, '{JUNK_TITLE}') AND k IS NOT NULL)
SELECT c.page_id, host, path, rule, COALESCE(m.v, CASE WHEN l.k IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.k IS NOT NULL AS listed
FROM c LEFT JOIN m USING (page_id) LEFT JOIN l ON c.k = l.k
"""
