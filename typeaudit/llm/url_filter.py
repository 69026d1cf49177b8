"""URL filters: path rules, and a blocked Bloom filter of listed canonical URLs before an exact join.

A rule fits its host and every subdomain if the URL's path starts with the rule's; the longest fitting rule decides.
What no rule decides is blocked if its canonical form is listed. The filter is a table of 64-bit words: a URL's hash picks a word
and some bits of it. Words are a bitwise-or aggregate of the list, bounded by ``MAX_WORDS`` rows and therefore
broadcast; URLs whose bits are all set go to an equality join with the list, which removes false positives.

Scale: only the URL column is read; all but possible hits end in the scan's stage. Beyond some six million listed URLs the
filter fills up and lets more through, which costs shuffle and no correctness. Everything is DataFrame expressions. A hot host or
URL is no key before the exact join, whose distinct list side can't be skewed and whose other side the planner may split.

Cases: null URLs and those without ``://`` have empty host and path, no rule, and are allowed. Repeated rows get equal verdicts; repeated
list entries count once, null ones not. Columns of the input stay in ``row``. Empty tables give no hits, or no rows.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WORDS = 1 << 20
BITS_PER_URL = 12
BITS_SET = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    #: Host and path in one, such as ``example.net/en/``.
    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text[: self.text.index("/")]

    @property
    def path(self) -> str:
        return self.text[self.text.index("/") :]

    def fits(self, host: Column, path: Column) -> Column:
        inside = (host == self.host) | host.endswith(f".{self.host}")
        return inside & path.startswith(self.path)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without closing slashes or ``.html``; null without host."""
    short = F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(/+|\.html)$", ""))
    return F.when(host != "", short)


def _choice(rules: list[Rule], host: Column, path: Column, of: str) -> Column:
    """Longest rule first, then the longer host."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    return F.coalesce(*(F.when(r.fits(host, path), F.lit(getattr(r, of))) for r in ordered), F.lit(None).cast("string"))


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words))


def _bits(key: Column) -> Column:
    """The set bits: six hash bits choose each."""
    spread = F.xxhash64(key, F.lit(1))
    picks = [F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(BITS_SET)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in picks])


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule]) -> DataFrame:
    """``row, host, path, rule, verdict`` of every row of ``pages``, by the rules and the ``canonical`` URLs of ``listed``."""
    row = F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row")
    parsed = pages.select(row).select("row", host_of(F.col("row.url")).alias("host"), path_of(F.col("row.url")).alias("path"))
    ruled = parsed.select(
        "row", "host", "path",
        _choice(rules, F.col("host"), F.col("path"), "text").alias("rule"),
        _choice(rules, F.col("host"), F.col("path"), "verdict").alias("by_rule"),
        canonical(F.col("host"), F.col("path")).alias("canonical"),
    )
    entries = listed.where("canonical is not null").select("canonical").distinct()
    count = entries.count()
    words = min(MAX_WORDS, count * BITS_PER_URL // 64 + 1)
    table = entries.groupBy(_word(F.col("canonical"), words).alias("word")).agg(F.bit_or(_bits(F.col("canonical"))).alias("bits"))
    probed = ruled.withColumn("word", F.when(F.col("rule").isNull(), _word(F.col("canonical"), words)))
    # At most MAX_WORDS rows of two numbers.
    probed = probed.join(F.broadcast(table), "word", "left")
    own = _bits(F.col("canonical"))
    probed = probed.withColumn("possible", F.coalesce(F.col("bits").bitwiseAND(own) == own, F.lit(False)))
    out = ["row", "host", "path", "rule"]
    clear = probed.where("not possible").select(*out, F.coalesce("by_rule", F.lit("allow")).alias("verdict"))
    hits = probed.where("possible").join(entries.withColumn("listed", F.lit(True)).hint("shuffle_hash"), "canonical", "left")
    exact = hits.select(*out, F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"))
    return clear.unionByName(exact)
