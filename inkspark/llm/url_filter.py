"""URL filter: path rules, then a blocked Bloom filter of listed canonical URLs before an exact hash join.

All of it is DataFrame expressions. The listed URLs become a blocked Bloom filter: one hash picks a
512-bit block, further bits of a second hash pick the bits set inside it. The filter is a table with a row per
non-empty block (eight longs). A URL that misses one of its bits is surely not listed and needs no join; only
possible hits are shuffled to the exact hash join with the list, which removes false positives.

The blocks are broadcast only while ``n_blocks * 72`` bytes stay under ``broadcast_bytes``; beyond it they
are joined by shuffle on the block number, which AQE may split if a block is hot.

Defined results: a null URL or one without ``://`` has an empty host and path, no canonical form, no rule, and the
verdict "allow". Repeated rows stay repeated. An empty list allows everything that no rule blocks.
Columns of the page table other than the id and URL don't take part, so clashing names don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.llm.bloom import BLOCK_LONGS, block_count, bloom_blocks, masks
from inkspark.llm.store import written

#: Fixed values of the contract: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Second-level names whose pages are listed in the query.
LISTED_NAMES = ("casino-win", "free-bets", "cheap-pills", "ads-track", "spam-farm", "adult-x")


@dataclass(frozen=True)
class Rule:
    """A path rule; ``text`` is its printed form."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.``, ``m.`` or ``blog.``, and the path without a closing slash or ``.html``; null if no host."""
    bare = F.regexp_replace(host, r"^(www|m|blog)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(\.html|/+)$", "")))


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, null if none fits."""

    def fits(r: Rule) -> Column:
        return ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)

    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    text = reduce(lambda c, r: c.when(fits(r), r.text), ordered[1:], F.when(fits(ordered[0]), ordered[0].text))
    verdict = reduce(lambda c, r: c.when(fits(r), r.verdict), ordered[1:], F.when(fits(ordered[0]), ordered[0].verdict))
    return text, verdict


def filter_urls(
    pages: DataFrame,
    listed_urls: DataFrame,
    rules: list[Rule] | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    broadcast_bytes: int = 8 << 20,
) -> DataFrame:
    """A row per page: id, host, path, rule, verdict, maybe_listed (the filter's answer), listed (the exact one).

    ``listed_urls`` has a column ``url``. The only value brought to the driver is the number of listed keys,
    which sizes the filter.
    """
    rules = [Rule(*r) for r in RULES] if rules is None else rules
    keys = (
        listed_urls.select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("key"))
        .where("key IS NOT NULL")
        .distinct()
    )
    keys = written(keys, "url-keys")  # counted, made into a filter and joined
    n_blocks = block_count(keys.count())
    blocks = bloom_blocks(keys, n_blocks)
    if n_blocks * (BLOCK_LONGS + 1) * 8 <= broadcast_bytes:
        blocks = F.broadcast(blocks)

    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), verdict.alias("rule_verdict"), canonical(F.col("host"), F.col("path")).alias("key"))
    # a null key gets a block of its own, so that such rows don't meet in one task of a shuffled join
    block = F.coalesce(F.pmod(F.xxhash64("key"), F.lit(n_blocks)), -1 - F.pmod(F.xxhash64("page_id"), F.lit(4096)))
    hit = reduce(
        lambda a, b: a & b,
        [F.coalesce(F.col(f"w{i}").bitwiseAND(m) == m, F.lit(False)) for i, m in enumerate(masks(F.col("key")))],
    )
    tested = (
        base.withColumn("block", block)
        .join(blocks, "block", "left")
        .select("page_id", "host", "path", "rule", "rule_verdict", "key", F.coalesce(hit, F.lit(False)).alias("maybe_listed"))
    )
    # left join on a key that is null for sure misses would gather them in one task: they skip the join instead
    sure = tested.where(~F.col("maybe_listed")).withColumn("listed", F.lit(False))
    possible = tested.where("maybe_listed").join(keys.withColumn("listed", F.lit(True)), "key", "left")
    both = sure.unionByName(possible.withColumn("listed", F.coalesce("listed", F.lit(False))))
    return both.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "maybe_listed",
        "listed",
    )


def listed_in(pages: DataFrame) -> DataFrame:
    """The list used by the query: URLs of pages whose host has one of ``LISTED_NAMES`` as a label."""
    host = host_of(F.col("url"))
    return pages.where(F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, LISTED_NAMES)))).select("url")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``filter_urls`` over the whole table of pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, listed_in(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


_NAMES_SQL = ", ".join(f"'{n}'" for n in LISTED_NAMES)
_FIT = "((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
_ORDERED = sorted((Rule(*r) for r in RULES), key=lambda r: (-len(r.text), r.text))
_RULE_SQL = "CASE " + " ".join(f"WHEN {_FIT.format(h=r.host, p=r.path)} THEN '{r.text}'" for r in _ORDERED) + " END"
_VERDICT_SQL = "CASE " + " ".join(f"WHEN {_FIT.format(h=r.host, p=r.path)} THEN '{r.verdict}'" for r in _ORDERED) + " END"

ORACLE_SQL = rf"""
WITH parts AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m|blog)\.', '') || regexp_replace(path, '(\.html|/+)$', '') END AS key,
         list_has_any(string_split(host, '.'), [{_NAMES_SQL}]) AS named
  FROM parts
), keys AS (SELECT DISTINCT key FROM keyed WHERE named AND key IS NOT NULL)
SELECT page_id, host, path, {_RULE_SQL} AS rule,
       coalesce({_VERDICT_SQL}, CASE WHEN k.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       k.key IS NOT NULL AS listed
FROM keyed LEFT JOIN keys k ON k.key = keyed.key
"""
