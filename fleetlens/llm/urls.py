"""URL verdicts: rules by host suffix and path, and a list of canonical URLs behind a blocked Bloom filter.

A rule (host, path) fits its host and all subdomains where the URL's path starts with the rule's;
the longest rule wins. Where none fits, the method decides: listed URLs are blocked, others allowed.

The filter has one block of eight 64-bit words for every ``KEYS_PER_BLOCK`` listed URLs; a URL sets one
bit in each word of its block, so a test reads one row of the filter table. It is built by a grouped
``bit_or`` and probed by a join on the block, whose size follows the list; Spark broadcasts it only
below its own threshold. What passes meets the list in an exact hash join.

Native. URLs are judged once each, however many pages repeat them. A null URL and one without ``://``
have an empty host and path, fit no rule and are allowed unless listed. Rules of equal length are
taken by rule text, the last one. Empty tables give no rows. Extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

KEYS_PER_BLOCK, WORDS = 32, 8
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
#: Host labels whose pages make up the list of the registered query.
JUNK_LABELS = ("casino-win", "free-bets", "ads-track")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host and path without a trailing slash; scheme, query and fragment do not count."""
    return F.concat(host, F.regexp_replace(path, r"/+$", ""))


def _bits(key: Column) -> list[Column]:
    spread = F.xxhash64(key, F.lit("bits"))
    return [F.shiftright(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def bloom_filter(listed: DataFrame) -> tuple[DataFrame, int]:
    """(block, w0..w7) of the distinct ``canonical`` column, and the number of blocks."""
    blocks = max(1, -(-listed.count() // KEYS_PER_BLOCK))
    rows = listed.select(F.pmod(F.xxhash64("canonical"), F.lit(blocks)).alias("block"),
                         *[b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("canonical")))])
    words = [F.expr(f"bit_or(shiftleft(1L, b{i}))").alias(f"w{i}") for i in range(WORDS)]
    return written(rows.groupBy("block").agg(*words)), blocks


def listed_hits(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct ``canonical`` values of ``urls`` that are in ``listed``: filter first, then the exact join."""
    listed = written(listed.select("canonical").distinct())
    table, blocks = bloom_filter(listed)
    keys = urls.select("canonical").distinct().select(
        "canonical", F.pmod(F.xxhash64("canonical"), F.lit(blocks)).alias("block"),
        *[b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("canonical")))])
    passes = F.lit(True)
    for i in range(WORDS):
        passes = passes & F.expr(f"(shiftrightunsigned(w{i}, b{i}) & 1L) = 1L")
    return keys.join(table, "block").where(passes).select("canonical").join(listed, "canonical")


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [(host, path, f"{host}{path}", verdict) for verdict, host, path in rules]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, verdict string")


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, rule, verdict of the longest rule that fits each of the distinct ``urls`` (url, host, path)."""
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = urls.where("host <> ''").select("url", "path", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host")
    fits = fits.where(F.startswith("path", "rule_path"))
    best = F.max(F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("verdict"))).alias("best")
    return fits.groupBy("url").agg(best).select("url", "best.rule", "best.verdict")


def verdicts(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed. ``listed`` has the column canonical."""
    parts = {"host": host_of(F.col("url")), "path": path_of(F.col("url"))}
    urls = pages.select("url").distinct().withColumns(parts).withColumn("canonical", canonical(F.col("host"), F.col("path")))
    urls = written(urls)
    ruled = fitting_rules(urls.where("url is not null"), rule_table(pages.sparkSession, rules))
    hits = listed_hits(urls, listed).withColumn("listed", F.lit(True))
    judged = urls.join(ruled, "url", "left").join(hits, "canonical", "left").select(
        F.col("url").alias("_url"), "host", "path", "rule", F.coalesce("listed", F.lit(False)).alias("listed"),
        F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
    return pages.select("page_id", "url").join(judged, F.col("url").eqNullSafe(F.col("_url"))).select(
        "page_id", "host", "path", "rule", "verdict", "listed")


def listed_of(pages: DataFrame, labels: tuple[str, ...] = JUNK_LABELS) -> DataFrame:
    """Canonical URLs of all pages on hosts with one of the labels."""
    host = host_of(F.col("url"))
    return pages.where(F.arrays_overlap(F.split(host, "\\."), F.array(*map(F.lit, labels)))).select(
        canonical(host, path_of(F.col("url"))).alias("canonical"))
