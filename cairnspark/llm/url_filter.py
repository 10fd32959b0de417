"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

A list holds canonical keys: host and path prefix, each with a verdict. Every URL proposes the keys that
could name it: each suffix of its host, with its path cut to each length that the list's paths have. A key
hashes to one block of the filter, a long, and to four bits of it. Blocks are a table keyed by number, of at
most 2 ** BLOCK_BITS rows whatever the list's size, so it may be broadcast; keys whose bits are all set go on
to an exact join with the list, which removes false positives. Of a URL's exact keys the longest wins.

Rules and the block list are two lists of this kind; the list speaks where no rule fits.

Results: a null URL or one without ``://`` has empty host and path and is allowed, as is any URL that no key
names; repeated rows are judged each, by their URL; extra columns are ignored; an empty table gives an empty
result, and empty lists allow everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BITS = 20
HASHES = 4

#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Sites that are listed as unwanted, where no rule fits: fixed values, each under three domains.
LISTED = tuple(
    ("block", f"{site}.example.{domain}", "/")
    for site in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for domain in ("com", "net", "org")
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, as written; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def key_table(spark: SparkSession, keys: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """(key, verdict, path_length) of a list; where a key repeats, block wins."""
    rows = spark.createDataFrame(list(keys), "verdict string, host string, path string")
    rows = rows.select(F.concat("host", "path").alias("key"), "verdict", F.length("path").alias("path_length"))
    return rows.groupBy("key").agg(F.max("verdict").alias("verdict"), F.max("path_length").alias("path_length"))


def _block(key: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - BLOCK_BITS).cast("int")


def _bits(key: str) -> Column:
    """The bits of a key inside its block: HASHES runs of six bits of its hash."""
    h = F.xxhash64(key, F.lit(7))
    out = F.lit(0).cast("long")
    for k in range(HASHES):
        place = F.shiftright(h, 6 * k).bitwiseAND(63).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return out


def blocked_bloom(keys: DataFrame) -> DataFrame:
    """(block, mask): at most 2 ** BLOCK_BITS rows."""
    return keys.select(_block("key").alias("block"), _bits("key").alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("mask"))


def possible_keys(urls: DataFrame, lengths: list[int]) -> DataFrame:
    """(url, key) for urls(url, host, path): each host suffix with each usable cut of the path."""
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    each = urls.where("host != ''").select("url", "path", F.explode(hosts).alias("suffix"), cuts.alias("cuts"))
    return each.select("url", "suffix", "path", F.explode("cuts").alias("cut")).select("url", F.concat("suffix", F.substring(F.col("path"), F.lit(1), F.col("cut"))).alias("key"))


def named_by(urls: DataFrame, keys: DataFrame) -> DataFrame:
    """(url, key, verdict): the longest key of the list that names each URL; URLs without one have no row."""
    lengths = sorted(r[0] for r in keys.select("path_length").distinct().collect())  # at most the longest path
    if not lengths:
        return urls.select("url", F.lit("").alias("key"), F.lit("").alias("verdict")).where("false")
    tried = possible_keys(urls, lengths)
    passed = tried.withColumn("block", _block("key")).join(F.broadcast(blocked_bloom(keys)), "block")
    passed = passed.where(F.col("mask").bitwiseAND(_bits("key")) == _bits("key")).select("url", "key")
    exact = passed.join(keys.select("key", "verdict"), "key")
    longest = F.max_by(F.struct("key", "verdict"), F.struct(F.length("key"), F.col("key")))
    return exact.groupBy("url").agg(longest.alias("x")).select("url", "x.key", "x.verdict")


def judge(pages: DataFrame, rules: tuple = RULES, listed: tuple = LISTED) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages(page_id, url, ...)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    urls = rows.select(F.xxhash64("host", "path").alias("url"), "host", "path").dropDuplicates(["url"])
    by_rule = named_by(urls, key_table(spark, rules)).select("url", F.col("key").alias("rule"), F.col("verdict").alias("ruled"))
    by_list = named_by(urls, key_table(spark, listed)).select("url", F.col("verdict").alias("named"))
    found = by_rule.join(by_list, "url", "full")
    judged = rows.drop("url").withColumn("url", F.xxhash64("host", "path")).join(found, "url", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", "named", F.lit("allow")).alias("verdict"))
