"""URL rules by a blocked Bloom filter and an exact hash join.

A listed entry is a canonical URL prefix: a host, which stands for its subdomains too,
and the beginning of a path. A URL first offers its host and the domains above it that have
as many labels as some entry's host; those that the filter of hosts passes meet the listed
hosts exactly. Each host that is listed tells how long its entries' paths are, so the URL then
offers its own path cut to those lengths; those that the filter of entries passes meet the
entries in an exact hash join, which removes false positives. The longest entry decides; a
URL that no entry fits gets `default`. The list may be of any size and shape.

A filter has one row for each block of 512 bits; a key sets one bit in each of eight
words of one block. Filters, hosts and entries are broadcast while they are at most FEW bytes,
else joined by a shuffle, in which adaptive execution splits a host that very many URLs have.

Null URL, or one without ://: empty host and path, fits nothing. Repeated rows: one result
each. Of entries that repeat with other verdicts, block wins; entries of one length can't both
fit but for one that splits host and path otherwise: the longer host wins. Very long URLs are
taken whole. Other columns of pages, whatever their names, are not read. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, small, table

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
WORDS, KEYS_A_BLOCK = 8, 32


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def bits(k: str) -> list[Column]:
    """For each word of a block, the one bit that the key in column k sets."""
    return [F.expr(f"shiftleft(1L, cast(pmod(xxhash64({k}, {salt}), 64) as int))") for salt in range(1, WORDS + 1)]


def block(k: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(k), F.lit(blocks))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """block, w0..w7 of the keys (one column, key)."""
    keyed = keys.select(F.col("key").alias("bloom_key")).withColumn("block", block(F.col("bloom_key"), blocks))
    return keyed.groupBy("block").agg(*(F.bit_or(b).alias(f"w{k}") for k, b in enumerate(bits("bloom_key"))))


def listed(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of asked (key and others) with the columns of known (stored; key and others) that has their key: those that the filter passes, joined exactly."""
    blocks = max(1, -(-known.count() // KEYS_A_BLOCK))
    passed = asked.withColumnRenamed("key", "bloom_key").withColumn("block", block(F.col("bloom_key"), blocks)).join(small(cut(bloom(known, blocks))), "block")
    for k, b in enumerate(bits("bloom_key")):
        passed = passed.filter(F.col(f"w{k}").bitwiseAND(b) != 0)
    return passed.drop("block", *(f"w{k}" for k in range(WORDS))).withColumnRenamed("bloom_key", "key").join(small(known), "key")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of each row. rules: host, path, verdict."""
    entries = rules.select(F.coalesce("host", F.lit("")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
    entries = cut(entries.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict")).withColumn("key", key(F.col("rule_host"), F.col("rule_path"))))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce(F.contains("url", F.lit("://")), F.lit(False)).alias("whole"))
    out = cut(rows.withColumn("row", F.monotonically_increasing_id()))  # stored, so that numbers stay
    # as many arrays as there are different path lengths; none is longer than the longest path
    hosts = cut(entries.groupBy(F.col("rule_host").alias("key")).agg(F.array_sort(F.collect_set(F.length("rule_path"))).alias("lengths")))
    depths = cut(entries.select(F.size(F.split("rule_host", r"\.")).alias("d")).distinct().agg(F.array_sort(F.collect_list("d")).alias("depths")))  # one row
    urls = out.filter("whole").join(F.broadcast(depths)).withColumn("labels", F.split("host", r"\."))
    above = F.transform(F.filter("depths", lambda d: d <= F.size("labels")), lambda d: F.array_join(F.slice("labels", -d, d), "."))
    asked = listed(urls.select("row", "path", F.explode(above).alias("key")), hosts)
    cuts = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.concat(F.col("key"), F.lit("\n"), F.substring(F.col("path"), F.lit(1), n)))
    fits = listed(asked.select("row", F.explode(cuts).alias("key")), entries)
    longest = fits.groupBy("row").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))).alias("x"))
    return out.join(longest, "row", "left").select("page_id", "host", "path", F.col("x.rule").alias("rule"), F.coalesce("x.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


ORACLE = """
WITH p AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    coalesce(contains(url, '://'), false) AS whole,
    row_number() OVER () AS r
  FROM pages),
rules(h, q, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT r, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v
  FROM p JOIN rules ON whole AND (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
  GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN best USING (r)
"""
