"""Stable keys: hashes over parts that each end in a NUL character, buckets and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parts(parts: tuple[Column, ...]) -> Column:
    nul = F.char(F.lit(0))
    return F.concat(*(x for p in parts for x in (p.cast("string"), nul)))


def sha256_key(*parts: Column) -> Column:
    return F.sha2(_parts(parts).cast("binary"), 256)


def sha1_key(*parts: Column) -> Column:
    """The first 16 hex digits of SHA-1."""
    return F.substring(F.sha1(_parts(parts).cast("binary")), 1, 16)


def add_stable_keys(df: DataFrame) -> DataFrame:
    b, c, t = F.col("benchmark"), F.col("condition"), F.col("item_content")
    return df.withColumns({"subject_key": sha256_key(F.concat(F.lit("Name: "), F.col("display_name"))), "item_key": sha256_key(b, c, t), "item_split_key": sha256_key(b, t), "benchmark_condition_key": F.concat_ws("::", b, c)})


def split_key(benchmark: Column, content: Column) -> Column:
    return F.concat_ws("::", benchmark, sha1_key(content))


def add_item_variant_id(df: DataFrame) -> DataFrame:
    """benchmark::item_id where no item of the benchmark has two conditions; else a hash of condition and content."""
    per_item = df.groupBy("benchmark", "item_id").agg(F.countDistinct("condition").alias("n"))
    single = per_item.groupBy("benchmark").agg((F.max("n") <= 1).alias("single"))
    return df.join(single, "benchmark").withColumn("item_variant_id", F.when(F.col("single"), F.concat_ws("::", "benchmark", "item_id")).otherwise(F.concat_ws("::", F.col("benchmark"), sha1_key(F.concat_ws("|", "condition", "item_content"))))).drop("single")


def stable_bucket(key: Column, n: int, seed: int = 0) -> Column:
    """The first 8 bytes of SHA-1 over 'seed:key', as an unsigned number, modulo n."""
    h = F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(h, F.lit(n)).cast("long")


def data_category(key: Column, n: int = 15, seed: int = 0) -> Column:
    return F.concat(F.lit("cat_"), F.lpad(stable_bucket(key, n, seed).cast("string"), max(2, len(str(n - 1))), "0"))


def order_hash(key: Column, seed: int = 0) -> Column:
    """What seeded choices are ordered by: SHA-1 of 'seed:key', the same in any SQL engine."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def order_free_hash(hashes: DataFrame, column: str) -> DataFrame:
    """content_hash, n: one hash of a set of distinct hex hashes. Those with the same three leading digits are hashed in order, then the 4,096 results at most."""
    part = hashes.groupBy(F.substring(column, 1, 3).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(column)), "").cast("binary"), 256).alias("b"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("p", "b"))), lambda x: x["b"])
    return part.agg(F.sha2(F.array_join(ordered, "").cast("binary"), 256).alias("content_hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
