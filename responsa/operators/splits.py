"""Splits, folds, samples and budgets. Seeded choices go by SHA-1 of 'seed:key', so that any engine picks the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from responsa.functions.keys import order_hash


def hash_rank(df: DataFrame, key: str, seed: int = 0, parts: int = 256) -> DataFrame:
    """df (key unique) with hash_rank from 1 and total: the place of each key in the order of its hash.

    Ranks count whole groups of hashes first: groups of the leading two hex digits are
    ranked each in its own task, and the counts of at most 256 groups are summed up.
    """
    rows = df.withColumn("_h", order_hash(F.col(key), seed)).withColumn("_g", F.substring("_h", 1, 2))
    sizes = rows.groupBy("_g").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_g")
    before = sizes.select("_g", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    rank = F.row_number().over(Window.partitionBy("_g").orderBy("_h", key))
    return rows.join(F.broadcast(before), "_g").withColumn("hash_rank", F.col("_before") + rank).drop("_h", "_g", "_before")


def cold_start(df: DataFrame, val_fraction: float = 0.05, seed: int = 0, holdout: list[str] | None = None, key: str = "item_split_key") -> DataFrame:
    """df with split: train, val or val_unseen (a subject that train doesn't have). Items are on one side only."""
    pool = df.select(key, "benchmark").distinct()
    held = F.col("benchmark").isin(holdout or []) if holdout else F.lit(False)
    normal = pool.filter(~held).select(key).distinct()
    chosen = hash_rank(normal, key, seed).filter(F.col("hash_rank") <= F.bround(F.lit(val_fraction) * F.col("total"))).select(key)
    val = chosen.unionByName(pool.filter(held).select(key)).distinct().withColumn("_val", F.lit(True))
    return _sides(df.join(val, key, "left").withColumn("_val", F.coalesce("_val", F.lit(False))))


def heldout(df: DataFrame, holdout: list[str]) -> DataFrame:
    if not holdout:
        raise ValueError("one benchmark at least is to be held out")
    return _sides(df.withColumn("_val", F.col("benchmark").isin(holdout)))


def random_rows(df: DataFrame, key: str, val_fraction: float = 0.05, seed: int = 0) -> DataFrame:
    """Leaks items; for comparison only. key: unique."""
    return _sides(hash_rank(df, key, seed).withColumn("_val", F.col("hash_rank") <= F.bround(F.lit(val_fraction) * F.col("total"))).drop("hash_rank", "total"))


def _sides(df: DataFrame) -> DataFrame:
    seen = df.filter(~F.col("_val")).select("subject_id").distinct().withColumn("_seen", F.lit(True))
    side = F.when(~F.col("_val"), "train").when(F.col("_seen"), "val").otherwise("val_unseen")
    return df.join(seen, "subject_id", "left").withColumn("split", side).drop("_val", "_seen")


def leaks(split: DataFrame, key: str = "item_split_key") -> DataFrame:
    """n_shared_keys (must be 0), n_unseen_subjects."""
    train, val = split.filter("split = 'train'"), split.filter("split <> 'train'")
    shared = train.select(key).intersect(val.select(key)).agg(F.count("*").alias("n_shared_keys"))
    unseen = val.select("subject_id").subtract(train.select("subject_id")).agg(F.count("*").alias("n_unseen_subjects"))
    return shared.crossJoin(unseen)


def folds(df: DataFrame, key: str, n: int = 5, seed: int = 0) -> DataFrame:
    """key, fold (from 0): groups of keys by hash, sizes within one, the larger ones first."""
    r = hash_rank(df.select(key).distinct(), key, seed)
    size, rest = F.floor(F.col("total") / n), F.col("total") % n
    large = rest * (size + 1)
    fold = F.when(F.col("hash_rank") <= large, F.floor((F.col("hash_rank") - 1) / (size + 1))).otherwise(rest + F.floor((F.col("hash_rank") - 1 - large) / F.greatest(size, F.lit(1))))
    return r.select(key, fold.cast("long").alias("fold"))


def pick(df: DataFrame, key: str, fraction: float, seed: int = 0, least: int = 1) -> DataFrame:
    """The distinct keys that come first by hash: a rounded share, `least` at least."""
    r = hash_rank(df.select(key).distinct(), key, seed)
    return r.filter(F.col("hash_rank") <= F.greatest(F.bround(F.lit(fraction) * F.col("total")), F.lit(least))).select(key)


def half(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """key, side: fit for the first half (rounded down) by hash, else eval."""
    r = hash_rank(df.select(key).distinct(), key, seed)
    return r.select(key, F.when(F.col("hash_rank") <= F.floor(F.col("total") / 2), "fit").otherwise("eval").alias("side"))


def allocate(capacities: dict[str, int], n: int, seed: int = 0) -> dict[str, int]:
    """n places over few categories: level shares, the slack of full ones dealt again, the remainder in hash order."""
    import hashlib

    out, free = dict.fromkeys(capacities, 0), dict(capacities)
    left = min(n, sum(free.values()))
    while left:
        pending = sorted((c for c in free if free[c] > 0), key=lambda c: (hashlib.sha1(f"{seed}:{c}".encode()).hexdigest(), c))
        base = left // len(pending)
        for c in pending if base else pending[:left]:
            k = min(base or 1, free[c])
            out[c] += k
            free[c] -= k
            left -= k
        if not base:
            break
    return out


def stratified(df: DataFrame, key: str, category: str, n: int, seed: int = 0) -> DataFrame:
    """n distinct (key, category) rows, categories served alike, without replacement."""
    rows = df.select(key, category).distinct()
    caps = {r[0]: r[1] for r in rows.groupBy(category).count().collect()}  # few categories
    share = F.lit(0)
    for c, k in allocate(caps, n, seed).items():
        share = F.when(F.col(category) == c, k).otherwise(share)
    rank = F.row_number().over(Window.partitionBy(category).orderBy(order_hash(F.col(key), seed), key))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= share).drop("_r")


def top_k(df: DataFrame, category: str, score: Column, tie: Column, k: int) -> DataFrame:
    """The k rows of each category with the highest scores; ties to the least `tie`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(category).orderBy(score.desc(), tie.asc())).cast("long")).filter(F.col("rank") <= k)


def quantile_buckets(train: DataFrame, rows: DataFrame, column: str, n: int = 4) -> DataFrame:
    """rows with bucket (from 0): how many of train's distinct inner quantiles the value exceeds."""
    cuts = train.agg(F.array_distinct(F.percentile(column, F.array(*(F.lit(k / n) for k in range(1, n))))).alias("_cuts"))
    return rows.crossJoin(cuts).withColumn("bucket", F.size(F.filter("_cuts", lambda c: F.col(column) > c)).cast("long")).drop("_cuts")


def redaction(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """df with redacted: whether its (item, condition) pair is among a rounded share of pairs."""
    pairs = df.withColumn("_pair", F.concat_ws("|", "item_id", "bc"))
    chosen = pick(pairs, "_pair", fraction, seed, 0).withColumn("_hit", F.lit(True))
    return pairs.join(chosen, "_pair", "left").withColumn("redacted", F.coalesce("_hit", F.lit(False))).drop("_pair", "_hit")


def permuted_labels(df: DataFrame, key: str, label: str, seed: int = 0) -> DataFrame:
    """key, label of the row whose rank by hash is the key's rank under another seed; a permutation."""
    a = hash_rank(df.select(key, label), key, seed).select("hash_rank", F.col(label).alias("permuted"))
    b = hash_rank(df.select(key, label), key, seed + 1).select("hash_rank", key, label)
    return b.join(a, "hash_rank").drop("hash_rank")
