"""Data-quality checks: each is a count that ought to be 0, or is compared with what is expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_checks(df: DataFrame) -> DataFrame:
    """name, n of the response log: missing and odd values, extra copies, pairs with two labels."""
    bad = F.col("condition").isNull() | (F.col("condition") == "") | F.lower("condition").isin("nan", "null")
    one = df.agg(
        F.count_if(F.col("subject_id").isNull()).alias("missing_subject"), F.count_if(F.col("test_condition").isNull()).alias("missing_condition"), F.count_if((F.col("response") < 0) | (F.col("response") > 1)).alias("label_outside"),
        F.count_if(bad).alias("condition_not_normalised"))
    extra = df.groupBy("subject_id", "item_key", "label").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicate_rows"))
    odd = df.groupBy("subject_id", "item_key").agg(F.countDistinct("label").alias("k")).agg(F.count_if(F.col("k") > 1).alias("inconsistent_pairs"))
    wide = one.crossJoin(extra).crossJoin(odd)  # one row each
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in wide.columns))).alias("x")).select("x.*")


def embedding_checks(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One row: rows, keys, least and largest size, rows with what isn't finite, rows of norm 0."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm2 = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_keys"), F.min(F.size(v)).cast("long").alias("d_min"), F.max(F.size(v)).cast("long").alias("d_max"), F.count_if(bad).alias("n_bad"), F.count_if(norm2 <= 1e-12).alias("n_zero"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """keys, n of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def fold_gates(folds: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """n_missing, n_twice, n_folds, spread: keys of rows without a fold, keys in two folds, folds, and largest less smallest fold."""
    sizes = folds.groupBy("fold").agg(F.count("*").alias("k"))
    a = rows.select(key).distinct().join(folds, key, "left_anti").agg(F.count("*").alias("n_missing"))
    b = duplicates(folds, key).agg(F.count("*").alias("n_twice"))
    return a.crossJoin(b).crossJoin(sizes.agg(F.count("*").alias("n_folds"), (F.max("k") - F.min("k")).alias("spread")))
