"""Evaluation rounds: sample, score, label within a budget, predict, score."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from responsa.functions.keys import order_hash
from responsa.operators import metrics, splits

#: What user code sees of a row: never a label.
INPUTS = ["benchmark", "condition", "subject_content", "item_content"]


def inputs(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in INPUTS))


def _number(x: object) -> float:
    try:
        return float(x)
    except (TypeError, ValueError):
        return math.nan


def predict(df: DataFrame, key: str, f: Callable[..., object], labelled: list[dict] | None = None) -> DataFrame:
    """key, p: f(benchmark, condition, subject_content, item_content, labelled) on each row; NaN where it raises or gives no number. labelled is within a label budget."""
    told = labelled or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b[INPUTS].itertuples(index=False, name=None):
                try:
                    out.append(_number(f(*row, told)))
                except Exception:  # noqa: BLE001  user code may raise anything
                    out.append(math.nan)
            yield pd.DataFrame({key: b[key], "p": out})

    # Arrow turns NaN into null on the way
    return inputs(df, key).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, p double").withColumn("p", F.coalesce("p", F.lit(math.nan)))


def acquire(df: DataFrame, key: str, f: Callable[..., object], seed: int = 0) -> DataFrame:
    """key, score of a stateless scoring function; if any score raises or isn't finite, the whole round is scored by hash instead."""
    scored = predict(df, key, lambda *a: f(*a[:4]))
    bad = scored.agg(F.count_if(F.isnan("p") | (F.abs("p") == float("inf"))).alias("bad"))
    h = F.conv(F.substring(order_hash(F.col(key), seed), 1, 8), 16, 10).cast("double") / 2**32
    return scored.crossJoin(bad).select(key, F.when(F.col("bad") > 0, h).otherwise(F.col("p")).alias("score"))


def run_round(df: DataFrame, predictor: Callable[..., object], acquisition: Callable[..., object], n_variants: int, k: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows with p and labelled, one row of scores). df: row_id, item_variant_id, data_category, label and the inputs."""
    chosen = splits.stratified(df, "item_variant_id", "data_category", n_variants, seed).select("item_variant_id")
    # few rows of the log, and what follows reads them again and again: kept, so that the log is not
    rows = df.join(chosen, "item_variant_id", "left_semi").persist()
    scored = rows.join(acquire(rows, "row_id", acquisition, seed), "row_id")
    top = splits.top_k(scored, "data_category", F.col("score"), order_hash(F.col("row_id"), seed), k).select("row_id").withColumn("labelled", F.lit(True))
    told = [r.asDict() for r in inputs(rows.join(top, "row_id", "left_semi"), "label").collect()]  # k rows of each of few categories
    out = rows.join(top, "row_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False))).join(predict(rows, "row_id", predictor, told), "row_id")
    return out, metrics.round_score(out.withColumn("p", F.nanvl("p", F.lit(0.5))))
