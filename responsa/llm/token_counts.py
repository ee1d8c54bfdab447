"""Exact histogram of encoded lengths, and what suffix sums of it answer for every context limit.

A limit between two lengths that occur answers as the next lower one does, but for its
truncated total, which is tokens_le + limit * docs_gt of that row. The suffix sums go by
blocks of lengths: sums within a block, plus the totals of the blocks above; no task
gets all lengths. Null or empty text: length 0. Very long texts are encoded whole. Empty table: no
rows. Repeated rows count each; documents of one length share a row, so ties don't arise. Columns
besides text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import cut, table

BLOCK = 256


def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """n_tokens of each document, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 for x in enc.ids(b.column(0).to_pylist())], pa.int64())], ["n_tokens"])

    return docs.select("text").mapInArrow(run, "n_tokens long")


def histogram(lengths_df: DataFrame) -> DataFrame:
    return lengths_df.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each length that occurs. hist should be stored: it is read more than once.

    n_tokens; n_docs of that length; docs_le, tokens_le and docs_gt, tokens_gt (at most that
    length; longer); truncated_total (tokens kept when it is the limit); lost_total; quantile
    (share of documents at most that long).
    """
    hist = hist.select("n_tokens", "n_docs").withColumn("block", F.floor(F.col("n_tokens") / block))
    sums = [F.sum("n_docs").alias("d"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("t")]
    blocks = hist.groupBy("block").agg(*sums)
    # blocks are few (longest length / 256): pairs of blocks by super-blocks of 256 blocks
    blocks = blocks.withColumn("upper", F.floor(F.col("block") / block))
    uppers = blocks.groupBy("upper").agg(F.sum("d").alias("d"), F.sum("t").alias("t"))
    total = F.broadcast(uppers.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("all_d"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")))
    upto = Window.orderBy("upper").rowsBetween(Window.unboundedPreceding, -1)
    uppers = uppers.select("upper", F.coalesce(F.sum("d").over(upto), F.lit(0)).alias("ud"), F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("ut"))
    upto = Window.partitionBy("upper").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocks.join(uppers, "upper")
        .withColumn("bd", F.col("ud") + F.coalesce(F.sum("d").over(upto), F.lit(0)))
        .withColumn("bt", F.col("ut") + F.coalesce(F.sum("t").over(upto), F.lit(0)))
        .select("block", "bd", "bt")
    )
    upto = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    return (
        hist.join(blocks, "block")
        .crossJoin(total)  # one row
        .withColumn("docs_le", F.col("bd") + F.sum("n_docs").over(upto))
        .withColumn("tokens_le", F.col("bt") + F.sum(F.col("n_tokens") * F.col("n_docs")).over(upto))
        .withColumn("docs_gt", F.col("all_d") - F.col("docs_le"))
        .withColumn("tokens_gt", F.col("all_t") - F.col("tokens_le"))
        .withColumn("truncated_total", F.col("tokens_le") + F.col("n_tokens") * F.col("docs_gt"))
        .select(
            "n_tokens", "n_docs", "docs_le", "tokens_le", "docs_gt", "tokens_gt", "truncated_total",
            (F.col("all_t") - F.col("truncated_total")).alias("lost_total"),
            (F.col("docs_le") / F.col("all_d")).alias("quantile"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits(cut(histogram(lengths(table(spark, sf_dir, "documents")))))
