"""Nearest neighbours by a permutation index.

Pivots: at most PIVOTS vectors, the least by hash of id (a documented, bounded sample).
A vector is represented by its PREFIX nearest pivots, in order. Rows are dealt into
blocks of about BLOCK rows; each block posts its rows in an inverted file for each pivot,
with the pivot's place in the row's order. A query's footrule distance to a row of the
block is summed over the files of its own pivots, a missing pivot counting as place PREFIX.
The nearest SHARE of the block, with all ties at the edge, are reranked by the exact
inner product in double precision. Queries come in chunks of CHUNK; a task
holds one block and one chunk. Vectors of any norm are ranked by inner product: for the
permutations each row gets one more coordinate that lifts it to the largest norm.

Null, zero, or holding null or non-finite components: no part in it, as query or as row. Ties go to
the smaller id. Fewer rows than k: all of them. Empty table: no rows. An id that repeats
is one candidate for each of its rows, but never its own neighbour. Vectors of different sizes
have no inner product: each size is searched by itself, and sizes are few. Long vectors are
taken whole; other columns, whatever their names, are not read.

A chunk meets every block, so work and shuffle grow with queries times rows: the query set is a
fixed share of the rows. Larger blocks and chunks lower the shuffle, smaller ones the memory.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, table

K, PIVOTS, PREFIX, BLOCK, CHUNK, SHARE = 20, 256, 64, 16_384, 4_096, 0.3


def clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (doubles), norm2 of usable rows."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v")).filter("v IS NOT NULL").filter(finite)
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).filter("norm2 > 0")


def orders(v: np.ndarray, lift: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """[rows, prefix]: each row's nearest pivots, nearest first, by distance of the lifted vectors."""
    near = v @ pivots[:, :-1].T + lift[:, None] * pivots[:, -1]
    near -= (pivots**2).sum(axis=1) / 2
    prefix = min(prefix, len(pivots))
    top = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
    by = np.argsort(-np.take_along_axis(near, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, by, axis=1)


def score(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", rows, q)


def search(left: pd.DataFrame, right: pd.DataFrame, pivots: np.ndarray, top_norm2: float, k: int, share: float, prefix: int) -> pd.DataFrame:
    """left: rows of a block; right: queries of a chunk."""
    out: list[list] = [[], [], []]
    if len(left) and len(right):
        v = np.stack(left.v.to_list())
        ids = left.id.to_numpy()
        own = orders(v, np.sqrt(np.maximum(top_norm2 - left.norm2.to_numpy(), 0)), pivots, prefix)
        width = own.shape[1]
        at = np.argsort(own, axis=None, kind="stable")
        ends = np.searchsorted(own.ravel()[at], np.arange(len(pivots) + 1))
        files = [(at[a:b] // width, (at[a:b] % width).astype(np.int32)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        asked = orders(np.stack(right.v.to_list()), np.zeros(len(right)), pivots, prefix)
        places = width * (width - 1) // 2
        least = min(len(ids), max(200, 10 * k, int(np.ceil(share * len(ids)))))
        for qid, q, order in zip(right.id.to_list(), right.v.to_list(), asked, strict=True):
            # |place - place'| over shared pivots, and width - place for each unshared one on either side
            gap = np.full(len(ids), width * width * 2 - 2 * places, np.int32)
            for place, pivot in enumerate(order.tolist()):
                rows, where = files[pivot]
                gap[rows] += np.abs(where - place) - (width - place) - (width - where)
            edge = np.partition(gap, least - 1)[least - 1]
            found = np.flatnonzero((gap <= edge) & (ids != qid))
            s = score(v[found], np.asarray(q))
            n = min(k, len(found))
            if not n:
                continue
            cut_at = np.partition(-s, n - 1)[n - 1]
            some = np.flatnonzero(-s <= cut_at)
            some = some[np.lexsort([ids[found[some]], -s[some]])][:n]
            out[0] += [qid] * len(some)
            out[1] += ids[found[some]].tolist()
            out[2] += s[some].tolist()
    return pd.DataFrame({"query_id": pd.Series(out[0], dtype="int64"), "vec_id": pd.Series(out[1], dtype="int64"), "score": pd.Series(out[2], dtype="float64")})


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """rows, queries: id, v, norm2 as of clean(). query_id, rank, vec_id, score."""
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max("norm2").alias("top")).orderBy("d").collect()
    if not sizes:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    of = lambda df, s: df.filter(F.size("v") == s.d)
    return reduce(DataFrame.unionByName, (_nearest(of(rows, s), of(queries, s), s, k, pivots, prefix, share, block, chunk) for s in sizes))


def _nearest(rows: DataFrame, queries: DataFrame, size: Row, k: int, pivots: int, prefix: int, share: float, block: int, chunk: int) -> DataFrame:
    """nearest() for vectors of one size (d, n rows, the largest norm2)."""
    asked = queries.count()
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    p = np.array([[*r.v, np.sqrt(max(size.top - r.norm2, 0))] for r in picked])
    blocks, chunks = max(1, -(-size.n // block)), max(1, -(-asked // chunk))
    left = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"), "id", "v", "norm2")
    right = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(chunks)).cast("int").alias("c"), "id", "v")
    top = float(size.top)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return search(a, b, p, top, k, share, prefix)

    found = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(clean(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return nearest(rows, rows.filter(F.col("id") % 20 == 0))
