"""Scoring with parameters fitted elsewhere, and the small fits that Spark does itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from responsa.functions.normalize import logit, sigmoid
from responsa.operators.neighbors import dot


def factor_logit(mu: Column, a: Column, b: Column, d: Column, u: Column, v: Column) -> dict[str, Column]:
    """mu + a + b - d + u.v / sqrt(k), and its components."""
    cross = dot(u, v) / F.sqrt(F.greatest(F.size(u), F.lit(1)))
    return {"logit": mu + a + b - d + cross, "subject": a, "condition": b, "item": -d, "interaction": cross}


def irt_logit(alpha: Column, theta: Column, beta: Column, b: Column, mu: Column, rho: float = 0.0, u: Column | None = None, v: Column | None = None) -> Column:
    """alpha (theta - beta) + b + mu; the hybrid adds rho times the factor term."""
    z = alpha * (theta - beta) + b + mu
    return z if u is None else z + rho * dot(u, v) / F.sqrt(F.greatest(F.size(u), F.lit(1)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def residual_probability(init: Column, total: Column) -> Column:
    return sigmoid(logit(init) + total)


def walk_trees(trees: list[dict], x: np.ndarray, bias: float = 0.0) -> np.ndarray:
    """Sum of leaves over trees of arrays feature, threshold, left, right, value, default_left; a leaf has feature -1. What is at most the threshold goes left, NaN by default_left."""
    out = np.full(len(x), bias)
    for t in trees:
        at = np.zeros(len(x), np.int64)
        feature, threshold, left, right, value, default = (np.asarray(t[k]) for k in ("feature", "threshold", "left", "right", "value", "default_left"))
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            n = at[rows]
            v = x[rows, feature[n]]
            at[rows] = np.where(np.where(np.isnan(v), default[n].astype(bool), v <= threshold[n]), left[n], right[n])
        out += value[at]
    return out


def score_trees(df: DataFrame, key: str, features: list[str], trees: list[dict], bias: float = 0.0) -> DataFrame:
    """key, raw."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "raw": walk_trees(trees, b[features].to_numpy(float), bias)})

    return df.select(key, *(F.col(f).cast("double") for f in features)).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, raw double")


def field_pairs(x: Column, vectors: list[list[float]], fields: list[int], r: list[list[float]], w: list[float], bias: float) -> Column:
    """Field-weighted factorisation: linear part, and for each pair of fields r times the dot product of their sums of weighted vectors (within a field, over pairs of distinct features)."""
    n, k = len(vectors), len(vectors[0])
    xi = [F.get(x, F.lit(i)).cast("double") for i in range(n)]
    sums = {f: [sum((xi[i] * vectors[i][j] for i in range(n) if fields[i] == f), F.lit(0.0)) for j in range(k)] for f in sorted(set(fields))}
    z = F.lit(bias) + sum((xi[i] * w[i] for i in range(n)), F.lit(0.0))
    for f in sums:
        own = sum((s * s for s in sums[f]), F.lit(0.0)) - sum((xi[i] * xi[i] * float(np.dot(vectors[i], vectors[i])) for i in range(n) if fields[i] == f), F.lit(0.0))
        z = z + r[f][f] * 0.5 * own
        for g in sums:
            if g > f:
                z = z + r[f][g] * sum((a * b for a, b in zip(sums[f], sums[g], strict=True)), F.lit(0.0))
    return z


def kmeans(df: DataFrame, k: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(cluster from 1 and centre; id and cluster) of df: id, v."""
    rows = df.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(rows)
    centres = df.sparkSession.createDataFrame([(i + 1, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, c array<double>")
    return centres, model.transform(rows).select("id", (F.col("prediction") + 1).alias("cluster"))


def pca(df: DataFrame, k: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the components after the first `skip`, from one distributed sum of the d * d second moments."""
    rows = df.select(F.col("v").cast("array<double>").alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, c = 0, None, None
        for b in batches:
            if len(b):
                x = np.stack(b.v.to_list())
                n, s, c = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if c is None else c)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "c": [c.ravel().tolist()]})

    parts = rows.mapInPandas(run, "n long, s array<double>, c array<double>")
    add = F.posexplode
    n = parts.agg(F.sum("n")).first()[0]
    s = np.array([r[1] for r in parts.select(add("s").alias("i", "x")).groupBy("i").agg(F.sum("x")).orderBy("i").collect()]) / n
    c = np.array([r[1] for r in parts.select(add("c").alias("i", "x")).groupBy("i").agg(F.sum("x")).orderBy("i").collect()]).reshape(len(s), -1) / n - np.outer(s, s)
    values, vectors = np.linalg.eigh(c)
    basis = vectors[:, ::-1][:, skip : skip + k].T
    return s, basis * np.where(basis[np.arange(len(basis)), np.abs(basis).argmax(1)] < 0, -1, 1)[:, None]


def project(v: Column, basis: np.ndarray, mean: np.ndarray | None = None) -> Column:
    """Coordinates on the components; centred only if a mean is given."""
    shift = [0.0] * basis.shape[1] if mean is None else mean.tolist()
    lit = lambda xs: F.array(*map(F.lit, map(float, xs)))
    centred = F.zip_with(v, lit(shift), lambda x, m: x.cast("double") - m)
    return F.array(*(dot(centred, lit(b)) for b in basis))


def ridge(df: DataFrame, y: str, weight: str, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a weighted ridge fit of y on v; the bias isn't penalised. Normal equations are summed in Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, h = None, None
        for b in batches:
            if len(b):
                x = np.concatenate([np.stack(b.v.to_list()), np.ones((len(b), 1))], axis=1)
                w = b["w"].to_numpy(float)[:, None]
                g, h = (x * w).T @ b["y"].to_numpy(float) + (0 if g is None else g), (x * w).T @ x + (0 if h is None else h)
        if g is not None:
            yield pd.DataFrame({"m": [np.concatenate([g, h.ravel()]).tolist()]})

    rows = df.select(F.col("v").cast("array<double>").alias("v"), F.col(y).cast("double").alias("y"), F.col(weight).cast("double").alias("w"))
    m = np.array([r[1] for r in rows.mapInPandas(run, "m array<double>").select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x")).orderBy("i").collect()])
    d = int((np.sqrt(1 + 4 * len(m)) - 1) / 2)
    pen = np.diag([l2] * (d - 1) + [1e-9])
    w = np.linalg.solve(m[d:].reshape(d, d) + pen, m[:d])
    return w[:-1], float(w[-1])
