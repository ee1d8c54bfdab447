"""Boosted trees for binary labels, grown level by level on histograms that Spark sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from responsa.functions.normalize import sigmoid


def edges_of(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """For each feature at most bins - 1 inner quantiles; NaN and null have a bin of their own."""
    got = df.agg(*(F.percentile_approx(F.when(~F.isnan(F.col(f)), F.col(f).cast("double")), [k / bins for k in range(1, bins)], 100_000).alias(f) for f in features)).first()
    return [sorted(set(got[f] or [])) for f in features]


def bin_of(feature: str, edges: list[float]) -> Column:
    """How many edges are below the value; -1 where it is missing."""
    x = F.col(feature).cast("double")
    below = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < x)) if edges else F.lit(0)
    return F.when(x.isNull() | F.isnan(x), -1).otherwise(below)


def leaf_of(tree: dict, features: list[str]) -> Column:
    """The number of the node a row ends in."""

    def walk(node: int) -> Column:
        f = tree["feature"][node]
        if f < 0:
            return F.lit(node)
        c = F.col(features[f]).cast("double")
        left = F.when(c.isNull() | F.isnan(c), F.lit(bool(tree["default_left"][node]))).otherwise(c <= float(tree["threshold"][node]))
        return F.when(left, walk(tree["left"][node])).otherwise(walk(tree["right"][node]))

    return walk(0)


def value_of(tree: dict, features: list[str]) -> Column:
    leaf, out = leaf_of(tree, features), F.lit(0.0)
    for n, f in enumerate(tree["feature"]):
        if f < 0:
            out = F.when(leaf == n, float(tree["value"][n])).otherwise(out)
    return out


def gain(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / (h + l2)


def fit(df: DataFrame, features: list[str], y: str, trees: int = 10, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0, least: float = 1.0) -> tuple[float, list[dict]]:
    """(bias, trees in the form that models.walk_trees takes), second-order gradients of the log-loss.

    A level of a tree is one distributed sum by (node, feature, bin); only those sums, at most
    2 ** depth * features * (bins + 1), reach the driver. Missing values go to the side that gains more.
    """
    edges = edges_of(df, features, bins)
    mean = df.agg(F.avg(F.col(y).cast("double"))).first()[0]
    p0 = min(max(mean if mean is not None else 0.5, 1e-6), 1 - 1e-6)
    bias = float(np.log(p0 / (1 - p0)))
    score = F.lit(bias)
    place = [bin_of(f, e) for f, e in zip(features, edges, strict=True)]
    # the score so far is stored once a tree, so that plans don't grow with their number
    rows = df.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(y).cast("double").alias("_y"), F.array(*place).alias("_bins"), score.alias("_z")).persist()
    out = []
    for _ in range(trees):
        tree = {"feature": [-1], "threshold": [0.0], "left": [0], "right": [0], "value": [0.0], "default_left": [1]}
        q = sigmoid(F.col("_z"))
        open_nodes = [0]
        for level in range(depth + 1):
            node = leaf_of(tree, features)
            sums = rows.withColumn("_n", node).filter(F.col("_n").isin(open_nodes)).select("_n", (q - F.col("_y")).alias("g"), (q * (1 - q)).alias("h"), F.posexplode("_bins").alias("f", "b"))
            got = sums.groupBy("_n", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            hist = {n: np.zeros((len(features), bins + 1, 2)) for n in open_nodes}
            for r in got:
                hist[r._n][r.f, r.b + 1] += (r.g, r.h)
            new = []
            for n in open_nodes:
                total = hist[n][0].sum(axis=0)
                tree["value"][n] = float(-rate * total[0] / (total[1] + l2))
                if level == depth:
                    continue
                best = (1e-9, None)
                for f, e in enumerate(edges):
                    missing, below = hist[n][f, 0], np.cumsum(hist[n][f, 1:], axis=0)
                    for default in (1, 0):
                        left = below[: len(e)] + (missing if default else 0)
                        right = total - left
                        ok = (left[:, 1] >= least) & (right[:, 1] >= least)
                        won = np.where(ok, gain(left[:, 0], left[:, 1], l2) + gain(right[:, 0], right[:, 1], l2) - gain(total[0], total[1], l2), -np.inf)
                        if len(won) and won.max() > best[0]:
                            best = (float(won.max()), (f, float(e[int(won.argmax())]), default))
                if best[1]:
                    f, threshold, default = best[1]
                    at = len(tree["feature"])
                    tree["feature"][n], tree["threshold"][n], tree["left"][n], tree["right"][n], tree["default_left"][n] = f, threshold, at, at + 1, default
                    for c in ("feature", "threshold", "left", "right", "value", "default_left"):
                        tree[c] += [{"feature": -1, "threshold": 0.0, "left": 0, "right": 0, "value": 0.0, "default_left": 1}[c]] * 2
                    new += [at, at + 1]
            open_nodes = new
            if not open_nodes:
                break
        out.append(tree)
        before, rows = rows, rows.withColumn("_z", F.col("_z") + value_of(tree, features)).persist()
        rows.count()
        before.unpersist()
    rows.unpersist()
    return bias, out


def scores(features: list[str], bias: float, trees: list[dict]) -> Column:
    return sum((value_of(t, features) for t in trees), F.lit(bias))
