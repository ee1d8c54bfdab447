"""Scoring with small networks whose weights were exported: gated layers, crosses, gated residuals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def gated(x: np.ndarray, value: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """(x value) * sigmoid(x gate), with a constant feature for the biases."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    return (x @ value) * sigmoid(x @ gate)


def cross(x0: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """x <- x0 * (x V U + b) + x for each layer (V, U, b)."""
    x = x0
    for v, u, b in layers:
        x = x0 * (x @ v @ u + b) + x
    return x


def gated_residual(x: np.ndarray, gate: np.ndarray, up: np.ndarray, down: np.ndarray, scale: float, eps: float = 1e-5) -> np.ndarray:
    """x + scale * down(silu(gate) * up) of x normalised by row."""
    n = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + eps)
    g = n @ gate
    return x + scale * ((g * sigmoid(g)) * (n @ up)) @ down


def example(d: int, h: int, seed: int = 0) -> dict:
    """Weights to try the scorer with."""
    r = np.random.default_rng(seed)
    w = lambda *s: r.normal(size=s) / np.sqrt(s[0])
    return {"residual": (w(d, h), w(d, h), w(h, d), 0.1), "cross": [(w(d, h), w(h, d), w(d)) for _ in range(2)], "glu": [(w(d + 1, h), w(d + 1, h)), (w(h + 1, h), w(h + 1, h))], "head": w(d + h)}


def forward(x: np.ndarray, net: dict, eps: float = 1e-6) -> np.ndarray:
    x = gated_residual(x, *net["residual"])
    g = x
    for layer in net["glu"]:
        g = gated(g, *layer)
    return np.clip(sigmoid(np.concatenate([cross(x, net["cross"]), g], axis=1) @ net["head"]), eps, 1 - eps)


def score(df: DataFrame, net: dict) -> DataFrame:
    """id, p of df (id, v); the weights go along with the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b.id, "p": forward(np.stack(b.v.to_list()).astype(float), net)})

    return df.select("id", "v").mapInPandas(run, "id long, p double")
