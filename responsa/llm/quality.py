"""Quality scores by a linear model on n-gram indicators that class log-count ratios scale.

Features, each an indicator with a 64-bit hash as its name: words and word pairs in lower
case; shapes of words (letters x or X, digits d, runs shortened) and pairs of shapes; how
large a share of the words has a shape, in powers of two; how large a share of the lines
repeats an earlier line. Dual coordinate descent fits a linear model with hinge loss, on
features scaled by their log-count ratios r; it uses at most SAMPLE training rows, the least
by hash of doc_id (a documented bound). A feature has a weight if TEXTS texts of the sample
hold it; counts for its ratio cover all training rows. Others would have weight 0 or the
weight of one text, so they aren't counted: the model's size follows the sample, and no
features share a slot. A logistic curve, fitted on a fifth of the sample that the descent
leaves out, turns margins into scores.

Null and empty texts have no features; their score comes from the bias. Without
training rows of both classes the score is the share of class 1 (0.5 without any).
Labels of one document that disagree count each. Ties of the sample's hash go to the smaller
doc_id. Whole texts count, however long; a long one has more features, and its vector has
length 1 before scaling as any other. Empty table: no rows. Repeated rows, extra columns and
clashing names: each row is scored on its own, from doc_id and text alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held_out, mix, sole, table, tidy

SAMPLE, TEXTS, ALPHA, COST, EPOCHS = 12_000, 2, 1.0, 0.1, 20


def shape(word: str) -> str:
    s = "".join("X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", s)


class Words:
    """Hashes of words and of their shapes by number; emptied when full, so that its memory is bounded."""

    def __init__(self, most: int = 300_000):
        self.most, self.number = most, {}
        self.word, self.shape = np.zeros(most, np.uint64), np.zeros(most, np.uint64)

    def numbers(self, ws: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.number.__getitem__, ws), np.int64, len(ws))
        except KeyError:
            new = [w for w in dict.fromkeys(ws) if w not in self.number]
        if len(self.number) + len(new) > self.most:
            self.number, new = {}, list(dict.fromkeys(ws))
            if len(new) > self.most:  # a text of more words than fit: the table grows to it
                self.most = len(new)
                self.word, self.shape = np.zeros(self.most, np.uint64), np.zeros(self.most, np.uint64)
        at = len(self.number)
        self.word[at : at + len(new)] = [xxhash.xxh64_intdigest(w.lower().encode("utf-8", "surrogatepass")) for w in new]
        self.shape[at : at + len(new)] = [xxhash.xxh64_intdigest(shape(w).encode("utf-8", "surrogatepass"), 7) for w in new]
        self.number.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.number.__getitem__, ws), np.int64, len(ws))


def features(text: str | None, cache: Words) -> np.ndarray:
    """The text's sorted distinct features."""
    ws = text.split() if text else []
    if not ws:
        return np.zeros(0, np.uint64)
    at = cache.numbers(ws)
    w, s = cache.word[at], cache.shape[at]
    kinds, counts = np.unique(s, return_counts=True)
    share = np.floor(-np.log2(counts / len(ws))).astype(np.uint64)
    lines = Counter(x for x in text.split("\n") if x.strip())
    again = sum(lines.values()) - len(lines)
    repeat = np.uint64(0 if not again else 1 + min(6, int(-math.log2(again / sum(lines.values())))))
    x = np.concatenate([w, mix(w[1:] * np.uint64(3) + w[:-1]), kinds, mix(s[1:] * np.uint64(5) + s[:-1]), mix(kinds * np.uint64(11) + share), mix(np.array([repeat + np.uint64(101)], np.uint64))])
    return np.unique(x)


@dataclass
class Model:
    names: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> float:
        if not len(x):
            return self.bias
        at, hit = find(self.names, x)
        return float(self.weights[at[hit]].sum() / math.sqrt(len(x))) + self.bias

    def score(self, x: np.ndarray) -> float:
        z = self.slope * self.margin(x) + self.offset
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def find(names: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of x would stand in sorted names, and whether it does."""
    if not len(names):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    return at, names[at] == x


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, label of training rows only. One kind of join at every size; of labels with very many rows of one doc_id, adaptive execution splits the rows."""
    known = labels.filter(~held_out(F.col("doc_id"), 4, 2) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    return docs.filter(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "text").join(known.hint("shuffle_hash"), "doc_id")


def sampled(labels: DataFrame, n: int, sample: int) -> DataFrame:
    """doc_id, label of at most `sample` training rows, the least by hash of doc_id; n: how many there are."""
    rows = labels.filter(~held_out(F.col("doc_id"), 4, 2) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    # of n hashes, the sample's least are below this but for one case in very many; it spares the sort the rest
    share = min(1.0, (sample + 8 * math.sqrt(sample) + 8) / max(n, 1))
    few = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 60)) <= F.lit(int(share * (1 << 60))))
    return few.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 60)), "doc_id", "label").limit(sample)


def class_counts(rows: DataFrame, names: np.ndarray) -> DataFrame:
    """at (place in names), pos, neg: documents of each class with that feature. Place -1 counts documents. At most len(names) + 1 rows a task before the sum."""
    sent = rows.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache, n = sent.value, sole("quality", Words), [0, 0]
        counts = np.zeros((2, len(known)), np.int32)
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, hit = find(known, features(t, cache))
                counts[y, at[hit]] += 1
                n[y] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[1, at], n[1]), pa.int64()), pa.array(np.append(counts[0, at], n[0]), pa.int64())], ["at", "pos", "neg"])
        del counts
        tidy()

    part = rows.select("text", "label").mapInArrow(run, "at long, pos long, neg long")
    return part.groupBy("at").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def sample_features(rows: DataFrame) -> DataFrame:
    """doc_id, label, found (their hashes as longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = sole("quality", Words)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t, cache).view(np.int64) for t in b.column(2).to_pylist()], pa.list_(pa.int64()))], ["doc_id", "label", "found"])

    return rows.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(run, "doc_id long, label int, found array<long>")


def descend(xs: list[np.ndarray], sizes: np.ndarray, ys: np.ndarray, r: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for min |w|^2 / 2 + cost * sum of hinges, the bias as one more feature of value 1. xs: places of features in r; sizes: of how many the text has in all."""
    w, bias = np.zeros(len(r)), 0.0
    vals = [r[x] / math.sqrt(max(n, 1)) for x, n in zip(xs, sizes.tolist(), strict=True)]
    q = np.array([float(v @ v) + 1 for v in vals])
    a, sign = np.zeros(len(xs)), np.where(ys > 0, 1.0, -1.0)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(xs)):
            g = sign[i] * (w[xs[i]] @ vals[i] + bias) - 1
            new = min(max(a[i] - g / q[i], 0.0), cost)
            if (d := (new - a[i]) * sign[i]) != 0:
                w[xs[i]] += d * vals[i]
                bias += d
                a[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-4 * cost:
            break
    return w, bias


def curve(margins: np.ndarray, ys: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by damped Newton steps."""
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    b = np.array([1.0, 0.0])
    target = np.where(ys > 0, (ys.sum() + 1) / (ys.sum() + 2), 1 / ((1 - ys).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target))
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log-count ratios, with ALPHA added to each count."""
    return np.log((pos + ALPHA) / (n_pos + 2 * ALPHA)) - np.log((neg + ALPHA) / (n_neg + 2 * ALPHA))


def common(raw: list[np.ndarray], texts: int = TEXTS) -> np.ndarray:
    """Sorted features that at least so many of the arrays hold."""
    x = np.concatenate(raw) if raw else np.zeros(0, np.uint64)
    x.sort()  # in place: the largest array here
    return np.unique(x[texts - 1 :][x[texts - 1 :] == x[: len(x) - texts + 1]])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    n = labels.filter(~held_out(F.col("doc_id"), 4, 2) & F.col("quality").isin(0, 1)).count()
    few = F.broadcast(sampled(labels, n, sample))  # at most `sample` rows
    got = sample_features(docs.select("doc_id", "text").join(few, "doc_id")).toArrow()
    # rows of a repeated doc_id each count, up to the same bound
    order = np.lexsort([got.column("label").to_numpy(), got.column("doc_id").to_numpy()])[:sample].tolist()
    found = got.column("found")
    raw = [found[i].values.to_numpy().view(np.uint64) for i in order]
    ys = got.column("label").to_numpy()[order]
    names = common(raw)
    counts = cut(class_counts(labelled(docs, labels), names)).toArrow()  # at most as many rows as names, and one
    at, p, q = (counts.column(x).to_numpy() for x in ("at", "pos", "neg"))
    n_pos, n_neg = (int(v[at == -1].sum()) for v in (p, q))
    if not n_pos or not n_neg:
        share = min(max(n_pos / (n_pos + n_neg), 1e-3), 1 - 1e-3) if n_pos + n_neg else 0.5
        return Model(names[:0], np.zeros(0), 0.0, 1.0, math.log(share / (1 - share)))
    pos, neg = np.zeros(len(names)), np.zeros(len(names))
    pos[at[at >= 0]], neg[at[at >= 0]] = p[at >= 0], q[at >= 0]
    r = ratios(pos, neg, n_pos, n_neg)
    sizes = np.array(list(map(len, raw)))
    xs = [at[hit].astype(np.int32) for at, hit in (find(names, x) for x in raw)]
    hold = np.arange(len(xs)) % 5 == 4
    if len({*ys[~hold]}) < 2 or len({*ys[hold]}) < 2:
        hold[:] = True
        fit = np.arange(len(xs))
    else:
        fit = np.flatnonzero(~hold)
    w, bias = descend([xs[i] for i in fit], sizes[fit], ys[fit], r)
    used = np.flatnonzero(w * r)
    model = Model(names[used], (w * r)[used], bias, 1.0, 0.0)
    kept = np.flatnonzero(hold)
    if len(kept):
        model.slope, model.offset = curve(np.array([model.margin(raw[i]) for i in kept]), ys[kept].astype(float))
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache = sent.value, sole("quality", Words)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([known.score(features(t, cache)) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
