"""Approximate search over cells, randomised components, and bundles of them that are stored and checked."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from responsa.operators import models, neighbors


def cells_of(points: DataFrame, centres: DataFrame, probes: int = 1) -> DataFrame:
    """id, cluster of the `probes` nearest of few centres (cluster, c)."""
    return neighbors.centroid_distances(points, centres, probes).select("id", "cluster")


def probe(queries: DataFrame, items: DataFrame, centres: DataFrame, k: int, probes: int = 4) -> DataFrame:
    """query, rank, item, sim (cosine): the k best of the items in the cells that are nearest to a query; itself left out. Items and queries (id, v) meet by cell only, as products of blocks."""
    unit = lambda df: df.select("id", neighbors.normalise(F.col("v")).alias("v"))
    posted = cells_of(unit(items), centres).join(items.select("id", "v"), "id")
    asked = cells_of(unit(queries), centres, probes).join(queries.select("id", "v"), "id")
    return neighbors.top_k(asked, posted, k, by="cluster")


def randomised_pca(df: DataFrame, k: int, extra: int = 10, powers: int = 2, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and k components of v: a random basis of k + extra vectors, sharpened by `powers` passes. Each pass is one distributed sum of d * (k + extra) numbers; no row reaches the driver."""
    rows = df.select(F.col("v").cast("array<double>").alias("v"))
    n = rows.count()
    mean = np.array([r[1] for r in rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x")).orderBy("i").collect()])

    def passed(q: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s = np.zeros_like(q)
            for b in batches:
                if len(b):
                    x = np.stack(b.v.to_list()) - mean
                    s += x.T @ (x @ q)
            yield pd.DataFrame({"m": [s.ravel().tolist()]})

        got = rows.mapInPandas(run, "m array<double>").select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x")).orderBy("i").collect()
        return np.array([r[1] for r in got]).reshape(q.shape)

    size = min(k + extra, len(mean))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(mean), size)))[0]
    for _ in range(powers):
        q = np.linalg.qr(passed(q))[0]
    small = q.T @ passed(q) / max(n, 1)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    basis = (q @ vectors[:, ::-1][:, :k]).T
    return mean, basis * np.where(basis[np.arange(len(basis)), np.abs(basis).argmax(1)] < 0, -1, 1)[:, None]


def manifest(points: DataFrame, k: int) -> dict:
    """k, dimension, rows and a hash of the keys, whatever their order."""
    r = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h")).first()
    return {"k": k, "d": r.d, "n": r.n, "keys": str(r.h)}


def save_clusters(points: DataFrame, centres: DataFrame, assignments: DataFrame, path: str, k: int) -> None:
    spark = points.sparkSession
    centres.write.mode("overwrite").parquet(f"{path}/centres")
    assignments.write.mode("overwrite").parquet(f"{path}/assignments")
    spark.createDataFrame([(json.dumps(manifest(points, k), sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def clusters(points: DataFrame, path: str, k: int, seed: int = 0) -> tuple[DataFrame, DataFrame, bool]:
    """(centres, assignments, reused): what is stored under path if its k, dimension and keys are these points', else a new fit, which is stored."""
    spark = points.sparkSession
    if exists(spark, f"{path}/manifest/_SUCCESS"):
        got = spark.read.parquet(f"{path}/manifest").first()
        if got and json.loads(got[0]) == manifest(points, k):
            return spark.read.parquet(f"{path}/centres"), spark.read.parquet(f"{path}/assignments"), True
    centres, assignments = models.kmeans(points, k, seed)
    save_clusters(points, centres, assignments, path, k)
    return spark.read.parquet(f"{path}/centres"), spark.read.parquet(f"{path}/assignments"), False


def export_bundle(points: DataFrame, registry: DataFrame, passrates: DataFrame, path: str, components: int, most_bytes: int, volumes: bool = False) -> dict[str, int]:
    """Writes components' coordinates as int8 with their scales, the basis, the registry of items and the pass rates under path; the bytes of each. An error, and nothing left, where together they are more than most_bytes.

    volumes: most_bytes is what one volume holds; a larger bundle has several. Files are cut to fit,
    and `volumes` under path lists name, file and volume of each. An error where no cut makes a file fit.
    """
    spark = points.sparkSession
    mean, basis = models.pca(points, components)
    z = points.select("id", models.project(F.col("v"), basis, mean).alias("z")).withColumns(neighbors.quantize(F.col("z"))).drop("z")
    parts = {"items": z, "basis": spark.createDataFrame([(k, [float(x) for x in b]) for k, b in enumerate([mean, *basis])], "i int, v array<double>"), "registry": registry, "passrates": passrates}
    sizes = {}
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        sizes[name] = int(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength())
    listed = []
    if volumes and sum(sizes.values()) > most_bytes:
        for name in sizes:
            if sizes[name] > most_bytes // 2:  # halves, as files of equal rows are not of equal bytes
                spark.read.parquet(f"{path}/{name}").repartition(-(-sizes[name] * 4 // most_bytes)).write.mode("overwrite").parquet(f"{path}/cut-{name}")
                move(spark, f"{path}/cut-{name}", f"{path}/{name}")
        listed = deal([(n, f, size) for n in sizes for f, size in files_of(spark, f"{path}/{n}")], most_bytes)
        sizes = {n: sum(x[3] for x in listed if x[0] == n) for n in sizes}
    if max((x[3] for x in listed), default=sum(sizes.values())) > most_bytes:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        raise ValueError(f"the bundle has {sum(sizes.values())} bytes, more than {most_bytes}")
    if listed:
        spark.createDataFrame(listed, "name string, file string, volume int, bytes long").coalesce(1).write.mode("overwrite").parquet(f"{path}/volumes")
    return sizes


def deal(files: list[tuple[str, str, int]], most: int) -> list[tuple[str, str, int, int]]:
    """name, file, volume, bytes: files in their order, a new volume where one more would be too much."""
    out, volume, held = [], 0, 0
    for name, file, size in files:
        if held and held + size > most:
            volume, held = volume + 1, 0
        out.append((name, file, volume, size))
        held += size
    return out


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return sorted((f.getPath().getName(), int(f.getLen())) for f in found if not f.getPath().getName().startswith(("_", ".")))


def move(spark: SparkSession, old: str, new: str) -> None:
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (old, new))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(b, True)
    fs.rename(a, b)
