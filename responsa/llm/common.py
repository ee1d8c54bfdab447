"""What the operators of this subpackage share: inputs, shared storage, ASCII case, hashing in numpy."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of stored, compressed rows that one task reads, where there are enough of them for all cores.
PART = 2_000_000


def cut(df: DataFrame) -> DataFrame:
    """df computed once and stored in the shared checkpoint folder; its lineage ends there. It is read in as many partitions as its bytes ask for, not in as many as wrote it.

    The folder is the session's spark.checkpoint.dir. Only where that is unset and all runs in
    one process (a local master, as in tests), a fresh temporary folder takes its place.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="responsa-"))
    return gathered(df.checkpoint())


def gathered(stored: DataFrame) -> DataFrame:
    """stored, a checkpoint, in partitions of PART bytes, but as many as there are cores; a small table that a shuffle has dealt out otherwise costs a task, and a row of its log, for each partition whenever it is read."""
    rdd = stored._jdf.logicalPlan().rdd()
    path = stored.sparkSession._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
    size = path.getFileSystem(stored.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    n = max(stored.sparkSession.sparkContext.defaultParallelism, -(-size // PART))
    return stored.coalesce(n) if n < rdd.getNumPartitions() else stored


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; lower() also changes other alphabets' capitals.

    Text without multi-byte characters takes the fast lower().
    """
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts == part


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser on uint64 arrays: each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Memo(dict):
    """A pure cache of f: emptied when full, so that its memory is bounded; results never depend on it."""

    def __init__(self, f, limit: int):
        super().__init__()
        self.f, self.limit = f, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = out = self.f(key)
        return out


#: The one cache that a Python worker keeps between tasks.
KEPT: dict[object, object] = {}


def sole(key: object, make: Callable[[], object]):
    """The worker's cache of that key; the caches of earlier stages go when another one begins, so that a worker that Spark uses again never holds two."""
    if key not in KEPT:
        KEPT.clear()
        tidy()
        KEPT[key] = make()
    return KEPT[key]


def done() -> None:
    """tidy() without the worker's cache: at the end of a task whose cache is soon made again. An idle worker of an earlier stage otherwise holds it beside a later stage's memory."""
    KEPT.clear()
    tidy()


def tidy() -> None:
    """Gives memory that is free in this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Bytes, as JSON, of what may be broadcast; more is joined by a shuffle.
FEW = 16_000_000


def relieve(spark: SparkSession) -> None:
    """Executors and the driver collect their garbage, as many tasks as there are cores, so that free heap goes back to the system before a stage whose Python workers need memory of their own."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("x")).collect()  # a row for each core
    tidy()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame) -> DataFrame:
    """df (stored), marked for broadcast if all its rows and columns together are few bytes."""
    n = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if n <= FEW else df


def fresh(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(df: DataFrame) -> None:
    """Lets Spark delete shuffle files and checkpoints that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    tidy()
    df.sparkSession.sparkContext._jvm.System.gc()
