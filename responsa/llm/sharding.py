"""Placement of documents on shards by a lookup table filled from permutations.

The table has a prime number of slots. Each shard has its own order of preference over
all slots, offset + k * skip; shards take turns, and at a turn a shard claims its next
preferred slot that is still free. So shards get equal shares of slots, to within one, and
adding or losing a shard moves few slots. A key's slot is its hash modulo the prime; the
table, at most MOST_SLOTS rows, is broadcast, so a placement is one lookup.

Null key: slot of the empty string. Repeated keys: the same shard each. Empty table: no rows.
Very long keys are hashed whole. A column of the caller's that is named as a new one stays, and
the new one gets an underscore. Ties don't arise: a slot is claimed once.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

SHARDS, SLOTS, MOST_SLOTS = 256, 65_537, 5_000_011


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of each slot."""
    if not shards or slots < len(shards) or slots > MOST_SLOTS or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, no less than the number of shards and no more than MOST_SLOTS")
    number = lambda name, salt: int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")
    at = [number(s, "offset") % slots for s in shards]
    skip = [number(s, "skip") % (slots - 1) + 1 for s in shards]
    out, free = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while out[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            out[at[k]] = k
            free -= 1
            if not free:
                return out


def slot(key: Column, slots: int = SLOTS) -> Column:
    """From 60 bits of MD5, which any SQL engine can compute too."""
    h = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    return F.pmod(h, F.lit(slots)).cast("int")


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    return spark.createDataFrame([(k, s, shards[s]) for k, s in enumerate(fill(shards, slots))], "slot int, shard_no int, shard string")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """df with slot, shard_no and shard (see added())."""
    at, no, name = added(df)
    found = F.broadcast(lookup(df.sparkSession, shards, slots).toDF(at, no, name))  # at most MOST_SLOTS rows
    return df.withColumn(at, slot(F.col(key), slots)).join(found, at, "left").select(*df.columns, at, no, name)


def added(df: DataFrame) -> list[str]:
    """The names of the columns that place() adds."""
    return [fresh(df, c) for c in ("slot", "shard_no", "shard")]


def write(df: DataFrame, key: str, shards: list[str], path: str, slots: int = SLOTS, files: int = 1) -> None:
    """One folder for each shard, of `files` files each."""
    at, no, name = added(df)
    part = fresh(df, "part")
    placed = place(df, key, shards, slots).withColumn(part, F.pmod(F.xxhash64(F.col(key)), F.lit(files)))
    placed.repartition(len(shards) * files, name, part).drop(at, no, part).write.partitionBy(name).parquet(path)


def names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:04d}" for k in range(n)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", names()).select("doc_id", "slot", "shard_no", "shard")
