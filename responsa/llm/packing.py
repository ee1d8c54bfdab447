"""Best-fit packing of documents into sequences of at most `size` tokens.

1. `pieces`: each document's ids and an end id, cut into pieces of at most `size`.
2. `histogram`: pieces by length, at most `size` rows whatever the input; so the plan is
   made on the driver from a bounded table.
3. `make_plan`: full pieces stand alone. For each open length, longest first, an index of
   single lengths, pair sums and triple sums answers whether something fills the gap
   exactly; such a combination is consumed as often as all its lengths are available, so
   each consumption uses up a length or leaves the combination. What is left goes by
   best fit: longest first, then always the longest length that still fits.
4. `place`: the n-th piece of a length takes the n-th place planned for that length. Ranks
   come from counts of hashed subgroups, so that no length is ordered in one task.

Null text: as empty, so one piece holding the end id alone. Empty table: no rows. Repeated
rows are packed each on its own. Very long texts are encoded whole and cut into pieces. Ties among
equal pieces go by (doc_id, piece, start, ids). Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import cut, table

SIZE, END = 4096, 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    tail = np.asarray([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc, raw in zip(b.column(0).to_pylist(), enc.ids(b.column(1).to_pylist()), strict=True):
                raw += tail
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    for col, x in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        col.append(x)
            cols = [pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(cols[: 5 + with_ids], names[: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", ids binary" * with_ids)


def histogram(pieces_df: DataFrame, subgroups: int) -> DataFrame:
    sub = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(subgroups)).cast("int")
    return pieces_df.groupBy("length", sub.alias("sub")).agg(F.count("*").alias("n"))


def make_plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, places, places in a sequence, first sequence, first offset).

    Rank r of the rows' length, r in [first, first + places), goes to sequence
    first_sequence + (r - first) // each, at offset + ((r - first) % each) * length.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    plan, sequences = [], 0
    bits = sum(1 << n for n in left)  # bit n: a piece of length n is left

    def consume(combination: list[int]) -> None:
        nonlocal sequences, bits
        each = {n: combination.count(n) for n in combination}
        times = min(left[n] // k for n, k in each.items())
        offset = 0
        for n, k in each.items():
            plan.append((n, used[n], times * k, k, sequences, offset))
            offset += n * k
            used[n] += times * k
            left[n] -= times * k
            if not left[n]:
                del left[n]
                bits &= ~(1 << n)
        sequences += times

    def enough(*ns: int) -> bool:
        return all(left.get(n, 0) >= ns.count(n) for n in ns)

    def pair_sums() -> int:
        out = 0
        for n, c in left.items():
            out |= (bits if c > 1 else bits & ~(1 << n)) << n
        return out

    pairs, stale = pair_sums(), 0  # lengths used up since then only make it name too many sums; what it names is checked

    def filling(first: int) -> list[int] | None:
        """first with one, two or three lengths that fill its gap exactly."""
        gap = size - first
        if not gap or enough(first, gap):
            return [first, *([gap] if gap else [])]
        if pairs >> gap & 1:
            for a in lengths:
                if a <= gap - a and (bits >> (gap - a)) & 1 and enough(first, a, gap - a):
                    return [first, gap - a, a]
        for a in lengths:
            rest = gap - a
            if rest > 1 and pairs >> rest & 1 and left.get(a):
                for b in lengths:
                    if b > rest - b:
                        break
                    if (bits >> (rest - b)) & 1 and enough(first, a, b, rest - b):
                        return [first, *sorted((a, b, rest - b), reverse=True)]
        return None

    lengths = sorted(left)
    for n in sorted(left, reverse=True):
        while n in left:
            found = filling(n)
            if found is None:
                break
            before = len(left)
            consume(found)
            if len(left) < before:
                lengths = sorted(left)
                stale += 1
                if stale == 64:
                    pairs, stale = pair_sums(), 0
    lengths = sorted(left)
    while lengths:
        room, combination, spare = size, [], dict(left)
        while True:
            k = bisect_right(lengths, room)
            while k and not spare[lengths[k - 1]]:
                k -= 1
            if not k:
                break
            n = lengths[k - 1]
            many = min(spare[n], room // n)
            combination += [n] * many
            spare[n] -= many
            room -= many * n
        consume(combination)
        lengths = sorted(left)
    return plan


def place(pieces_df: DataFrame, size: int = SIZE, rows_a_subgroup: int = 100_000) -> DataFrame:
    """pieces_df with sequence_id and offset. pieces_df must be stored: it is read three times."""
    spark = pieces_df.sparkSession
    most = pieces_df.groupBy("length").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    subgroups = max(16, -(-most // rows_a_subgroup))
    by_sub = histogram(pieces_df, subgroups)
    counts = {r.length: r.n for r in by_sub.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = sorted(make_plan(counts, size))
    base = by_sub.select("length", "sub", (F.sum("n").over(Window.partitionBy("length").orderBy("sub")) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "sub").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        pieces_df.withColumn("sub", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(subgroups)).cast("int"))
        .withColumn("at", F.row_number().over(within))
        .join(F.broadcast(base) if subgroups * size <= 200_000 else base, ["length", "sub"])
        .withColumn("rank", F.col("before") + F.col("at") - 1)
    )
    rows = np.asarray(plan, np.int64).reshape(-1, 6)  # a few thousand rows at most: lengths x lengths in a combination
    key = rows[:, 0] * (1 << 40) + rows[:, 1]
    names = [x for x in pieces_df.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = (b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "rank"))
            p = rows[np.searchsorted(key, n * (1 << 40) + r, side="right") - 1] if len(rows) else np.zeros((0, 6), np.int64)
            d = r - p[:, 1]
            cols = [b.column(b.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p[:, 4] + d // p[:, 3]), pa.array(p[:, 5] + d % p[:, 3] * n)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces_df.schema.fields)
    return ranked.mapInArrow(run, kinds + ", sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    return place(cut(pieces(docs, path, size, end, with_ids)), size)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
