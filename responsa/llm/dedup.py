"""Near-duplicate documents by a chosen-path similarity join on word shingles.

1. A document's set: hashes (64 bits) of its distinct shingles of k words, words as the
   runs of anything but white space after lower-casing A-Z. Rows with the same set form a
   class; one row, of the smallest doc_id, stands for it from here on.
2. Each representative gets minwise tokens: coordinates, each the least of a random hash
   over its set. Two documents share one with probability of their similarity.
3. Each tree starts with all representatives in one node. A node selects a coordinate by a
   hash of its path, and one node in four a second one, so a node has 1.25 coordinates on
   average; its documents go to one child for each, the child of their token there. Two
   documents of similarity 0.8 thus expect one common child of every common node. Nodes whose
   documents are one component already end. Nodes of at most SMALL documents are compared
   exhaustively; larger ones branch on. Large nodes that hold the same documents over and
   over, as trees do with a group of near copies, are made one (`families`). That one, and
   what is large after DEPTH selections, is compared whole, in pairs of blocks, each pair of
   blocks a group of its own.
4. Comparisons go by sketch first; what could be similar enough is confirmed on full sets.
   Confirmation deals documents into blocks, so that a text goes to each pair of blocks
   once, however many pairs it is in there.

Before that, FIRST trees only join what is plainly alike, to save work: of each node they
confirm a spanning forest of the likeliest pairs, and deal large nodes by hash. They leave no
pair out, as the trees of the second lot don't rely on them.

Recall: `missed` computes the probability that a pair at the limit never meets, from the
branching process and the number of coordinates; `trees_for` takes as many trees as bring it
below MISS, as if every node had to branch to the full depth. No pair in a node is skipped,
whatever the node's size; the work on a large family of documents that are similar but not
linked grows with the square of its size outside its commonest component, its tasks don't.

Text without words, or null: an empty set, linked with nothing. Fewer words than k: all of
them as one shingle. Very long texts are read whole. Empty table: no rows. Repeated rows: one
class, each is returned. One doc_id with different texts: each text is a document of its own,
and the component's id is the smallest doc_id in it; null doc_ids come last. Ties among
equal doc_ids go to the row that comes first. Columns of docs other than doc_id and text,
whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, cut, done, fresh, mix, release, small, sole, table, tidy
from .components import components

#: Coordinates of a sketch (8 bits each); of these, tokens that trees select from (24 bits each).
SKETCH, TOKENS, WIDTH = 192, 128, 3
#: Selections before the first count of nodes, and in all; documents of a node that is compared at once; trees of the first lot.
START, DEPTH, SMALL, FIRST = 2, 4, 64, 2
#: The probability that a pair at the limit is missed is below this.
MISS = 2e-5
#: Documents and shingles of a block.
BLOCK, LOAD = 2048, 1_000_000
#: Sketches of 192 coordinates stray from the similarity by 0.029 (one sigma, at 0.8). Below the limit by more than five: no link.
FAR = 0.15
#: A node with more than this share of all rows is joined by broadcast: there are at most 1 / HOT.
HOT = 0.001
CONSTANTS = mix(np.arange(1, 2 * SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, SKETCH)


def survives(s: float, depth: int) -> float:
    """The probability that two documents, which share each token with probability s, share a node after so many selections."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - s * p) * (1 - 0.25 * s * p)
    return p


def missed(s: float, trees: int, depth: int = DEPTH, tokens: int = TOKENS) -> float:
    """The probability that two documents of similarity s share no node in any tree; trees select from the same tokens."""
    agree = lambda a: math.comb(tokens, a) * s**a * (1 - s) ** (tokens - a)
    return sum(agree(a) * (1 - survives(a / tokens, depth)) ** trees for a in range(tokens + 1))


@cache
def trees_for(s: float, miss: float = MISS) -> int:
    n = 1
    while missed(s, n) > miss:
        n += 1
    return n


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of k words."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return np.zeros(0, np.uint64)
    words = sole("shingles", lambda: Memo(xxhash.xxh64_intdigest, 300_000))
    h = np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws))
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), np.uint64)
    for i in range(min(k, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """[SKETCH] least of each coordinate's hash, as uint32."""
    best = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        part = s[at : at + 2048, None] * (CONSTANTS[0] | np.uint64(1)) + CONSTANTS[1]
        best = np.minimum(best, (part ^ (part >> np.uint64(29))).min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32)


PRINTS = "row long, doc_id long, text_hash long, n_shingles long, f1 long, f2 long, tokens binary, short binary"


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """row (a number of its own), doc_id, text_hash, n_shingles, f1, f2 (equal for equal sets only, 128 bits), tokens, short of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(3):  # one text at a time: a batch may be large
                s = shingles(t.as_py(), k)
                if not len(s):
                    rows.append((0, 0, 0, None, None))
                    continue
                x, sk = mix(s + np.uint64(1)), sketch(s).view(np.uint8).reshape(SKETCH, 4)
                rows.append((len(s), int(x.sum().view(np.int64)), int(mix(x ^ CONSTANTS[0, 0]).sum().view(np.int64)), sk[:TOKENS, :WIDTH].tobytes(), sk[:, 0].tobytes()))
            cols = zip(*rows, strict=True) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [x.split()[0] for x in PRINTS.split(", ")])
        done()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, PRINTS)


def branch(rows: DataFrame) -> DataFrame:
    """rows (node, id, component, tokens) at their nodes' children."""
    token = lambda c: F.substring(F.col("tokens"), c * WIDTH + 1, F.lit(WIDTH))
    pick = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(TOKENS)).cast("int")
    child = lambda salt: F.xxhash64("node", pick(salt), token(pick(salt)))
    second = F.when(F.pmod(F.xxhash64("node", F.lit(0)), F.lit(4)) == 0, child(2))
    return rows.select(F.explode(F.array_distinct(F.array_compact(F.array(child(1), second)))).alias("node"), "id", "component", "tokens")


def roots(reps: DataFrame, trees: range) -> DataFrame:
    """node, id, component after START selections of each tree."""
    rows = reps.select(F.explode(F.array(*(F.lit(t).cast("long") for t in trees))).alias("node"), "id", "component", "tokens")
    return reduce(lambda df, _: branch(df), range(START), rows).select("node", "id", "component")


def shared(rows: DataFrame) -> DataFrame:
    """rows (node, id, component), with m, how many the node has, where the node's documents are of more than one component; stored."""
    nodes = rows.groupBy("node").agg(F.count("*").alias("m"), F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 <> c2").select("node", "m")
    nodes = cut(nodes)
    total = nodes.agg(F.sum("m")).first()[0] or 0
    hot = F.broadcast(nodes.filter(F.col("m") > total * HOT))  # at most 1 / HOT rows
    rest = rows.join(hot.select("node"), "node", "left_anti").join(nodes.filter(F.col("m") <= total * HOT), "node")
    return cut(rest.unionByName(rows.join(hot, "node")))


def compare(rows: DataFrame, least: float, forest: bool) -> DataFrame:
    """a, b of pairs in a node, of different components, whose sketches agree on at least that share; rows (node, id, component, short) have nodes of few documents.

    forest: only a spanning forest of each node, the likeliest first.
    """

    def candidates(node: np.ndarray, comps: np.ndarray, sk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of pairs and how many coordinates agree."""
        left, right, same = [], [], []
        at = np.arange(len(node))
        for d in range(1, len(node)):  # ends at the size of the largest node
            at = at[at + d < len(node)]
            at = at[node[at] == node[at + d]]
            if not len(at):
                break
            for k in range(0, len(at), 20_000):
                i = at[k : k + 20_000]
                i = i[comps[i] != comps[i + d]]
                n = (sk[i] == sk[i + d]).sum(axis=1)
                ok = n >= least * SKETCH
                left.append(i[ok]), right.append(i[ok] + d), same.append(n[ok])
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, same))

    def emit(b: pa.RecordBatch) -> pa.RecordBatch:
        node, ids, comps = (b.column(k).to_numpy() for k in range(3))
        sk = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, SKETCH)
        i, j, same = candidates(node, comps, sk)
        if forest:
            root = list(range(len(node)))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            keep = []
            for n in np.argsort(-same, kind="stable").tolist():
                if (x := find(int(i[n]))) != (y := find(int(j[n]))):
                    root[y] = x
                    keep.append(n)
            i, j = i[keep], j[keep]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if rest is not None and rest.num_rows:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            node = b.column(0).to_numpy()
            last = int(np.searchsorted(node, node[-1])) if len(node) else 0
            rest, b = b.slice(last), b.slice(0, last)
            if b.num_rows:
                yield emit(b)
        if rest is not None and rest.num_rows:
            yield emit(rest)
        tidy()

    placed = rows.select("node", "id", "component", "short").repartition("node").sortWithinPartitions("node")
    return placed.mapInArrow(run, "a long, b long")


def families(large: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Families of large nodes, as rows (node, id, component), and the rows of all other nodes of large (stored; node, id, component), or None where there are none.

    Nodes with the same commonest component are mostly made of the same documents, once for
    each tree. Where these meet in fewer pairs as one node than they do in their nodes, they
    are one node from there on, which holds every pair of those; it is not branched. With
    DEPTH = 2 * START, pairs in deeper nodes are fewer still by the same factor again; so the
    one node must have a quarter of the pairs at most.
    """
    sums = large.groupBy("node", "component").agg(F.count("*").alias("c"))
    nodes = sums.groupBy("node").agg(F.max(F.struct("c", "component")).getField("component").alias("family"), F.sum("c").alias("m"))
    rows = cut(large.select("node", "id", "component").join(nodes, "node"))
    pairs = rows.groupBy("family").agg(F.sum("m").alias("before"))  # each row of a node has m
    sizes = rows.select("family", "id").distinct().groupBy("family").agg(F.count("*").alias("n"))
    known = cut(pairs.join(sizes, "family").filter(4 * F.col("n") * F.col("n") <= F.col("before")).select("family"))
    one = cut(rows.join(known, "family").select(F.col("family").alias("node"), "id", "component").distinct())
    rest = cut(rows.join(known, "family", "left_anti").select("node", "id", "component"))
    return one, None if rest.isEmpty() else rest


def candidates(reps: DataFrame, trees: range, least: float, forest: bool) -> tuple[DataFrame, DataFrame | None]:
    """a, b: pairs of reps (id, component, tokens, short; stored) to confirm; and, but for a forest, the rows (node, id, component) of nodes that are large after DEPTH selections, or that are a family of such nodes before."""
    found, shorts, rows, crowds = [], reps.select("id", "short"), roots(reps, trees), []
    for depth in range(START, DEPTH + 1):
        rows = shared(rows)
        few = rows
        if not (forest and depth == DEPTH):
            few = rows.filter(F.col("m") <= SMALL)
        elif forest:  # large nodes are dealt into small ones
            few = rows.withColumn("node", F.when(F.col("m") > SMALL, F.xxhash64("node", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") * 2 / SMALL)))).otherwise(F.col("node")))
        # each depth is a job of its own: one plan of all depths takes more memory on the driver than the rest of the work
        found.append(cut(compare(few.join(shorts, "id"), least, forest).distinct()))
        large = rows.filter(F.col("m") > SMALL)
        release(reps)
        if large.isEmpty():
            break
        if not forest:
            one, large = families(large)
            crowds.append(one)
            if large is None:
                break
        if depth < DEPTH:
            # stored: shared() reads it three times
            rows = cut(branch(large.select("node", "id", "component").join(reps.select("id", "tokens"), "id")).select("node", "id", "component"))
        elif not forest:
            crowds.append(large)
    return reduce(DataFrame.unionByName, found).distinct(), reduce(DataFrame.unionByName, crowds) if crowds else None


def texts_of(ids: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """id, text of ids (stored, distinct)."""
    low = F.lit(-(1 << 63))  # for null
    need = cut(ids.join(reps.select("id", F.coalesce("doc_id", low).alias("d"), "text_hash"), "id"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), low).alias("d"), F.xxhash64("text").alias("text_hash"), "text")
    return texts.join(small(need), ["d", "text_hash"]).groupBy("id").agg(F.first("text").alias("text"))


def linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    inter = len(np.intersect1d(one, two, assume_unique=True))
    return inter > 0 and 100 * inter >= percent * (len(one) + len(two) - inter)


def confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b of pairs (stored) whose full sets meet 100 * intersection >= percent * union."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    n, load = ids.join(reps.select("id", "n_shingles"), "id").agg(F.count("*"), F.sum("n_shingles")).first()
    blocks = max(1, -(-n // BLOCK), -(-(load or 0) // LOAD))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    met = pairs.withColumn("g", F.least(block("a"), block("b")) * blocks + F.greatest(block("a"), block("b")))
    # one row for each document of a pair of blocks, with its partners there: at most a block of them
    rows = met.select("g", F.col("a").alias("id"), F.col("b").alias("w")).unionByName(met.select("g", F.col("b").alias("id"), F.lit(None).cast("long").alias("w")))
    rows = rows.groupBy("g", "id").agg(F.collect_list("w").alias("w")).join(texts_of(ids, reps, docs), "id")

    def settle(sets: dict[int, np.ndarray], asked: list[tuple[int, list[int]]]) -> pa.RecordBatch:
        links = [(a, b) for a, bs in asked for b in bs if linked(sets[a], sets[b], percent)]
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, asked = None, {}, []
        for b in batches:
            for g, i, w, t in zip(*(b.column(c) for c in range(4)), strict=True):
                if (g := g.as_py()) != now:
                    if asked:
                        yield settle(sets, asked)
                    now, sets, asked = g, {}, []
                sets[i.as_py()] = shingles(t.as_py(), k)
                if len(w):
                    asked.append((i.as_py(), w.as_py()))
        if asked:
            yield settle(sets, asked)
        done()

    return rows.select("g", "id", "w", "text").repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def alike(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """[len(one), len(two)] of how many coordinates two sketches agree on."""
    x, y = (np.ascontiguousarray(np.frombuffer(b"".join(z), np.uint8).reshape(-1, SKETCH).T) for z in (one, two))
    out = np.zeros((x.shape[1], y.shape[1]), np.uint8)  # SKETCH < 256
    for a, b in zip(x, y, strict=True):
        out += a[:, None] == b[None]
    return out


def meet(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """[len(one), len(two)] sizes of the intersections of sets of hashes, by products of indicator matrices over slices of the common hashes."""
    out = np.zeros((len(one), len(two)), np.float32)  # whole numbers, exact to 2 ** 24
    (x, rx), (y, ry) = ((np.concatenate(z), np.repeat(np.arange(len(z)), list(map(len, z)))) for z in (one, two))
    both = np.intersect1d(x, y)
    for at in range(0, len(both), 4096):
        part = both[at : at + 4096]
        sides = []
        for h, r, n in ((x, rx, len(one)), (y, ry, len(two))):
            k = np.minimum(np.searchsorted(part, h), len(part) - 1)
            ok = part[k] == h
            m = np.zeros((n, len(part)), np.float32)
            m[r[ok], k[ok]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def crowded(large: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links inside large nodes, confirmed on full sets, as many as connect what any link there connects.

    large (stored): node, id, component. Every document meets every other of its node but
    those of its own component: in each node the blocks of the commonest component come first
    and don't meet each other. Blocks have BLOCK documents and LOAD shingles, on average.
    """
    least = percent / 100 - FAR
    large = cut(large.select("node", "id", "component").join(reps.select("id", "n_shingles", "short"), "id"))  # read three times
    sums = large.groupBy("node", "component").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("s"))
    most = sums.groupBy("node").agg(F.max(F.struct("c", "component")).alias("x"), F.sum("c").alias("m"), F.sum("s").alias("t"))
    most = most.select("node", "m", "t", F.col("x.c").alias("c"), F.col("x.component").alias("main"))
    rows = large.join(most, "node")
    each = F.least(F.lit(BLOCK), F.ceil(F.lit(LOAD) * F.col("m") / F.col("t")))
    first, other = F.ceil(F.col("c") / each), F.ceil((F.col("m") - F.col("c")) / each)
    in_main = F.col("component") == F.col("main")
    h = F.xxhash64("id", "node")
    at = F.when(in_main, F.pmod(h, first)).otherwise(first + F.pmod(h, F.greatest(other, F.lit(1))))
    rows = rows.select("node", "id", "component", "short", at.alias("x"), F.when(in_main, first).otherwise(F.lit(0)).alias("from"), (first + other - 1).alias("to"))
    rows = rows.select("node", "id", "component", "short", "x", F.explode(F.sequence("from", "to")).alias("y"))
    rows = rows.select(F.xxhash64("node", F.least("x", "y"), F.greatest("x", "y")).alias("pair"), "x", "id", "component", "short")
    rows = rows.join(texts_of(cut(large.select("id").distinct()), reps, docs), "id")

    def run(t: pa.Table) -> pa.Table:
        x, ids, comps = (t.column(c).to_numpy() for c in ("x", "id", "component"))
        shorts, said = t.column("short").to_pylist(), t.column("text")
        one = np.flatnonzero(x == x.min())
        two = np.flatnonzero(x == x.max())
        near = alike([shorts[i] for i in one], [shorts[i] for i in two]) >= least * SKETCH
        near &= comps[one][:, None] != comps[two][None]
        if x.min() == x.max():
            near = np.triu(near, 1)
        left, right = [], []
        r, c = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if len(r):
            sets = {i: shingles(said[i].as_py(), k) for i in {*one[r].tolist(), *two[c].tolist()}}
            a, b = [sets[i] for i in one[r].tolist()], [sets[i] for i in two[c].tolist()]
            inter, sizes = meet(a, b), [np.array(list(map(len, z))) for z in (a, b)]
            links = near[np.ix_(r, c)] & (inter > 0) & (100 * inter >= percent * (sizes[0][:, None] + sizes[1][None] - inter))
            root: dict[int, int] = {}

            def find(v: int) -> int:
                while root.setdefault(v, v) != v:
                    root[v] = v = root[root[v]]
                return v

            for i, j in zip(*(z.tolist() for z in np.nonzero(links)), strict=True):
                u, v = int(ids[one[r[i]]]), int(ids[two[c[j]]])
                p, q = find(u), find(v)
                if p != q:
                    root[q] = p
                    left.append(min(u, v)), right.append(max(u, v))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return rows.groupBy("pair").applyInArrow(run, "a long, b long")


def grouped(docs: DataFrame, k: int, percent: int, trees: int | None = None) -> DataFrame:
    """row, doc_id, text_hash, n_shingles, and first (absent, doc_id, row), the least row of its group, of each row of docs; first is null for empty sets."""
    trees = trees_for(percent / 100) if trees is None else trees
    prints = cut(fingerprints(docs, k))
    sets = ["n_shingles", "f1", "f2"]
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")
    reps = prints.filter("n_shingles > 0").groupBy(*sets).agg(F.min_by(F.struct("doc_id", "row", "text_hash", "tokens", "short"), order).alias("x"))
    reps = cut(reps.select(*sets, F.col("x.row").alias("id"), "x.doc_id", "x.text_hash", "x.tokens", "x.short"))
    links, known = None, reps.withColumn("component", F.col("id"))
    for lot, forest in ((range(trees, trees + FIRST), True), (range(trees), False)):
        pairs, large = candidates(known, lot, percent / 100 - (FAR / 2 if forest else FAR), forest)
        new = cut(confirm(cut(pairs), reps, docs, k, percent))
        if large is not None:
            new = new.unionByName(cut(crowded(large, reps, docs, k, percent)))
        links = new if links is None else links.unionByName(new)
        release(docs)
        found = cut(components(links))
        known = cut(reps.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")))
    firsts = known.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", F.col("id").alias("row"))).alias("first"))
    # the table of sets is joined last; a set that very many rows share is split where it is skewed
    of = known.select(*sets, "component").join(firsts, "component").select(*sets, "first")
    return prints.select("row", "doc_id", "text_hash", *sets).join(of, sets, "left").select("row", "doc_id", "text_hash", "n_shingles", "first")


def classes(docs: DataFrame, k: int = 4, percent: int = 80, trees: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text)."""
    out = grouped(docs, k, percent, trees).select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs, one of each group: of the smallest doc_id, once if its row repeats. Rows without words stay."""
    found = cut(grouped(docs, k, percent).filter("first IS NOT NULL").select("doc_id", "text_hash", F.col("row").eqNullSafe(F.col("first.row")).alias("kept")))
    low = F.lit(-(1 << 63))  # for null
    d, h, n = (fresh(docs, x) for x in ("group_doc", "group_hash", "group_rows"))
    texts = found.groupBy(F.coalesce("doc_id", low).alias(d), F.col("text_hash").alias(h)).agg(F.max("kept").alias("kept"), F.count("*").alias(n))
    texts = cut(texts)
    marked = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), low), h: F.xxhash64("text")})
    out = marked.join(small(cut(texts.filter("NOT kept").select(d, h))), [d, h], "left_anti")
    again = cut(texts.filter(F.col("kept") & (F.col(n) > 1)).select(d, h))
    if not again.isEmpty():
        out = out.join(small(again), [d, h], "left_anti").unionByName(out.join(small(again), [d, h], "left_semi").dropDuplicates([d, h]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE low AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM low WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, seen) AS (SELECT a, b FROM edges UNION SELECT reach.id, edges.b FROM reach JOIN edges ON edges.a = reach.seen),
least AS (SELECT id, min(seen) AS m FROM reach GROUP BY id)
SELECT doc_id, coalesce(n, 0)::bigint AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM low LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.id = doc_id
"""
