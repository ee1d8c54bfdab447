"""Language identification by interpolated Kneser-Ney character models, one for each language.

A text's words are its runs of letters, in lower case. A model gives each letter, and the
end of the word, given up to ORDER - 1 characters before it in the word. Training counts
cover every training row: words are counted in Spark, then their n-grams. All n-grams are
kept, of every order and count, so discounts and continuation counts are those of the whole
input; the model, which is built on the driver and broadcast, grows with the distinct
n-grams of the languages. Of each order
there is one sorted array of hashes, with a column for each language: the interpolated
log-probability, also of n-grams which that language has not seen. A lookup that misses
an order adds each language's back-off weight of the context and goes to the next order.

Whole texts are read, however long. The language is the one of the lowest cross-entropy for a symbol; ties go to the first name.
Rejection is calibrated on all training rows of LONG symbols or more: a language's median
and 90th percentile of cross-entropy, which junk in a few percent of its rows doesn't move;
a text is rejected beyond the latter by more than REACH times their distance, widened for
short texts. A language of fewer than FEW_ROWS such rows takes the limit of all rows of all
languages if that is looser, or if it has none of its own. Null text or text
without a letter: `und`, score 0, rejected. No training rows: `und` everywhere, score 0.
Empty table: no rows. Repeated rows and extra columns: each row is judged on its own.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, mix, sole, table, tidy

ORDER, REACH, LONG, FEW_ROWS = 5, 2.0, 100, 30
LETTERS = regex.compile(r"\p{L}+")
BEGIN, END = "\x02", "\x03"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def count_words(df: DataFrame) -> DataFrame:
    """(lang, word, n) over all of df (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(k, w, n) for k, c in seen.items() for w, n in c.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(k, Counter()).update(words(t))
            if sum(map(len, seen.values())) > 300_000:
                yield flush()
        yield flush()
        tidy()

    return df.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_ngrams(word_counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): n-grams of the top order, and shorter ones from a word's begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for k, w, n in zip(*(b.column(x).to_pylist() for x in range(3)), strict=True):
                w = BEGIN + w + END
                for i in range(1, len(w)):
                    seen[k, w[max(0, i - order + 1) : i + 1]] += n
            rows = list(seen.items())
            yield pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in rows], pa.string()), pa.array([x[0][1] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int64())], ["lang", "gram", "n"])

    return word_counts.select("lang", "word", "n").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def hashes(padded: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For k from 1 to order: hashes of the k characters that end at each position; 0 where a word is too short.

    padded: code points of words with BEGIN and END, one after another; starts: positions since each word's begin.
    """
    code = mix(padded.astype(np.uint64) + np.uint64(1))
    out, h = [], np.zeros(len(code), np.uint64)
    for k in range(order):
        # the hash of characters i-k..i from that of i-k+1..i, one further to the left
        shifted = np.zeros_like(code)
        shifted[k:] = code[: len(code) - k]
        h = mix(h * MULTIPLIER + shifted * np.uint64(2 * k + 1))
        out.append(np.where(starts >= k, h, np.uint64(0)))
    return out


def pad(ws: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, positions since the word's begin, and where each word begins."""
    text = "".join([BEGIN + w + END for w in ws])
    size = np.fromiter((len(w) + 2 for w in ws), np.int64, len(ws))
    first = np.cumsum(size) - size
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), np.arange(int(size.sum())) - np.repeat(first, size), first


@dataclass
class Model:
    langs: list[str]
    order: int = ORDER
    #: by order - 1: sorted hashes, log-probabilities [n-grams, languages]
    keys: list[np.ndarray] = field(default_factory=list)
    probs: list[np.ndarray] = field(default_factory=list)
    #: by length of the context: sorted hashes, log back-off weights
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray = field(default_factory=lambda: np.zeros(0))
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def log_probs(self, ws: list[str]) -> np.ndarray:
        """[words, languages]: log-probabilities of whole words, ends included."""
        if not self.langs:
            return np.zeros((len(ws), 0), np.float32)
        points, since, first = pad(ws)
        hs = hashes(points, since, self.order)
        ask = np.flatnonzero(since > 0)
        total = np.zeros((len(points), len(self.langs)), np.float32)
        for k in range(self.order - 1, -1, -1):
            h = hs[k][ask]
            usable = h != 0
            at = np.searchsorted(self.keys[k], h)
            at[at == len(self.keys[k])] = 0
            hit = usable & (self.keys[k][at] == h) if len(self.keys[k]) else np.zeros(len(h), bool)
            total[ask[hit]] += self.probs[k][at[hit]]
            if k:
                miss, context = ask[~hit & usable], self.contexts[k]
                if len(miss) and len(context):
                    c = hs[k - 1][miss - 1]
                    at = np.searchsorted(context, c)
                    at[at == len(context)] = 0
                    known = context[at] == c
                    total[miss[known]] += self.weights[k][at[known]]
            else:
                total[ask[~hit]] += self.unseen
            ask = ask[~hit]
        return np.add.reduceat(total, first, axis=0) if len(first) else np.zeros((0, len(self.langs)), np.float32)


def hash_rows(codes: np.ndarray) -> np.ndarray:
    """The hash of each row of characters, as hashes() has it."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        h = mix(h * MULTIPLIER + mix(codes[:, codes.shape[1] - 1 - k].astype(np.uint64) + np.uint64(1)) * np.uint64(2 * k + 1))
    return h


def place(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of x stands in sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


@dataclass
class Order:
    """One order of one language: sorted hashes of n-grams, their characters, probabilities; sorted hashes of contexts, their back-off weights."""

    keys: np.ndarray
    codes: np.ndarray
    probs: np.ndarray
    contexts: np.ndarray
    gammas: np.ndarray


def orders_of(counted: list[tuple[np.ndarray, np.ndarray]], alphabet: int) -> tuple[list[Order], float]:
    """Interpolated Kneser-Ney of one language from (characters, counts) by order; those below the top order are n-grams from a word's begin. Also the probability of an unseen character."""
    full: list[tuple[np.ndarray, np.ndarray]] = [counted[-1]]
    for codes, counts in counted[-2::-1]:
        # how many characters come before each n-gram
        tails = full[0][0][:, 1:]
        _, first, follow = np.unique(hash_rows(tails), return_index=True, return_counts=True)
        full.insert(0, (np.concatenate([codes, tails[first]]), np.concatenate([counts, follow])))
    out: list[Order] = []
    floor = 1.0 / alphabet
    for k, (codes, counts) in enumerate(full):
        keys = hash_rows(codes)
        by = np.argsort(keys)
        keys, codes, counts = keys[by], codes[by], counts[by]
        ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        contexts, of = np.unique(hash_rows(codes[:, :-1]) if k else np.zeros(len(codes), np.uint64), return_inverse=True)
        sums, kinds = np.bincount(of, counts, len(contexts)), np.bincount(of, minlength=len(contexts))
        gammas = d * kinds / np.maximum(sums, 1)
        lower = out[-1].probs[place(out[-1].keys, hash_rows(codes[:, 1:]))[0]] if k else np.full(len(codes), 1.0 / alphabet)
        out.append(Order(keys, codes, np.maximum(counts - d, 0) / np.maximum(sums[of], 1) + gammas[of] * lower, contexts, gammas))
        if not k and len(gammas):
            floor = float(gammas[0]) / alphabet
    return out, floor


def build(counted: pa.Table, order: int = ORDER) -> Model:
    """The model of (lang, gram, n) rows as count_ngrams gives them. Arrays throughout: some 60 bytes for each n-gram of a language."""
    langs = sorted(set(counted.column("lang").unique().to_pylist()))
    model = Model(langs, order)
    if not langs:
        return model
    size = pc.utf8_length(counted.column("gram"))
    raw: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in langs:
        own, by_order = pc.equal(counted.column("lang"), lang), []
        for k in range(order):
            some = counted.filter(pc.and_(own, pc.equal(size, k + 1)))
            codes = np.frombuffer("".join(some.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, k + 1)
            by_order.append((codes, some.column("n").to_numpy().astype(np.int64)))
        raw.append(by_order)
    # single characters of all languages: the last ones of all n-grams
    alphabet = len(np.unique(np.concatenate([codes[:, -1] for by_order in raw for codes, _ in by_order]))) + 1000
    each = [orders_of(by_order, alphabet) for by_order in raw]
    table = np.zeros((0, len(langs)))
    for k in range(order):
        keys, first = np.unique(np.concatenate([o[k].keys for o, _ in each]), return_index=True)
        codes = np.concatenate([o[k].codes for o, _ in each])[first]
        tails = place(model.keys[-1], hash_rows(codes[:, 1:]))[0] if k else None
        context = hash_rows(codes[:, :-1]) if k else None
        here = np.empty((len(keys), len(langs)))
        for i, (o, floor) in enumerate(each):
            # by back-off where the language hasn't seen the n-gram
            if k:
                at, known = place(o[k].contexts, context)
                here[:, i] = np.where(known, o[k].gammas[at] if len(o[k].gammas) else 1.0, 1.0) * table[tails, i]
            else:
                here[:, i] = floor
            here[np.searchsorted(keys, o[k].keys), i] = o[k].probs
        table = here
        model.keys.append(keys)
        model.probs.append(np.log(here).astype(np.float32))
        contexts = np.unique(np.concatenate([o[k].contexts for o, _ in each])) if k else np.zeros(0, np.uint64)
        weights = np.ones((len(contexts), len(langs)))
        for i, (o, _) in enumerate(each):
            if k:
                weights[np.searchsorted(contexts, o[k].contexts), i] = o[k].gammas
        model.contexts.append(contexts)
        model.weights.append(np.log(weights).astype(np.float32))
    model.unseen = np.log([floor for _, floor in each]).astype(np.float32)
    return model


def train(df: DataFrame, order: int = ORDER) -> Model:
    """df: lang, text. Rows without either are left out."""
    return build(count_ngrams(count_words(df.filter("lang IS NOT NULL AND text IS NOT NULL")), order).toArrow(), order)


class Scorer:
    """Sums of words' scores, with a bounded cache of words."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most, self.rows, self.table, self.size = model, most, {}, np.zeros((0, len(model.langs)), np.float32), np.zeros(0, np.int32)

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """[texts, languages]: log-probabilities; and numbers of symbols."""
        split = [words(t) for t in texts]
        new = set().union(*split) - self.rows.keys() if split else set()
        if len(self.rows) + len(new) > self.most:
            self.rows, self.table, self.size, new = {}, self.table[:0], self.size[:0], set().union(*split)
        new = list(new)
        parts = [self.table]
        for k in range(0, len(new), 20_000):
            parts.append(self.model.log_probs(new[k : k + 20_000]))
        self.rows.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
        self.table = np.concatenate(parts)
        self.size = np.concatenate([self.size, np.fromiter((len(w) + 1 for w in new), np.int32, len(new))])
        out, n = np.zeros((len(texts), len(self.model.langs))), np.zeros(len(texts), np.int64)
        for k, ws in enumerate(split):
            if ws:
                at = np.fromiter(map(self.rows.__getitem__, ws), np.int64, len(ws))
                out[k], n[k] = self.table[at].sum(axis=0, dtype=np.float64), self.size[at].sum()
        return out, n


def scores(df: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score, entropy (nats a symbol; null where no letter), n_symbols."""

    sent, name = df.sparkSession.sparkContext.broadcast(model), model.name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sole(name, lambda: Scorer(sent.value))
        for b in batches:
            texts = b.column(1).to_pylist()
            best, share, h, sizes = [], [], [], []
            at = 0
            while at < len(texts):
                lot, size = [], 0
                while at < len(texts) and size < 1_000_000:
                    lot.append(texts[at])
                    size += len(texts[at] or "")
                    at += 1
                sums, n = scorer.sums(lot)
                for s, m in zip(sums, n.tolist(), strict=True):
                    sizes.append(m)
                    if not m or not len(s):
                        best.append("und"), share.append(0.0), h.append(None)
                        continue
                    k = int(s.argmax())
                    # symbols of one text depend on each other: m of them weigh as 40 m / (40 + m)
                    p = np.exp((s - s[k]) * 40 / (40 + m))
                    best.append(model.langs[k]), share.append(float(1 / p.sum())), h.append(float(-s[k] / m))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(share, pa.float64()), pa.array(h, pa.float64()), pa.array(sizes, pa.int64())], [key, "lang_pred", "score", "entropy", "n_symbols"])

    return df.select(F.col(key), "text").mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, lang_pred string, score double, entropy double, n_symbols long")


def calibrate(df: DataFrame, model: Model) -> Model:
    """Limits of each language from all rows of df; those of all languages together stand under `und`."""
    long = scores(df, model).filter(F.col("n_symbols") >= LONG)
    got = long.rollup("lang_pred").agg(F.percentile_approx("entropy", [0.5, 0.9], 10_000).alias("q"), F.count("*").alias("n")).collect()
    limits = {r.lang_pred or "und": (r.q[0], r.q[1]) for r in got if r.n}
    for r in got:
        if r.n and r.n < FEW_ROWS and r.lang_pred:
            limits[r.lang_pred] = max(limits[r.lang_pred], limits["und"], key=lambda x: x[1] + REACH * max(x[1] - x[0], 0.05))
    model.limits = limits
    return model


def accepted(reach: float, limits: dict[str, tuple[float, float]]):
    """The condition that a scored row isn't rejected."""
    def within(mid: float, top: float):
        width = reach * (max(top - mid, 0.05) + 3 / F.sqrt(F.greatest(F.col("n_symbols"), F.lit(1)).cast("double")))
        return F.col("entropy") <= top + width

    # where all training rows were too short to calibrate, nothing is rejected
    ok = within(*limits["und"]) if "und" in limits else F.lit(True)
    for lang, limit in limits.items():
        ok = F.when(F.col("lang_pred") == lang, within(*limit)).otherwise(ok)
    return ok & (F.col("lang_pred") != "und")


def training(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id"), 3, 1)).filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score, entropy, n_symbols, accepted of docs, learnt from its own training rows."""
    rows = training(docs)
    model = train(rows)
    return scores(docs, calibrate(rows, model)).withColumn("accepted", accepted(REACH, model.limits))


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of docs that are not rejected, with docs' columns. Scoring goes along with the row, so nothing is shuffled."""
    rows = training(docs)
    model = calibrate(rows, train(rows))
    fields = docs.schema
    names = [f"c{k}" for k in range(len(fields))]

    sent, name = docs.sparkSession.sparkContext.broadcast(model), model.name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sole(name, lambda: Scorer(sent.value))
        for b in batches:
            texts = b.column(text_at).to_pylist()
            keep, at = [], 0
            while at < len(texts):
                lot, size = [], 0
                while at < len(texts) and size < 1_000_000:
                    lot.append(texts[at])
                    size += len(texts[at] or "")
                    at += 1
                sums, n = scorer.sums(lot)
                keep += [accepts(model, s, m) for s, m in zip(sums, n.tolist(), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    text_at = fields.names.index("text")
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields, strict=True))
    return docs.toDF(*names).mapInArrow(run, kinds).toDF(*fields.names)


def accepts(model: Model, sums: np.ndarray, n: int) -> bool:
    """What accepted() says, for one row."""
    if not n or not len(sums):
        return False
    k = int(sums.argmax())
    if (limit := model.limits.get(model.langs[k], model.limits.get("und"))) is None:
        return True
    mid, top = limit
    return -sums[k] / n <= top + REACH * (max(top - mid, 0.05) + 3 / n**0.5)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scores(docs, train(training(docs)))
    return out.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "entropy", "n_symbols")
