"""Benchmark passages in documents, by a positional inverted index of the documents' tokens.

1. Windows: each `size` consecutive words of an item; an item of fewer words is one window.
2. Term counts over all documents, for the windows' terms alone; for each window its two
   rarest terms, and their places in the window.
3. The index: postings (term, document, position) of those terms, one stored row for each
   document. A bitmap of term hashes decides what is posted; what it lets through wrongly
   meets no window.
4. Postings of a window's rarest term, offset by its place, are the first list of starts; the
   list of its second rarest term, offset by its own place, is intersected with it. At the
   starts that are left, the other terms are looked up in the document's token list (made again
   from its text), in order: a phrase match.
5. Proximity: where the second rarest term stands within `near` words of the rarest, the
   documents' tokens there must hold all terms of the window within `near` words, in any order.

A word inside any occurrence of a window (phrase match) is hit. Null text, or text without
words: no words, no hits. Items without words have no windows; items without an id hit words
but are no item that could be named. Empty tables: no hits, or no rows. Repeated rows, and rows
of one doc_id or of none: one result each. The same item_id twice: the windows of both. Very
long texts are indexed whole; a text's postings are spread over rows of their own before they
meet others. Ties among equally rare terms go to the first in the alphabet. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, fresh, small, table

SIZE, NEAR = 10, 20
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """terms (array), items (array of item_id as strings): distinct windows."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter("size(w) > 0")
    many = F.expr(f"transform(sequence(1, greatest(size(w) - {size} + 1, 1)), i -> slice(w, i, {size}))")
    return w.select("item", F.explode(many).alias("terms")).groupBy("terms").agg(F.collect_set("item").alias("items"))


def rarest(wins: DataFrame, docs: DataFrame) -> DataFrame:
    """id, terms, items, and t1, p1, t2, p2: the rarest and second rarest terms of each window in docs, and their places (from 0; t2 is null in a window of one word). Windows with a term that no document has are left out."""
    terms = cut(wins.select(F.explode("terms").alias("term")).distinct())
    counts = docs.select(F.explode(words(F.col("text"))).alias("term")).join(small(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    at = wins.select("terms", "items", F.posexplode("terms").alias("place", "term")).join(small(cut(counts)), "term", "left")
    by = at.groupBy("terms", "items").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "place"))).alias("x")).filter("x[0].n > 0")
    two = lambda k, c: F.get("x", F.lit(k))[c]
    return by.select(F.monotonically_increasing_id().alias("id"), "terms", "items", two(0, "term").alias("t1"), two(0, "place").alias("p1"), two(1, "term").alias("t2"), two(1, "place").alias("p2"))


def bitmap(terms: DataFrame) -> tuple[Column, int]:
    """An array of longs with the bits of the terms' hashes, 64 bits or more for each term, 2^23 bits at most; and how many bits."""
    n = terms.count()
    size = 1 << min(23, max(12, (64 * n).bit_length()))
    got = terms.select(F.pmod(F.xxhash64("term"), F.lit(size)).alias("h")).groupBy(F.shiftright("h", 6).cast("int").alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("w"))
    longs = [0] * (size // 64)
    for r in got.collect():  # at most 2^17 rows
        longs[r.k] = r.w
    return F.from_json(F.lit("[" + ",".join(map(str, longs)) + "]"), "array<bigint>"), size


def text_key(text: Column) -> Column:
    """Equal for equal texts only (128 bits)."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """row, doc_id, key (of the text), n_words, postings (array of term, pos): one row for each row of docs."""
    bits, n = bitmap(terms)
    base = docs.select("doc_id", text_key(F.col("text")).alias("key"), words(F.col("text")).alias("w")).withColumn("bits", bits)
    marked = f"transform(w, (x, i) -> if((shiftright(bits[cast(shiftright(pmod(xxhash64(x), {n}), 6) as int)], cast(pmod(xxhash64(x), 64) as int)) & 1L) = 1L, i, -1))"
    posted = F.expr(f"transform(array_remove({marked}, -1), p -> named_struct('term', w[p], 'pos', p))")
    return base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", F.size("w").cast("long").alias("n_words"), posted.alias("postings"))


def postings(stored: DataFrame) -> DataFrame:
    return stored.filter("size(postings) > 0").select("row", F.explode("postings").alias("p")).select("row", "p.term", "p.pos")


def looked_up(met: DataFrame, stored: DataFrame, wins: DataFrame, docs: DataFrame) -> DataFrame:
    """met (row, id, ...) with terms, the window's, and w, the document's token list: made again for the texts that are asked for, as all lists would take more room than the texts."""
    asked = cut(met.join(stored.select("row", "key"), "row"))
    keys = small(cut(asked.select("key").distinct()))
    texts = docs.select(text_key(F.col("text")).alias("key"), "text").join(keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    return asked.join(texts.select("key", words(F.col("text")).alias("w")), "key").join(small(wins.select("id", "terms")), "id")


def phrases(stored: DataFrame, wins: DataFrame, docs: DataFrame) -> DataFrame:
    """row, id, start: occurrences of windows (stored)."""
    lists = postings(stored)
    first = small(wins.select("id", F.col("t1").alias("term"), "p1", "t2", "p2"))
    starts = lists.join(first, "term").select("row", "id", (F.col("pos") - F.col("p1")).alias("start"), "t2", "p2").filter("start >= 0")
    second = lists.select("row", F.col("term").alias("t2"), F.col("pos").alias("at2"))
    met = starts.filter("t2 IS NOT NULL").withColumn("at2", F.col("start") + F.col("p2")).join(second, ["row", "t2", "at2"], "left_semi").select("row", "id", "start")
    met = met.unionByName(starts.filter("t2 IS NULL").select("row", "id", "start"))
    return looked_up(met, stored, wins, docs).filter("slice(w, start + 1, size(terms)) = terms").select("row", "id", "start")


def nearby(stored: DataFrame, wins: DataFrame, docs: DataFrame, near: int) -> DataFrame:
    """row, id: windows of two words or more whose terms all stand within `near` words of the row, in any order."""
    lists = postings(stored)
    first = small(wins.filter("t2 IS NOT NULL").select("id", F.col("t1").alias("term"), "t2"))
    # positions meet by stretches of `near` words, the stretches on either side included
    one = lists.join(first, "term").select("row", "id", "t2", "pos", F.explode(F.expr(f"sequence(cast(pos / {near} as int) - 1, cast(pos / {near} as int) + 1)")).alias("stretch"))
    two = lists.select("row", F.col("term").alias("t2"), F.expr(f"cast(pos / {near} as int)").alias("stretch"), F.col("pos").alias("at2"))
    met = one.join(two, ["row", "t2", "stretch"]).filter(f"abs(pos - at2) < {near}").select("row", "id", "pos").distinct()
    # cheap first: all terms are in the words on either side; then in one of the spans of `near` words
    around = F.expr(f"slice(w, greatest(pos - {near - 1}, 0) + 1, least(pos, {near - 1}) + {near})")
    looked = looked_up(met, stored, wins, docs).select("row", "id", "terms", around.alias("around")).filter("size(array_except(terms, around)) = 0")
    span = f"exists(sequence(1, greatest(size(around) - {near} + 1, 1)), s -> size(array_except(terms, slice(around, s, {near}))) = 0)"
    return looked.filter(span).select("row", "id").distinct()


def found(docs: DataFrame, items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(the stored index, the stored windows)."""
    wins = cut(rarest(cut(windows(items, size)), docs))
    terms = wins.select(F.col("t1").alias("term")).unionByName(wins.filter("t2 IS NOT NULL").select(F.col("t2").alias("term"))).distinct()
    return cut(index(docs, terms)), wins


def find(docs: DataFrame, items: DataFrame, size: int = SIZE, near: int = NEAR) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and n_near (items with a window within `near` words, in any order) of each row of docs."""
    stored, wins = found(docs, items, size)
    named = small(wins.select("id", "items", F.size("terms").alias("length")))
    hits = phrases(stored, wins, docs).join(named, "id").groupBy("row").agg(F.collect_set(F.struct("start", "length")).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.expr("size(array_distinct(flatten(transform(at, x -> sequence(x.start, x.start + x.length - 1)))))")
    hits = hits.select("row", covered.cast("long").alias("n_hit"), "items")
    close = nearby(stored, wins, docs, near).join(named, "id").groupBy("row").agg(F.size(F.array_distinct(F.flatten(F.collect_set("items")))).cast("long").alias("n_near"))
    out = stored.select("row", "doc_id", "n_words").join(hits.join(close, "row", "full"), "row", "left")
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    got = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n.alias("n_hit"), F.size(got).cast("long").alias("n_items"), F.sha2(F.array_join(got, ",").cast("binary"), 256).alias("items_sha256"), (n > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))


def keep_clean(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows of docs whose text has no hit; rows go by their texts, whatever their doc_id."""
    name = fresh(docs, "bad")
    stored, wins = found(docs, items, size)
    bad = stored.select("row", "key").join(phrases(stored, wins, docs).select("row").distinct(), "row").select(F.col("key").alias(name)).distinct()
    return docs.join(small(cut(bad)), text_key(F.col("text")) == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("doc_id", F.col("doc_id").cast("long"))


ORACLE = r"""
WITH low AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT item_id::varchar AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, list_slice(w, i, least(i + 9, len(w))) AS terms FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(terms) AS n FROM wins),
grams AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS terms FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item FROM grams JOIN wins USING (terms)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
counts AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM low) GROUP BY 1),
rare AS (SELECT item, terms, arg_min(word, n) AS word FROM (SELECT item, terms, unnest(terms) AS t FROM wins WHERE len(terms) > 1) JOIN counts ON t = word GROUP BY item, terms),
post AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM low),
cand AS (SELECT doc_id, item, terms, pos, list_slice(w, greatest(pos - 19, 1), pos + 19) AS x FROM rare JOIN post USING (word) JOIN low USING (doc_id)),
near AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM cand WHERE list_has_all(x, terms) AND len(list_filter(range(1, 21), lambda s: list_has_all(list_slice(x, s, s + 19), terms))) > 0 GROUP BY doc_id),
names AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_near, 0)::bigint AS n_near, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN near USING (doc_id)
"""
