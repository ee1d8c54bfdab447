"""Personal data in documents, and terms that give it away by how they occur with it.

Base spans: e-mail addresses, IP addresses, card and phone numbers by pattern and test.
A protected entity is a base span's kind and text. Terms are the words of a document, in
lower case. Over the corpus, with N documents, n(e) of which hold the entity, n(t) the
term and n(e, t) both, the term discloses the entity by the point-wise mutual information
  pmi = log2(N * n(e, t) / (n(e) * n(t))),
as a share of the entity's information, log2(N / n(e)). Documents with a supported entity are
folded by text before they are counted, so copies alone prove nothing; the others count by
row. An entity has support, and so does a term with it, if SUPPORT texts or more show it;
what is seen less often is chance. A share of at least GENERALISE has the term replaced by a
more general mark ([NAME], [NUMBER] or [WORD], by its form), of at least REMOVE removed, at
each of its places in documents with the entity. Added spans have kind `term`; base spans
stay, and a word that touches one is hidden with it.

Counts come before joins: words of all documents are counted, and only then meet the words
of documents with a supported entity. A term is left out early only if its n(t) alone keeps
its share below GENERALISE for any n(e, t), so nothing is lost.

Null text: empty. Empty table: no rows. Repeated rows: one result each. Rows of one doc_id, or
without one, are judged by their texts. Very long texts: patterns don't backtrack over a run,
and positions are sums over the gaps between matches. Spans of one kind never overlap; of a
term that discloses several entities the largest share counts. Other columns of docs, whatever
their names, pass through `sanitise` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small, table

#: The patterns of the base kinds, here so written that no run is scanned again from each of its characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests of whether a text can hold a kind.
HINTS = {
    "email": "contains(text, '@')",
    "ip": r"text rlike '[0-9]\\.[0-9]'",
    "card": r"text rlike '[0-9](?:[ -]?[0-9]){15}'",
    "phone": "contains(text, '+')",
}
KINDS = [*PATTERNS, "term"]
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
WORD, BREAK = r"[\p{L}\p{N}]{2,}", r"[^\p{L}\p{N}]+"


def valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    parts = F.transform(F.split(value, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    small_parts = F.forall(parts, lambda x: (F.length(x) <= 3) & (F.lpad(x, 3, "0") <= "255"))
    n = F.length(digits)
    # Luhn: from the right, every second digit doubled, less 9 where that is two digits
    one = lambda i: F.substring(digits, i, F.lit(1)).try_cast("int")
    figure = lambda i: F.when((n - i) % 2 == 0, one(i)).otherwise((one(i) * 2) % 10 + F.floor(one(i) / 5).cast("int"))
    luhn = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(19))), figure), F.lit(0), lambda a, x: a + x) % 10 == 0
    return F.when(kind == "email", True).when(kind == "ip", small_parts).when(kind == "card", n.between(16, 19) & luhn).otherwise(n.between(8, 15))


def quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def text_key(text: Column) -> Column:
    """Equal for equal texts only (128 bits)."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def matches(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, found: for each kind the matches of the pattern, valid or not: kind, value, gap (characters since the last one)."""
    cols, every = [], []
    for kind, pattern in PATTERNS.items():
        cols.append(F.expr(f"if({HINTS[kind]}, regexp_extract_all(text, '{quoted(pattern)}', 0), array())").alias(f"h_{kind}"))
        cols.append(F.expr(f"if({HINTS[kind]}, split(text, '{quoted(pattern)}', -1), array())").alias(f"g_{kind}"))
        every.append(f"transform(h_{kind}, (v, i) -> named_struct('kind', '{kind}', 'value', v, 'gap', char_length(g_{kind}[i])))")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_key(F.col("text")).alias("text_hash"), *cols)
    return base.select("row", "doc_id", "text_hash", F.expr(f"concat({', '.join(every)})").alias("found"))


def base_spans(stored: DataFrame) -> DataFrame:
    """text_hash, copies (rows with the text), kind, value, start, end of valid matches, once for each text."""
    texts = stored.filter("size(found) > 0").groupBy("text_hash").agg(F.count("*").alias("copies"), F.first("found").alias("found"))
    flat = texts.select("text_hash", "copies", F.posexplode("found").alias("k", "x")).select("text_hash", "copies", "k", "x.*")
    so_far = Window.partitionBy("text_hash", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    n = F.char_length("value")
    flat = flat.withColumn("end", F.sum(F.col("gap") + n).over(so_far)).withColumn("start", F.col("end") - n)
    return flat.filter(valid(F.col("kind"), F.col("value"))).select("text_hash", "copies", "kind", "value", "start", "end")


def holding(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """text_hash, text of docs, once for each text of texts (stored, distinct)."""
    hint = F.expr(" or ".join(f"coalesce({HINTS[k]}, false)" for k in PATTERNS))
    some = docs.select("text").filter(hint).select(text_key(F.col("text")).alias("text_hash"), "text")
    return some.join(small(texts), "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))


def distinct_words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK)), lambda w: F.char_length(w) >= 2)


def disclosures(docs: DataFrame, total: int, spans: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """text_hash, term, share: in which texts which terms disclose an entity of that text, and the largest share of its information that they give. total: rows of docs."""
    held = cut(spans.select("text_hash", "copies", "kind", "value").distinct())
    entities = cut(held.groupBy("kind", "value").agg(F.count("*").alias("ne")).filter(F.col("ne") >= support))
    holders = cut(held.join(small(entities), ["kind", "value"]))
    texts = cut(holders.select("text_hash", "copies").distinct())
    folded, rows = texts.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    n = float(max(total - rows + folded, 1))
    most = entities.agg(F.max("ne")).first()[0] or 0
    words = cut(holding(docs, texts.select("text_hash")).select("text_hash", F.explode(distinct_words(F.col("text"))).alias("term")))
    # n(t): by row everywhere, but by text where an entity is
    inside = words.join(texts, "text_hash").groupBy("term").agg(F.count("*").alias("by_text"), F.sum("copies").alias("by_row")).filter(F.col("by_text") >= support)
    everywhere = docs.select(F.explode(distinct_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("all"))
    bound = lambda ne: F.lit(n) / F.pow(F.lit(n) / ne, F.lit(generalise)) * (1 + 1e-9)
    terms = everywhere.join(inside, "term").select("term", (F.col("all") - F.col("by_row") + F.col("by_text")).alias("nt")).filter(F.col("nt") <= bound(F.lit(float(max(most, 1)))))
    near = words.join(small(cut(terms)), "term").join(holders.select("text_hash", "kind", "value", "ne"), "text_hash").filter(F.col("nt") <= bound(F.col("ne")))
    near = cut(near.select("text_hash", "term", "nt", "kind", "value", "ne"))
    pairs = near.groupBy("kind", "value", "term", "ne", "nt").agg(F.count("*").alias("net")).filter(F.col("net") >= support)
    pmi = F.log2(F.lit(n) * F.col("net") / (F.col("ne") * F.col("nt")))
    share = F.when(F.col("ne") < n, pmi / F.log2(F.lit(n) / F.col("ne"))).otherwise(0.0)
    told = cut(pairs.select("kind", "value", "term", share.alias("share")).filter(F.col("share") >= generalise))
    return near.join(small(told), ["kind", "value", "term"]).groupBy("text_hash", "term").agg(F.max("share").alias("share"))


def term_spans(docs: DataFrame, told: DataFrame, base: DataFrame) -> DataFrame:
    """text_hash, start, end, share, form of each place of told terms (text_hash, term, share; stored) that touches no base span."""
    texts = holding(docs, cut(told.select("text_hash").distinct()))
    split = texts.select("text_hash", F.expr(f"regexp_extract_all(text, '{quoted(WORD)}', 0)").alias("w"), F.expr(f"split(text, '{quoted(WORD)}', -1)").alias("g"))
    flat = split.select("text_hash", F.posexplode(F.expr("transform(w, (x, i) -> named_struct('word', x, 'gap', char_length(g[i])))")).alias("k", "x")).select("text_hash", "k", "x.*")
    n = F.char_length("word")
    so_far = Window.partitionBy("text_hash").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    flat = flat.withColumn("end", F.sum(F.col("gap") + n).over(so_far)).withColumn("start", F.col("end") - n).withColumn("term", F.lower("word"))
    form = F.when(F.col("word").rlike(r"^\p{N}+$"), "NUMBER").when(F.col("word").rlike(r"^\p{Lu}"), "NAME").otherwise("WORD")
    hits = flat.join(told, ["text_hash", "term"]).select("text_hash", "start", "end", "share", form.alias("form"))
    # a word touches a base span if, of those that begin before the word's end, one ends behind its start
    both = hits.select("text_hash", (F.col("end") - 1).alias("at"), F.lit(1).alias("is_word"), "start", "end", "share", "form")
    some = base.join(small(cut(told.select("text_hash").distinct())), "text_hash", "left_semi")
    both = both.unionByName(some.select("text_hash", F.col("start").alias("at"), F.lit(0).alias("is_word"), "start", "end", F.lit(None).cast("double").alias("share"), F.lit(None).cast("string").alias("form")))
    before = Window.partitionBy("text_hash").orderBy("at", "is_word").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("is_word") == 0, F.col("end"))).over(before)
    both = both.withColumn("reach", reach).filter("is_word = 1 AND (reach IS NULL OR reach <= start)")
    return both.select("text_hash", "start", "end", "share", "form")


def all_spans(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, text_hash of each row of docs; text_hash, kind, start, end, share, form of base and added spans, once for each text), both stored."""
    stored = cut(matches(docs))
    base = cut(base_spans(stored))
    told = cut(disclosures(docs, stored.count(), base, support, generalise))
    spans = base.select("text_hash", "kind", "start", "end", F.lit(None).cast("double").alias("share"), F.lit(None).cast("string").alias("form"))
    if not told.isEmpty():
        spans = spans.unionByName(term_spans(docs, told, base).withColumn("kind", F.lit("term")))
    return stored.select("row", "doc_id", "text_hash"), cut(spans)


def find(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row of docs."""
    rows, spans = all_spans(docs, support)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "start", "end", "kind"))), lambda x: F.struct(x["kind"].alias("kind"), F.concat_ws(":", x["kind"], x["start"], x["end"]).alias("s")))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in PATTERNS]
    by_text = spans.groupBy("text_hash").agg(*counts, sorted_.alias("x"))
    text = lambda x: F.array_join(F.transform(x, lambda y: y["s"]), ",")
    by_text = by_text.select("text_hash", *(f"n_{k}" for k in PATTERNS), text(F.filter("x", lambda y: y["kind"] != "term")).alias("base"), text(F.col("x")).alias("spans"))
    out = rows.join(by_text, "text_hash", "left")
    return out.select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in PATTERNS), F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def sanitise(docs: DataFrame, remove: float = REMOVE) -> DataFrame:
    """docs with base spans replaced by [EMAIL], [IP], [CARD] or [PHONE], and disclosing terms by [NAME], [NUMBER], [WORD] or nothing; n_chars, where there is such a column, follows."""
    hint = F.expr(" or ".join(f"coalesce({HINTS[k]}, false)" for k in PATTERNS))
    marks = all_spans(docs)[1]
    # spans of different kinds that overlap become one, under the first kind's mark
    line = Window.partitionBy("text_hash").orderBy("start", F.desc("end"), "kind")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    marks = marks.withColumn("new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)).withColumn("g", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    sign = F.when(F.col("kind") == "term", F.when(F.col("share") >= remove, "").otherwise(F.concat(F.lit("["), "form", F.lit("]")))).otherwise(F.concat(F.lit("["), F.upper("kind"), F.lit("]")))
    merged = marks.groupBy("text_hash", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(sign, F.struct("start", -F.col("end"), "kind")).alias("sign"))
    edits = cut(merged.groupBy(F.col("text_hash").alias("mark_text")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "sign"))).alias("edits")))
    # the row goes along as one value, so that its columns can have any names; rows that can't hold any kind pass untouched
    can = docs.filter(hint).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "text")
    piece = "transform(edits, (x, i) -> concat(substring(text, if(i = 0, 0L, edits[i - 1].end) + 1, x.start - if(i = 0, 0L, edits[i - 1].end)), x.sign))"
    text = F.expr(f"concat(array_join({piece}, ''), substring(text, edits[size(edits) - 1].end + 1))".replace("0L", "cast(0 as bigint)"))
    edited = can.join(edits, text_key(F.col("text")) == F.col("mark_text"), "left").withColumn("new_text", F.when(F.col("edits").isNull(), F.col("text")).otherwise(text))
    chars = F.when(F.col("edits").isNull(), F.col("doc.n_chars")).otherwise(F.char_length("new_text")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    columns = [F.col("new_text").alias(c) if c == "text" else chars.alias(c) if c == "n_chars" else F.col(f"doc.`{c}`") for c in docs.columns]
    return edited.select(*columns).unionByName(docs.filter(~hint))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents")).withColumn("doc_id", F.col("doc_id").cast("long"))
