"""Queries on rows: conditions, keys, cards, labels, buckets, text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from responsa.functions import keys, normalize, text
from responsa.plans.registry import query
from responsa.sources import adapter

NUL = "chr(0)"
SHA = lambda *parts: f"sha256({' || '.join(f'({p}) || {NUL}' for p in parts)})"
SHA1 = lambda p: f"substr(sha1(({p}) || {NUL}), 1, 16)"


@query("P01 P02 P03 P04", """SELECT test_condition, condition, CASE WHEN test_condition IS NULL OR test_condition IN ('', 'nan') THEN 'none' ELSE test_condition END AS profiling,
  lower(trim(coalesce(test_condition, ''))) AS routing, CASE WHEN lower(trim(coalesce(test_condition, ''))) IN ('', 'nan', 'none', 'null') THEN 'none' ELSE lower(trim(test_condition)) END AS one_hot, count(*) AS n
  FROM resp GROUP BY ALL""")
def normalized_conditions(spark, d):
    c = F.col("test_condition")
    df = adapter.responses(spark, d).select(c, "condition", normalize.condition_profiling(c).alias("profiling"), normalize.condition_routing(c).alias("routing"), normalize.condition_column(c).alias("one_hot"))
    return df.groupBy(*df.columns).agg(F.count("*").alias("n"))


@query("P05 P06 P07 P08", f"""SELECT row_id, {SHA("'Name: ' || display_name")} AS subject_key, {SHA("benchmark", "condition", "item_content")} AS item_key, {SHA("benchmark", "item_content")} AS item_split_key,
  benchmark || '::' || condition AS benchmark_condition_key, benchmark || '::' || {SHA1("item_content")} AS harness_split_key FROM resp""")
def stable_keys(spark, d):
    df = keys.add_stable_keys(adapter.responses(spark, d))
    return df.select("row_id", "subject_key", "item_key", "item_split_key", "benchmark_condition_key", keys.split_key(F.col("benchmark"), F.col("item_content")).alias("harness_split_key"))


VARIANTS = f"""multi AS (SELECT benchmark, max(n) <= 1 AS single FROM (SELECT benchmark, item_id, count(DISTINCT condition) AS n FROM resp GROUP BY 1, 2) GROUP BY 1),
variants AS (SELECT resp.*, CASE WHEN single THEN benchmark || '::' || item_id ELSE benchmark || '::' || {SHA1("condition || '|' || item_content")} END AS item_variant_id FROM resp JOIN multi USING (benchmark)),
categories AS (SELECT *, 'cat_' || lpad(((('0x' || substr(sha1('0:' || item_variant_id), 1, 16))::UBIGINT) % 15)::varchar, 2, '0') AS data_category FROM variants)"""


@query("P09", f", {VARIANTS} SELECT row_id, item_variant_id FROM variants")
def item_variant_ids(spark, d):
    return keys.add_item_variant_id(adapter.responses(spark, d)).select("row_id", "item_variant_id")


@query("P10 P11", f", {VARIANTS} SELECT data_category, count(*) AS n, count(DISTINCT item_variant_id) AS n_variants FROM categories GROUP BY 1")
def data_category_counts(spark, d):
    df = keys.add_item_variant_id(adapter.responses(spark, d)).withColumn("data_category", keys.data_category(F.col("item_variant_id")))
    return df.groupBy("data_category").agg(F.count("*").alias("n"), F.countDistinct("item_variant_id").alias("n_variants"))


CARD = "'Name: ' || trim(display_name) || chr(10) || 'Organization: ' || organization || chr(10) || 'Parameters: ' || params || chr(10) || 'Family: ' || family"


@query("P12 P13 P14 P15 P16", f"""SELECT subject_id, {CARD} AS card, CASE WHEN params = 0 THEN 'Name: ' || display_name || chr(10) || 'Organization: ' || organization || chr(10) || 'Family: ' || family ELSE {CARD} END AS card_truthy,
  display_name AS name, display_name AS name_any_case, display_name AS name_by_lines FROM (SELECT *, subject_id::bigint % 7 AS params FROM subj)""")
def subject_cards(spark, d):
    s = adapter.subjects(spark, d).withColumn("params", F.col("subject_id").cast("long") % 7)
    fields = {"Organization": F.col("organization"), "Parameters": F.col("params"), "Family": F.col("family")}
    s = s.select("subject_id", normalize.subject_card(F.col("display_name"), F.col("subject_id"), **fields).alias("card"), normalize.subject_card_truthy(F.col("display_name"), F.col("subject_id"), **fields).alias("card_truthy"))
    return s.withColumns({"name": normalize.name_of_card(F.col("card")), "name_any_case": normalize.name_of_card_any_case(F.col("card")), "name_by_lines": normalize.name_by_lines(F.col("card"))})


@query("P17", """SELECT display_name, coalesce(nullif(trim(regexp_replace(trim(split_part(split_part(lower(display_name), '-', 1), ':', 1)), '[0-9]', '', 'g')), ''), '<unknown>') AS subject_family
  FROM (SELECT display_name FROM subj UNION ALL SELECT p_name || '-' || p_type || ':' || p_size FROM part UNION ALL SELECT p_size || '-b' FROM part) t(display_name)""")
def subject_families(spark, d):
    p = adapter.table(spark, d, "part")
    names = adapter.subjects(spark, d).select("display_name").unionByName(p.select(F.concat(F.concat_ws("-", "p_name", "p_type"), F.lit(":"), "p_size").alias("display_name"))).unionByName(p.select(F.concat("p_size", F.lit("-b")).alias("display_name")))
    return names.select("display_name", normalize.family_of_name(F.col("display_name")).alias("subject_family"))


STEPS = lambda x, steps, last: "CASE WHEN {0} IS NULL THEN 'unknown' {1} ELSE '{2}' END".format(x, " ".join(f"WHEN {x} < {t} THEN '{n}'" for t, n in steps), last)


@query("P18 P19 P20", f"""SELECT p_partkey, params, {STEPS("params", normalize.PARAMS, "huge_200B+")} AS params_bucket, {STEPS("released", normalize.RELEASE, "ancient")} AS release_bucket
  FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE (p_size * 7)::double END AS params, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice END AS released FROM part)""")
def params_buckets(spark, d):
    p = adapter.table(spark, d, "part")
    raw = F.when(F.col("p_size") % 5 == 0, F.lit(" Unknown ")).otherwise(F.concat((F.col("p_size") * 7).cast("string"), F.lit(" ")))
    params, released = normalize.safe_float(raw), F.when(F.col("p_size") % 7 == 0, None).otherwise(F.col("p_retailprice"))
    return p.select("p_partkey", params.alias("params"), normalize.params_bucket(params).alias("params_bucket"), normalize.release_bucket(released).alias("release_bucket"))


FLAGS = ", ".join(f"(s <> '' AND list_contains(keys, '{k}'))::int AS cond_has_{k}" for k in normalize.CONDITION_KEYS)


@query("P21", f"""SELECT DISTINCT test_condition, (test_condition IS NULL OR lower(trim(test_condition)) IN ('', 'none', 'nan', 'null'))::int AS cond_is_none,
  (NOT (test_condition IS NULL OR lower(trim(test_condition)) IN ('', 'none', 'nan', 'null')) AND len(list_filter(keys, lambda k: k NOT IN ({', '.join(f"'{k}'" for k in normalize.CONDITION_KEYS)}))) > 0)::int AS cond_has_other,
  {FLAGS} FROM (SELECT test_condition, coalesce(trim(test_condition), '') AS s, list_transform(string_split(coalesce(test_condition, ''), '|'), lambda x: trim(split_part(x, '=', 1))) AS keys FROM resp)""")
def condition_flags(spark, d):
    df = adapter.responses(spark, d).select("test_condition").distinct()
    return df.select("test_condition", *(c.alias(n) for n, c in normalize.condition_flags(F.col("test_condition")).items()))


@query("P22 J02", f"""SELECT row_id, params_bucket, release_bucket, params_missing, known, benchmark_age, (condition = 'none')::int AS cond_is_none FROM resp
  LEFT JOIN (SELECT display_name AS dn, {STEPS("params", normalize.PARAMS, "huge_200B+")} AS params_bucket, {STEPS("released", normalize.RELEASE, "ancient")} AS release_bucket, (params IS NULL)::int AS params_missing, 1 AS known
    FROM (SELECT display_name, CASE WHEN subject_id::bigint % 5 = 0 THEN NULL ELSE subject_id::double END AS params, subject_id::double * 11 AS released FROM subj WHERE subject_id::bigint % 9 > 0)) ON dn = display_name
  LEFT JOIN (SELECT p_brand AS b, avg(p_size) AS benchmark_age FROM part GROUP BY 1) ON b = benchmark""", "benchmark_age")
def logistic_features(spark, d):
    n = F.col("subject_id").cast("double")
    params, released = F.when(F.col("subject_id").cast("long") % 5 == 0, None).otherwise(n), n * 11
    info = adapter.subjects(spark, d).filter(F.col("subject_id").cast("long") % 9 > 0).select("display_name", normalize.params_bucket(params).alias("params_bucket"), normalize.release_bucket(released).alias("release_bucket"), params.isNull().cast("int").alias("params_missing"), F.lit(1).alias("known"))
    bench = adapter.table(spark, d, "part").groupBy(F.col("p_brand").alias("benchmark")).agg(F.avg("p_size").alias("benchmark_age"))
    rows = adapter.responses(spark, d).join(info, "display_name", "left").join(bench, "benchmark", "left")
    return rows.select("row_id", "params_bucket", "release_bucket", "params_missing", "known", "benchmark_age", (F.col("condition") == "none").cast("int").alias("cond_is_none"))


@query("P23 S04 S05 J01 U01", "SELECT row_id, subject_id, item_id, benchmark, condition, response, label, CASE WHEN response >= 0.5 THEN 1.0 ELSE 0.0 END AS hard_label, trial FROM resp", "response label hard_label", 9)
def soft_labels(spark, d):
    return adapter.keyed(spark, d).select("row_id", "subject_id", "item_id", "benchmark", "condition", "response", "label", normalize.hard_labels(F.col("response")).alias("hard_label"), "trial")


@query("P25 P43", "SELECT row_id, 'Name: ' || display_name AS subject_content, item_content, benchmark, condition, 'Benchmark: ' || benchmark || chr(10) || 'Condition: ' || condition || chr(10) || 'Item: ' || item_content AS encoder_text FROM resp")
def encoder_inputs(spark, d):
    return adapter.responses(spark, d).select("row_id", F.concat(F.lit("Name: "), "display_name").alias("subject_content"), "item_content", "benchmark", "condition", normalize.encoder_text(F.col("benchmark"), F.col("condition"), F.col("item_content")).alias("encoder_text"))


@query("P39", "SELECT row_id, ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) AS z, greatest(least(p, 1 - 1e-6), 1e-6) AS back FROM (SELECT row_id, label AS p FROM resp)", "z back")
def logits(spark, d):
    z = normalize.logit(F.col("label"))
    return adapter.keyed(spark, d).select("row_id", z.alias("z"), normalize.sigmoid(z).alias("back"))


@query("P36 P37 A28", """SELECT bucket, count(*) AS n, (ceil(least(greatest(ceil(quantile_cont(chars, 0.99)), 128), 2048) / 64) * 64)::bigint AS max_length
  FROM (SELECT n_chars::double AS chars, CASE WHEN n_chars <= 128 THEN '<=128' WHEN n_chars <= 256 THEN '<=256' WHEN n_chars <= 512 THEN '<=512' WHEN n_chars <= 1024 THEN '<=1024' ELSE '>1024' END AS bucket FROM documents) GROUP BY 1""", log=False)
def length_buckets(spark, d):
    docs = adapter.table(spark, d, "documents").select(F.col("n_chars").cast("double").alias("chars"), normalize.length_bucket(F.col("n_chars")).alias("bucket"))
    return docs.groupBy("bucket").agg(F.count("*").alias("n"), text.max_length(F.percentile("chars", F.lit(0.99))).alias("max_length"))


COUNT = lambda t, p: f"len(regexp_extract_all({t}, '{p}'))::double"
POOL = f"""(SELECT doc_id, length(text) / 4.0 + 1 AS token_len, length(text)::double AS char_len, regexp_matches(text, '{text.LATEX}')::int::double AS has_latex, regexp_matches(text, '{text.CODE}')::int::double AS has_code,
  (length(text) - length(replace(text, '?', '')))::double AS n_questions, {COUNT('text', text.NUMBER)} AS n_numbers, ({COUNT('text', text.CHOICE)} >= 2)::int::double AS is_multiple_choice, {COUNT('text', text.CHOICE)} AS n_choices,
  (len(regexp_extract_all(text, '[A-Za-z]')) >= 0.85 * len(regexp_extract_all(text, '\\p{{L}}')))::int::double AS lang_en FROM documents)"""


@query("P29 P30", f"SELECT * FROM {POOL}", log=False)
def pool_features(spark, d):
    docs = adapter.table(spark, d, "documents")
    return docs.select("doc_id", *(c.alias(n) for n, c in text.pool_features(F.col("text")).items()))


@query("A25", f"SELECT doc_id, {', '.join(f'({c} - avg({c}) OVER ()) / (CASE WHEN stddev_pop({c}) OVER () < 1e-6 THEN 1 ELSE stddev_pop({c}) OVER () END) AS {c}' for c in text.POOL)} FROM {POOL}", " ".join(text.POOL), log=False)
def zscored_pool(spark, d):
    from responsa.operators.stats import zscores

    return zscores(pool_features(spark, d), text.POOL, "doc_id")


TYPE = "CASE WHEN has_code >= 0.5 THEN 'type_code' WHEN is_multiple_choice >= 0.5 THEN 'type_mcq' WHEN has_latex >= 0.5 OR n_numbers >= 5 THEN 'type_math' ELSE 'type_prose' END"
IS_COT = "(doc_id % 3 = 0)::int::double"


@query("P26 P27 P28", f"""SELECT doc_id, is_cot, {', '.join(f"(kind = '{t}')::int::double AS {t}" for t in text.TYPES)}, {', '.join(f"is_cot * " + (f"(kind = '{b}')::int::double" if b.startswith("type_") else b) + f" AS cot_x_{b}" for b in text.COT_BASES)}
  FROM (SELECT *, {TYPE} AS kind, {IS_COT} AS is_cot FROM {POOL})""", " ".join(f"cot_x_{b}" for b in text.COT_BASES), log=False)
def item_interactions(spark, d):
    condition = F.when(F.col("doc_id") % 3 == 0, " Mode=Step-By-Step ").when(F.col("doc_id") % 3 == 1, "none").otherwise("mode=direct")
    rows = pool_features(spark, d).withColumns({"is_cot": text.is_cot(condition), **text.item_types()})
    return rows.select("doc_id", "is_cot", *text.TYPES, *(c.alias(n) for n, c in text.cot_interactions(F.col("is_cot"), rows.columns).items()))


@query("P42 P41", "SELECT sha256(string_agg(b, '' ORDER BY p)) AS content_hash, sum(n)::bigint AS n FROM (SELECT substr(h, 1, 3) AS p, sha256(string_agg(h, '' ORDER BY h)) AS b, count(*) AS n FROM (SELECT DISTINCT sha256(item_id || chr(0) || item_content || chr(0)) AS h FROM it) GROUP BY 1)")
def content_hash(spark, d):
    h = adapter.items(spark, d).select(keys.sha256_key(F.col("item_id"), F.col("item_content")).alias("h")).distinct()
    return keys.order_free_hash(h, "h")
