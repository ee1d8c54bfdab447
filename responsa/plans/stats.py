"""Queries on groups: statistics, pass rates, shrunk means, weights, profiles, votes, vocabularies, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from responsa.functions import normalize
from responsa.operators import quality, splits, stats
from responsa.plans.registry import query
from responsa.plans.scalar import SHA
from responsa.sources import adapter

#: Rows with an item cluster and benchmark-condition; SQL and DataFrame.
CLUSTERED = """clu AS (SELECT p_partkey::varchar AS item_id, label + 1 AS cluster FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings)),
rows_ AS (SELECT resp.*, cluster, benchmark || '::' || condition AS bc FROM resp JOIN clu USING (item_id))"""


def clusters(spark, d):
    vecs = adapter.table(spark, d, "embeddings")
    n = vecs.agg(F.count("*").alias("n"))
    return adapter.table(spark, d, "part").crossJoin(n).join(vecs, F.col("vec_id") == F.col("p_partkey") % F.col("n")).select(F.col("p_partkey").cast("string").alias("item_id"), (F.col("label") + 1).alias("cluster"))


def clustered(spark, d):
    return adapter.keyed(spark, d).join(clusters(spark, d), "item_id").withColumn("bc", F.concat_ws("::", "benchmark", "condition"))


#: Rows of a registry that may be broadcast.
FEW = 500_000


def few(df):
    """df (read from a file), marked for broadcast up to FEW rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def clustered_rows(spark, d):
    """row_id, subject_id, cluster, bc, label, as clustered() has them: items' registry and clusters are joined first, so the log is moved for its orders only."""
    it = adapter.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_brand").alias("benchmark"))
    it = it.join(clusters(spark, d).withColumn("placed", F.lit(True)), "item_id", "left")
    rows = adapter.raw(spark, d).join(few(it), "item_id", "left")
    tops = stats.stored(normalize.tops(rows, "response", "benchmark"))  # else each use of the rows moves the log for them again
    stats.release(rows)
    rows = normalize.soft_labels(rows, "response", "benchmark", tops).filter("placed")
    return rows.select("row_id", "subject_id", "cluster", F.concat_ws("::", "benchmark", normalize.condition(F.col("test_condition"))).alias("bc"), "label")


@query("A01", "SELECT row_id FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS i FROM (SELECT *, count(*) OVER (PARTITION BY subject_id) AS s FROM resp) WHERE s >= 600) WHERE i >= 28")
def pruned_log(spark, d):
    return stats.prune(adapter.responses(spark, d), 600, 28).select("row_id")


KEYED = f"k AS (SELECT *, {SHA('benchmark', 'condition', 'item_content')} AS item_key FROM resp)"
SIZES = lambda key, name: f"""UNNEST([struct_pack(metric := '{name}_mean', value := avg(n)::double), struct_pack(metric := '{name}_p50', value := quantile_cont(n, 0.5)::double), struct_pack(metric := '{name}_p90', value := quantile_cont(n, 0.9)::double), struct_pack(metric := '{name}_p99', value := quantile_cont(n, 0.99)::double), struct_pack(metric := '{name}_max', value := max(n)::double)], recursive := true) FROM (SELECT count(*) AS n FROM k GROUP BY {key})"""


@query("A02", f""", {KEYED}, wide AS (SELECT count(*)::double AS n_rows, count(DISTINCT subject_id)::double AS n_subjects, count(DISTINCT item_key)::double AS n_items, count(DISTINCT benchmark)::double AS n_benchmarks, count(DISTINCT condition)::double AS n_conditions, avg(label) AS label_mean,
    count(*) FILTER (length(item_content) = 0)::double AS blank_item_content_rows, count(*) FILTER (length(display_name) = 0)::double AS blank_subject_content_rows FROM k)
  SELECT metric, value FROM (UNPIVOT wide ON * INTO NAME metric VALUE value) UNION ALL SELECT {SIZES('subject_id', 'rows_per_subject')} UNION ALL SELECT {SIZES('item_key', 'rows_per_item')}
  UNION ALL SELECT 'duplicate_rows', coalesce(sum(n), 0)::double FROM (SELECT count(*) AS n FROM k GROUP BY subject_id, item_key, label HAVING count(*) > 1)
  UNION ALL SELECT 'inconsistent_pairs', count(*)::double FROM (SELECT 1 FROM k GROUP BY subject_id, item_key HAVING count(DISTINCT label) > 1)""", "value")
def dataset_stats(spark, d):
    return stats.dataset_stats(adapter.keyed(spark, d))


@query("A02 J03", "SELECT benchmark, avg(label) AS mean, count(*) AS n FROM resp WHERE subject_id IN (SELECT subject_id FROM subj WHERE macro_family IN (SELECT r_name FROM region WHERE r_regionkey < 3)) AND item_id NOT IN (SELECT item_id FROM it WHERE item_content LIKE 'red%') GROUP BY 1", "mean")
def benchmark_means(spark, d):
    few = adapter.subjects(spark, d).join(adapter.table(spark, d, "region").filter("r_regionkey < 3"), F.col("macro_family") == F.col("r_name"), "left_semi")
    red = adapter.items(spark, d).filter(F.col("item_content").startswith("red"))
    return stats.means(adapter.keyed(spark, d).join(few, "subject_id", "left_semi").join(red, "item_id", "left_anti"), "benchmark")


@query("A03 A04", "SELECT subject_id, item_id, avg(label) AS passrate, count(*) AS n FROM resp GROUP BY 1, 2", "passrate")
def passrate_table(spark, d):
    return stats.passrates(adapter.keyed(spark, d))


@query("A05 J14", f""", {CLUSTERED}, cell AS (SELECT subject_id, cluster, avg(label) AS c, count(*) AS n FROM rows_ GROUP BY 1, 2), own AS (SELECT subject_id, avg(label) AS o FROM resp GROUP BY 1)
  SELECT subject_id, cluster, coalesce(c, o) AS passrate, coalesce(n, 0) AS n FROM own CROSS JOIN (SELECT DISTINCT cluster FROM clu) LEFT JOIN cell USING (subject_id, cluster)""", "passrate")
def cluster_passrate(spark, d):
    return stats.cluster_passrates(adapter.keyed(spark, d), clusters(spark, d))


@query("A06 J18", """SELECT 'family' AS kind, family AS trait, item_id, avg(label) AS passrate, count(*) AS n FROM resp GROUP BY ALL UNION ALL SELECT 'macro_family', macro_family, item_id, avg(label), count(*) FROM resp GROUP BY ALL UNION ALL SELECT 'organization', organization, item_id, avg(label), count(*) FROM resp GROUP BY ALL""", "passrate")
def trait_passrates(spark, d):
    from functools import reduce

    df = adapter.keyed(spark, d)
    one = [stats.trait_passrates(df, t).select(F.lit(t).alias("kind"), "trait", "item_id", "passrate", "n") for t in ("family", "macro_family", "organization")]
    return reduce(lambda a, b: a.unionByName(b), one)


@query("A06 A14", "SELECT item_id, avg(label) AS item_mean, count(*) AS n, count(DISTINCT subject_id) AS n_subjects, (SELECT avg(label) FROM resp) AS global_mean FROM resp GROUP BY 1", "item_mean global_mean")
def item_stats(spark, d):
    df = adapter.keyed(spark, d)
    return stats.item_stats(df).crossJoin(df.agg(F.avg("label").alias("global_mean")))


@query("A15", "SELECT item_id, avg(p) AS item_mean, count(*) AS n_cells, avg(avg(p)) OVER () AS mean_of_means FROM (SELECT subject_id, item_id, avg(label) AS p FROM resp GROUP BY 1, 2) GROUP BY 1", "item_mean mean_of_means")
def cell_weighted_stats(spark, d):
    one = stats.passrates(adapter.keyed(spark, d)).groupBy("item_id").agg(F.avg("passrate").alias("item_mean"), F.count("*").alias("n_cells"))
    return one.crossJoin(one.agg(F.avg("item_mean").alias("mean_of_means")))


ENCODED = "subj_mean subj_log1p_n bc_mean bc_log1p_n cluster_mean cluster_log1p_n sbc_mean sbc_log1p_n sc_mean sc_log1p_n sc_minus_subj sbc_minus_subj subj_dev bc_dev cluster_dev global_mean"
MARGINAL = lambda key, name: f"{name}_t AS (SELECT {key}, (sum(label) + 30 * (SELECT avg(label) FROM rows_)) / (count(*) + 30) AS {name}_mean, ln(1 + count(*)) AS {name}_log1p_n FROM rows_ GROUP BY 1)"
CELL = lambda key, name, up: f"{name}_t AS (SELECT subject_id, {key}, (sum(label) + 30 * any_value({up}_mean)) / (count(*) + 30) AS {name}_mean, ln(1 + count(*)) AS {name}_log1p_n FROM rows_ JOIN {up}_t USING ({key}) GROUP BY 1, 2)"


@query("A07 A08 A09 A10 J10", f""", {CLUSTERED}, {MARGINAL('subject_id', 'subj')}, {MARGINAL('cluster', 'cluster')}, {MARGINAL('bc', 'bc')}, {CELL('cluster', 'sc', 'cluster')}, {CELL('bc', 'sbc', 'bc')}, g AS (SELECT avg(label) AS global_mean FROM rows_)
  SELECT row_id, subj_mean, subj_log1p_n, bc_mean, bc_log1p_n, cluster_mean, cluster_log1p_n, sbc_mean, sbc_log1p_n, sc_mean, sc_log1p_n, sc_mean - subj_mean AS sc_minus_subj, sbc_mean - subj_mean AS sbc_minus_subj, subj_mean - global_mean AS subj_dev, bc_mean - global_mean AS bc_dev, cluster_mean - global_mean AS cluster_dev, global_mean
  FROM rows_ JOIN subj_t USING (subject_id) JOIN cluster_t USING (cluster) JOIN bc_t USING (bc) JOIN sc_t USING (subject_id, cluster) JOIN sbc_t USING (subject_id, bc) CROSS JOIN g""", ENCODED)
def mean_encoded(spark, d):
    return stats.mean_encoded(clustered_rows(spark, d))


@query("A11", "SELECT subject_id, least(greatest((sum(label) + 30 * (SELECT avg(label) FROM resp)) / (count(*) + 30), 1e-6), 1 - 1e-6) AS subject_mean, ln(1 + count(*)) AS obs_log1p FROM resp GROUP BY 1", "subject_mean obs_log1p")
def subject_mean(spark, d):
    return stats.subject_means(adapter.keyed(spark, d))


SHR = lambda key, name: f"(SELECT {key}, least(greatest((sum(label) + 20 * (SELECT avg(label) FROM train)) / (count(*) + 20), 1e-6), 1 - 1e-6) AS {name} FROM train GROUP BY 1)"


@query("A12", f""", {CLUSTERED}, train AS (SELECT * FROM rows_ WHERE item_id::bigint % 10 > 0), val AS (SELECT * FROM rows_ WHERE item_id::bigint % 10 = 0)
  SELECT row_id, (SELECT avg(label) FROM train) AS p_global, coalesce(p_subject, (SELECT avg(label) FROM train)) AS p_subject, coalesce(p_bc, (SELECT avg(label) FROM train)) AS p_bc FROM val LEFT JOIN {SHR('subject_id', 'p_subject')} USING (subject_id) LEFT JOIN {SHR('bc', 'p_bc')} USING (bc)""", "p_global p_subject p_bc")
def shrinkage_baselines(spark, d):
    df = clustered(spark, d)
    val = F.col("item_id").cast("long") % 10 == 0
    return stats.shrinkage_baselines(df.filter(~val), df.filter(val)).select("row_id", "p_global", "p_subject", "p_bc")


LOGIT = lambda p: f"ln(greatest(least({p}, 1 - 1e-6), 1e-6) / (1 - greatest(least({p}, 1 - 1e-6), 1e-6)))"


@query("A13", f""", {CLUSTERED}, g AS (SELECT avg(label) AS g FROM rows_), s AS (SELECT subject_id, {LOGIT('(sum(label) + 10 * any_value(g)) / (count(*) + 10)')} AS ls FROM rows_, g GROUP BY 1), c AS (SELECT cluster, {LOGIT('(sum(label) + 10 * any_value(g)) / (count(*) + 10)')} AS lc FROM rows_, g GROUP BY 1),
  b AS (SELECT subject_id, cluster, sum(label) AS s, count(*) AS k, any_value(ls) AS ls, any_value(lc) AS lc, {LOGIT('any_value(g)')} AS lg FROM rows_ JOIN s USING (subject_id) JOIN c USING (cluster), g GROUP BY 1, 2),
  r AS (SELECT *, {LOGIT('(s + 30 / (1 + exp(-(ls + lc - lg)))) / (k + 30)')} - (ls + lc - lg) AS residual FROM b)
  SELECT subject_id, cluster, k, ls, lc, lg, residual, 1 / (1 + exp(-(ls + lc - lg + residual))) AS prediction FROM r""", "ls lc lg residual prediction")
def residual_table(spark, d):
    return stats.residual_table(clustered(spark, d))


@query("A16", "SELECT display_name, benchmark, condition, sum(label) AS successes, count(*) AS count, avg(label) AS target FROM resp GROUP BY 1, 2, 3", "successes target")
def cell_aggregation(spark, d):
    return stats.cells(adapter.keyed(spark, d))


@query("A17", f", {CLUSTERED} SELECT 'subject' AS kind, subject_id AS key, count(*) AS n FROM rows_ GROUP BY 2 UNION ALL SELECT 'bc', bc, count(*) FROM rows_ GROUP BY 2")
def train_counts(spark, d):
    df = clustered(spark, d)
    return df.groupBy(F.col("subject_id").alias("key")).agg(F.count("*").alias("n")).select(F.lit("subject").alias("kind"), "key", "n").unionByName(df.groupBy(F.col("bc").alias("key")).agg(F.count("*").alias("n")).select(F.lit("bc").alias("kind"), "key", "n"))


@query("A18", f""", {CLUSTERED}, i AS (SELECT item_id, count(*) AS n_i, min(cluster) AS c FROM rows_ GROUP BY 1), c AS (SELECT c, count(*) AS i_c FROM i GROUP BY 1), w AS (SELECT row_id, 1.0 / n_i * pow((SELECT count(*) FROM i) / (15.0 * i_c), 0.5) AS raw FROM rows_ JOIN i USING (item_id) JOIN c ON c.c = i.c)
  SELECT row_id, raw / avg(raw) OVER () AS weight FROM w""", "weight")
def sample_weights(spark, d):
    return stats.sample_weights(clustered(spark, d).select("row_id", F.col("item_id").alias("item"), F.col("cluster").alias("category"))).select("row_id", "weight")


@query("A20 P02", """, p AS (SELECT condition, count(*) AS rows, unnest(string_split(condition, '|')) AS p FROM resp WHERE condition <> 'none' GROUP BY condition), kv AS (SELECT condition, rows, trim(split_part(p, '=', 1)) AS key, substr(p, instr(p, '=') + 1) AS value FROM p WHERE contains(p, '='))
  SELECT key, count(DISTINCT value) AS n_values, sum(rows) FILTER (r = 1)::bigint AS n_rows, count(DISTINCT condition) AS n_strings FROM (SELECT *, row_number() OVER (PARTITION BY key, condition ORDER BY value) AS r FROM kv) GROUP BY 1""")
def condition_profile(spark, d):
    return stats.condition_profile(adapter.responses(spark, d))


@query("A20", "SELECT array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(condition, '|'), lambda x: contains(x, '=')), lambda x: trim(split_part(x, '=', 1))))), '+') AS keys, count(*) AS n_rows FROM resp WHERE condition <> 'none' GROUP BY 1")
def condition_pairs(spark, d):
    return stats.condition_pairs(adapter.responses(spark, d))


@query("A21", "SELECT field, n_present, n_present / (SELECT count(*) FROM resp) AS share FROM (UNPIVOT (SELECT count(nullif(display_name, '')) AS display_name, count(nullif(organization, '')) AS organization, count(nullif(test_condition, '')) AS test_condition FROM resp) ON * INTO NAME field VALUE n_present)", "share")
def field_coverage(spark, d):
    return stats.coverage(adapter.responses(spark, d), ["display_name", "organization", "test_condition"])


#: Sampled answers: what assistants say, in lower case; every ninth a refusal.
ANSWERS = "(SELECT conv_id // 3 AS item, CASE WHEN (conv_id * 7 + turn) % 9 = 0 THEN '<none>' ELSE lower(text) END AS answer FROM conversations WHERE role = 'assistant')"


def answers(spark, d):
    a = F.when((F.col("conv_id") * 7 + F.col("turn")) % 9 == 0, "<none>").otherwise(F.lower("text"))
    return adapter.table(spark, d, "conversations").filter("role = 'assistant'").select(F.floor(F.col("conv_id") / 3).alias("item"), a.alias("answer"))


@query("A22", f"""WITH a AS {ANSWERS}, n AS (SELECT item, count(*) AS n, count(*) FILTER (answer <> '<none>') AS m FROM a GROUP BY 1), p AS (SELECT item, answer, count(*) / any_value(m) AS p FROM a JOIN n USING (item) WHERE answer <> '<none>' GROUP BY 1, 2),
  q AS (SELECT item, max(p) AS top, list_sort(list(p), 'DESC')[2] AS second, sum(-p * ln(p)) AS h, count(*) AS d FROM p GROUP BY 1)
  SELECT item, coalesce(top, 0) AS self_consistency, CASE WHEN m = 0 THEN 1 WHEN m = 1 THEN 0 ELSE h / ln(m) END AS entropy, CASE WHEN m = 0 THEN 0 ELSE top - coalesce(second, 0) END AS top_gap, CASE WHEN m = 0 THEN 1 ELSE d / n END AS n_distinct, 1 - m / n AS refusal_rate FROM n LEFT JOIN q USING (item)""", "self_consistency entropy top_gap n_distinct refusal_rate", log=False)
def vote_stats(spark, d):
    return stats.vote_stats(answers(spark, d))


@query("A24", f"SELECT item, min(answer) FILTER (k = top) AS modal, CASE WHEN sum(k) < 2 THEN NULL ELSE 1 - max(k) / sum(k) END AS disagreement FROM (SELECT *, max(k) OVER (PARTITION BY item) AS top FROM (SELECT item, answer, count(*) AS k FROM {ANSWERS} WHERE answer <> '<none>' GROUP BY 1, 2)) GROUP BY 1", "disagreement", log=False)
def modal_answers(spark, d):
    k = answers(spark, d).filter("answer <> '<none>'").groupBy("item", "answer").agg(F.count("*").alias("k"))
    return k.groupBy("item").agg(F.min_by("answer", F.struct(-F.col("k"), "answer")).alias("modal"), F.when(F.sum("k") >= 2, 1 - F.max("k") / F.sum("k")).alias("disagreement"))


@query("A26", "SELECT quantile_cont(x, 0.5) AS median, avg(ln(1 + x)) AS mean, CASE WHEN stddev_pop(ln(1 + x)) = 0 THEN 1 ELSE stddev_pop(ln(1 + x)) END AS std, count(*) - count(x) AS n_missing FROM (SELECT CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_retailprice END AS x FROM part)", "median mean std", log=False)
def numeric_scaler(spark, d):
    p = adapter.table(spark, d, "part").select(F.when(F.col("p_size") % 6 == 0, None).otherwise(F.col("p_retailprice")).alias("x"))
    return stats.numeric_scaler(p, "x")


@query("A27", "SELECT benchmark, avg(label) AS mean, stddev_pop(label) AS std, avg(length(item_content)) AS chars_mean, stddev_pop(length(item_content)) AS chars_std FROM resp GROUP BY 1", "mean std chars_mean chars_std")
def population_moments(spark, d):
    n = F.length("item_content")
    return adapter.keyed(spark, d).groupBy("benchmark").agg(F.avg("label").alias("mean"), F.stddev_pop("label").alias("std"), F.avg(n).alias("chars_mean"), F.stddev_pop(n).alias("chars_std"))


@query("A28", "SELECT lang, count(*) AS n, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90, quantile_cont(n_chars, 0.99) AS p99, max(n_chars) AS longest FROM documents GROUP BY 1", "p50 p90 p99", log=False)
def length_diagnostics(spark, d):
    q = lambda x: F.percentile("n_chars", F.lit(x)).alias(f"p{int(x * 100)}")
    return adapter.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), q(0.5), q(0.9), q(0.99), F.max("n_chars").alias("longest"))


@query("A29 A30 U08", "SELECT item_id, avg(label) AS label, avg(trial) AS trial, arg_min(condition, row_id) AS first_condition, arg_min('Name: ' || display_name, row_id) AS first_card FROM resp GROUP BY 1", "label trial")
def item_averages(spark, d):
    return adapter.keyed(spark, d).groupBy("item_id").agg(F.avg("label").alias("label"), F.avg("trial").alias("trial"), F.min_by("condition", "row_id").alias("first_condition"), F.min_by(F.concat(F.lit("Name: "), "display_name"), "row_id").alias("first_card"))


@query("A32 J20", "SELECT token, (row_number() OVER (ORDER BY token) + 1)::bigint AS id FROM (SELECT test_condition AS token FROM resp WHERE test_condition IS NOT NULL GROUP BY 1 HAVING count(*) >= 100)")
def condition_vocabulary(spark, d):
    return stats.vocabulary(adapter.responses(spark, d), "test_condition", 100)


@query("J20 U09", """, v AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS id FROM (SELECT benchmark AS token FROM resp WHERE subject_id::bigint % 2 = 0 GROUP BY 1 HAVING count(*) >= 30))
  SELECT row_id, CASE WHEN test_condition IS NULL THEN 0 ELSE 2 END::bigint AS has_condition, (CASE WHEN benchmark IS NULL THEN 0 ELSE coalesce(id, 1) END)::bigint AS benchmark_id FROM resp LEFT JOIN v ON benchmark = token""")
def encoded_rows(spark, d):
    df = adapter.responses(spark, d)
    v = stats.vocabulary(df.filter(F.col("subject_id").cast("long") % 2 == 0), "benchmark", 30)
    return stats.encode(df, "benchmark", v).select("row_id", F.when(F.col("test_condition").isNull(), 0).otherwise(2).cast("long").alias("has_condition"), "benchmark_id")


@query("J19 S16", f", {CLUSTERED} SELECT item_id, row_number() OVER (ORDER BY sha1('0:' || item_id), item_id) AS idx, min(benchmark) AS benchmark, coalesce(min(cluster), 0) AS cluster_id FROM rows_ GROUP BY 1")
def item_index(spark, d):
    one = clustered(spark, d).groupBy("item_id").agg(F.min("benchmark").alias("benchmark"), F.coalesce(F.min("cluster"), F.lit(0)).alias("cluster_id"))
    return splits.hash_rank(one, "item_id").select("item_id", F.col("hash_rank").cast("long").alias("idx"), "benchmark", "cluster_id")


@query("S22", "SELECT 'benchmark' AS kind, benchmark AS value, count(*) AS n FROM resp GROUP BY 2 UNION ALL SELECT 'condition', condition, count(*) FROM resp GROUP BY 2 UNION ALL SELECT 'subject', display_name, count(*) FROM resp GROUP BY 2")
def value_counts(spark, d):
    from functools import reduce

    df = adapter.responses(spark, d)
    return reduce(lambda a, b: a.unionByName(b), [df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "value", "n") for k, c in (("benchmark", "benchmark"), ("condition", "condition"), ("subject", "display_name"))])


@query("S23", "SELECT row_id, 'Name: ' || display_name AS card, item_content, benchmark, condition FROM resp ORDER BY row_id LIMIT 10")
def sample_rows(spark, d):
    return adapter.responses(spark, d).select("row_id", F.concat(F.lit("Name: "), "display_name").alias("card"), "item_content", "benchmark", "condition").orderBy("row_id").limit(10)


@query("S24", "SELECT DISTINCT trim(n) AS name FROM (SELECT display_name AS n FROM subj UNION SELECT unnest([lower(display_name), ' ' || organization || ' ']) FROM subj) WHERE trim(n) <> ''")
def name_roster(spark, d):
    s = adapter.subjects(spark, d).withColumn("raw", F.array(F.lower("display_name"), F.concat(F.lit(" "), "organization", F.lit(" "))))
    names = s.select(F.col("display_name").alias("n")).unionByName(s.select(F.explode_outer("raw").alias("n")))
    return names.select(F.trim("n").alias("name")).filter("name <> ''").distinct()


@query("S09 Q04 Q06", "SELECT count(*) AS n, count(DISTINCT vec_id) AS n_keys, min(len(embedding)) AS d_min, max(len(embedding)) AS d_max, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS n_bad, count(*) FILTER (list_dot_product(embedding::double[], embedding::double[]) <= 1e-12) AS n_zero FROM embeddings", log=False)
def embedding_checks(spark, d):
    return quality.embedding_checks(adapter.table(spark, d, "embeddings"), "vec_id", "embedding")


@query("Q01 Q02", f""", {KEYED} SELECT UNNEST([struct_pack(name := 'missing_subject', n := count(*) FILTER (subject_id IS NULL)), struct_pack(name := 'missing_condition', n := count(*) FILTER (test_condition IS NULL)), struct_pack(name := 'label_outside', n := count(*) FILTER (response < 0 OR response > 1)),
    struct_pack(name := 'condition_not_normalised', n := count(*) FILTER (condition IS NULL OR condition = '' OR lower(condition) IN ('nan', 'null'))), struct_pack(name := 'duplicate_rows', n := count(*) - (SELECT count(*) FROM (SELECT DISTINCT subject_id, item_key, label FROM k))),
    struct_pack(name := 'inconsistent_pairs', n := (SELECT count(*) FROM (SELECT 1 FROM k GROUP BY subject_id, item_key HAVING count(DISTINCT label) > 1)))], recursive := true) FROM k""")
def quality_checks(spark, d):
    return quality.log_checks(adapter.keyed(spark, d))


@query("J16", "SELECT item, avg(v) AS mean FROM (SELECT p_partkey AS item, CASE WHEN p_size > 10 THEN p_size END AS v FROM part UNION ALL SELECT l_partkey, avg(l_quantity) FROM lineitem GROUP BY 1) GROUP BY 1", "mean", log=False)
def outer_merge_means(spark, d):
    a = adapter.table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("a"))
    b = adapter.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.avg("l_quantity").alias("b"))
    x = a.join(b, "item", "full")
    both = F.array_compact(F.array(F.col("a").cast("double"), "b"))
    return x.select("item", F.when(F.size(both) > 0, F.aggregate(both, F.lit(0.0), lambda s, v: s + v) / F.size(both)).alias("mean"))


@query("J05 J06 U07", "SELECT row_id, coalesce(v, 0) AS judge FROM resp LEFT JOIN (SELECT p_partkey::varchar AS item_id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size / 50.0 END AS v FROM part) USING (item_id)", "judge")
def judge_features(spark, d):
    cache = adapter.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item_id"), F.when(F.col("p_size") % 4 == 0, float("nan")).otherwise(F.col("p_size") / 50.0).alias("v"))
    return adapter.responses(spark, d).join(cache, "item_id", "left").select("row_id", F.coalesce(F.nanvl("v", F.lit(0.0)), F.lit(0.0)).alias("judge"))


@query("J21 U10", "SELECT subject_id, organization, count(*) AS n, count(test_condition) AS n_conditions, (count(test_condition) = 0)::int AS missing FROM resp GROUP BY 1, 2")
def metadata_tables(spark, d):
    return adapter.responses(spark, d).groupBy("subject_id", "organization").agg(F.count("*").alias("n"), F.count("test_condition").alias("n_conditions"), (F.count("test_condition") == 0).cast("int").alias("missing"))
