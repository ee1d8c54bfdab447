"""Queries on stackers, boosted trees, indexes, member matrices, gates, policies, bundles and files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from responsa.functions import keys
from responsa.operators import calibrate, indexing, members, metrics, neighbors, splits, stackers, stats, trees
from responsa.operators import models as fitted
from responsa.plans.neighbors import CENTRES, NORM, centroids, near, vectors
from responsa.plans.registry import query
from responsa.plans.splits import BCE, SCORED, scored
from responsa.plans.stats import CLUSTERED, clustered
from responsa.sources import adapter, files


def shared(spark) -> str:
    """A new folder in the session's shared one."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp()}/responsa-{uuid.uuid4().hex}"


def blended(spark, d):
    """Labels with three members' probabilities and what stackers read."""
    df = scored(spark, d).withColumns({"b": ((F.col("item_id").cast("long") * 13) % 103) / 103.0, "c": (F.col("p") + 0.3) / 1.6})
    return df.withColumns({"lp": metrics.logit_of("p"), "lb": metrics.logit_of("b"), "t": F.col("trial") / 6.0})


# --- stackers and logistic models


@query("C07")
def oof_logistic(spark, d):
    return stackers.oof_logistic(blended(spark, d), "item_id", ["lp", "lb", "t"], "y", 3).select("row_id", "fold", "p")


@query("C09")
def bucketed_stacker(spark, d):
    df = blended(spark, d)
    s = stackers.fit_stacker(df, ["lp", "lb", "t"], "y", "macro_family")
    return df.select("row_id", s.apply(F.col("condition") != "none").alias("p"))


@query("C11")
def regime_blend(spark, d):
    df, known = blended(spark, d), F.col("condition") != "none"
    w = calibrate.two_regimes(df, known, "p", "b", "y")
    return df.select("row_id", calibrate.blend(known, "p", "b", w).alias("p"))


@query("C10")
def logit_ensemble(spark, d):
    df = blended(spark, d)
    w, b = calibrate.irls(df, ["lp", "lb"], "y", l2=1e-3)
    return df.select("row_id", calibrate.sigmoid(stackers.linear(["lp", "lb"], w, b)).alias("p"))


@query("T16")
def logistic_pipeline(spark, d):
    df = blended(spark, d).withColumn("age", F.when(F.col("trial") == 2, None).otherwise(F.col("trial").cast("double")))
    fit = stackers.logistic_pipeline(df, ["age", "lp"], ["benchmark", "condition"], "y", steps=30)
    return stackers.scored(df, "row_id", ["age", "lp"], fit)


@query("U13")
def vector_logistic(spark, d):
    v = adapter.table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("y"))
    return stackers.logistic_on_vectors(v, v, "vec_id", "embedding", "y")


@query("T03")
def boosted_scores(spark, d):
    df = blended(spark, d)
    bias, grown = trees.fit(df, ["lp", "lb", "t"], "y", trees=3, depth=2)
    return df.select("row_id", trees.scores(["lp", "lb", "t"], bias, grown).alias("raw"))


COEF = "coef AS (SELECT f AS feature, (length(f) * 7 % 11) / 11.0 - 0.5 AS weight FROM (SELECT 'benchmark=' || benchmark AS f FROM resp UNION SELECT 'condition=' || condition FROM resp) WHERE f <> 'condition=skill=urgent')"


@query("T15", f", {COEF} SELECT row_id, 1 / (1 + exp(-(0.2 + a.weight + coalesce(b.weight, 0)))) AS p FROM resp JOIN coef a ON a.feature = 'benchmark=' || benchmark LEFT JOIN coef b ON b.feature = 'condition=' || condition", "p")
def one_hot_scores(spark, d):
    df = adapter.responses(spark, d)
    f = df.select(F.explode(F.array(F.concat(F.lit("benchmark="), "benchmark"), F.concat(F.lit("condition="), "condition"))).alias("feature")).distinct().filter("feature <> 'condition=skill=urgent'")
    return stackers.one_hot_scores(df, "row_id", ["benchmark", "condition"], f.withColumn("weight", (F.length("feature") * 7 % 11) / 11.0 - 0.5), 0.2)


@query("U17", "SELECT a, b, n_values FROM (SELECT unnest(['benchmark', 'benchmark', 'condition']) AS a, unnest(['condition', 'macro_family', 'macro_family']) AS b, unnest([count(DISTINCT (benchmark, condition)), count(DISTINCT (benchmark, macro_family)), count(DISTINCT (condition, macro_family))]) AS n_values FROM resp)")
def field_crosses(spark, d):
    return stackers.field_crosses(adapter.responses(spark, d), ["benchmark", "condition", "macro_family"])


@query("U17", "SELECT a.vec_id, list_dot_product(a.embedding::double[], b.embedding::double[]) + list_dot_product(a.embedding::double[], c.embedding::double[]) + list_dot_product(b.embedding::double[], c.embedding::double[]) AS z FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 2 JOIN embeddings c ON c.vec_id = a.vec_id // 3", "z", 6, log=False)
def factorisation_scores(spark, d):
    v = vectors(spark, d)
    two, three = (v.select(F.col("id").alias(f"id{k}"), F.col("v").alias(f"v{k}")) for k in (2, 3))
    rows = v.join(two, F.floor(F.col("id") / 2) == F.col("id2")).join(three, F.floor(F.col("id") / 3) == F.col("id3"))
    return rows.select(F.col("id").alias("vec_id"), stackers.factorisation([F.transform(c, lambda x: x.cast("double")) for c in ("v", "v2", "v3")]).alias("z"))


# --- member matrix, gates, slices

MATRIX = "subject_mean log_count has_subject trial"


@query("T11 T12", f""", {CLUSTERED}, s AS (SELECT subject_id, avg(label) AS subject_mean, ln(1 + count(*)) AS log_count FROM rows_ GROUP BY 1)
  SELECT row_id, CASE WHEN hidden THEN 0 ELSE least(greatest(subject_mean, 0.05), 0.95) END AS subject_mean, CASE WHEN hidden THEN 0 ELSE least(log_count, 6) END AS log_count, CASE WHEN hidden THEN 0 ELSE 1 END AS has_subject, trial, (condition = 'none')::int::double AS "condition=none", (condition = 'skill=urgent')::int::double AS "condition=skill=urgent",
    coalesce(cluster = 1, false)::int::double AS "cluster=1", coalesce(cluster = 2, false)::int::double AS "cluster=2" FROM (SELECT *, item_id::bigint % 5 = 0 AS hidden FROM rows_) JOIN s USING (subject_id)""", MATRIX)
def member_matrix(spark, d):
    df = clustered(spark, d).withColumn("cluster", F.col("cluster").cast("string"))
    s = df.groupBy("subject_id").agg(F.avg("label").alias("subject_mean"), F.log1p(F.count("*")).alias("log_count"))
    m = members.matrix(df.join(s, "subject_id"), "row_id", ["subject_mean", "log_count"], ["trial"], {"condition": ["none", "skill=urgent"], "cluster": ["1", "2"]}, F.col("item_id").cast("long") % 5 == 0, {"subject_mean": (0.05, 0.95), "log_count": (0, 6)})
    return members.audit(m)


@query("Q07", "SELECT side, field, n_known, n_known / n AS share, n_known / n >= least AS ok FROM (SELECT unnest(['subject', 'subject', 'benchmark', 'benchmark']) AS side, unnest(['display_name', 'organization', 'benchmark', 'test_condition']) AS field, unnest([count(nullif(display_name, '')), count(nullif(organization, '')), count(nullif(benchmark, '')), count(*) FILTER (lower(trim(test_condition)) NOT IN ('', 'unknown', 'nan', 'none', 'null'))]) AS n_known, unnest([0.9, 0.9, 0.9, 0.9]) AS least, count(*) AS n FROM resp)", "share")
def metadata_coverage(spark, d):
    return members.coverage(adapter.responses(spark, d), {"subject": {"display_name": 0.9, "organization": 0.9}, "benchmark": {"benchmark": 0.9, "test_condition": 0.9}})


OOF = "f AS (SELECT *, item_id::bigint % 5 AS fold FROM resp), c AS (SELECT subject_id, fold, sum(label) AS s, count(*) AS k FROM f GROUP BY 1, 2), t AS (SELECT subject_id, sum(s) AS ts, sum(k) AS tk FROM c GROUP BY 1), ff AS (SELECT fold, sum(s) AS fs, sum(k) AS fk FROM c GROUP BY 1), means AS (SELECT subject_id, fold, CASE WHEN tk > k THEN (ts - s) / (tk - k) ELSE ((SELECT sum(fs) FROM ff) - fs) / ((SELECT sum(fk) FROM ff) - fk) END AS oof_mean FROM c JOIN t USING (subject_id) JOIN ff USING (fold))"


def folded(spark, d):
    return adapter.keyed(spark, d).withColumn("fold", F.col("item_id").cast("long") % 5)


@query("Q08", f", {OOF} SELECT subject_id, fold, oof_mean FROM means", "oof_mean")
def oof_subject_means(spark, d):
    return members.oof_means(folded(spark, d), "subject_id", "fold")


@query("R07 Q08", f""", {OOF}, nb AS (SELECT a.item_id AS query, b.item_id AS item FROM it a JOIN it b ON b.item_id::bigint = a.item_id::bigint + 1), x AS (SELECT DISTINCT item_id, fold FROM f)
  SELECT 'wrong_means' AS name, count(*) FILTER (abs(oof_mean - (SELECT avg(label) FROM f WHERE f.subject_id = means.subject_id AND f.fold <> means.fold)) > 1e-9) AS n FROM means UNION ALL SELECT 'missing', (SELECT count(*) FROM (SELECT DISTINCT subject_id, fold FROM f EXCEPT SELECT subject_id, fold FROM means)) UNION ALL SELECT 'twice', (SELECT count(*) FROM (SELECT 1 FROM means GROUP BY subject_id, fold HAVING count(*) > 1))
  UNION ALL SELECT 'items_in_two_folds', (SELECT count(*) FROM (SELECT 1 FROM x GROUP BY item_id HAVING count(*) > 1)) UNION ALL SELECT 'neighbours_in_own_fold', (SELECT count(*) FROM nb JOIN x a ON a.item_id = query JOIN x b ON b.item_id = item WHERE a.fold = b.fold)""")
def oof_gates(spark, d):
    df = folded(spark, d)
    a = adapter.items(spark, d).select(F.col("item_id").cast("long").alias("n"))
    nb = a.select((F.col("n") - 1).alias("n"), F.col("n").cast("string").alias("item")).join(a, "n").select(F.col("n").cast("string").alias("query"), "item")
    return members.oof_gates(df, members.oof_means(df, "subject_id", "fold"), nb, "subject_id", "fold", "item_id")


@query("U11", "SELECT fold, item_id, row_number() OVER (PARTITION BY fold ORDER BY sha1('0:' || item_id), item_id) - 1 AS idx FROM (SELECT DISTINCT item_id::bigint % 5 AS fold, item_id FROM resp)")
def fold_item_index(spark, d):
    return members.reindex(folded(spark, d), "fold", "item_id")


@query("R16", "SELECT doc_id, rank, (rank - 1) // 64 AS batch FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, sha1('0:' || doc_id), doc_id) AS rank FROM documents)", log=False)
def length_batches(spark, d):
    return members.length_batches(adapter.table(spark, d, "documents"), "doc_id", "n_chars", 64)


UNIT = lambda k, salt: f"(('0x' || substr(sha1('{salt}:' || {k}), 1, 8))::UBIGINT / 4294967296.0)"


@query("R15", f""", a AS (SELECT row_id, item_id, macro_family, condition <> 'none' AS new, count(*) OVER (PARTITION BY benchmark, condition) AS n_train, (subject_id::bigint % 7) / 7.0 AS anchor FROM resp), b AS (SELECT *, 10.0 * anchor + {UNIT('row_id', 'tie')} - 0.5 AS base FROM a),
  s AS (SELECT row_id, macro_family, 'novelty' AS policy, 5.0 / sqrt(1 + n_train) + base AS score FROM b UNION ALL SELECT row_id, macro_family, 'dual_pool', base FROM b WHERE ({UNIT('item_id', 'pool')} < 0.5) = new UNION ALL SELECT row_id, macro_family, 'anchor', base FROM b)
  SELECT policy, macro_family, row_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY policy, macro_family ORDER BY round(score, 9) DESC, row_id) AS rank FROM s) WHERE rank <= 10""")
def acquisition_policies(spark, d):
    df = adapter.responses(spark, d)
    n = df.groupBy("benchmark", "condition").agg(F.count("*").alias("n_train"))
    rows = df.join(n, ["benchmark", "condition"]).select("row_id", "item_id", "macro_family", "n_train", (F.col("condition") != "none").alias("new"), ((F.col("subject_id").cast("long") % 7) / 7.0).alias("anchor"))
    return members.policies(rows, "row_id", "item_id", "macro_family", 10)


GRID = [("k", [4, 8, 16, 32]), ("gate", [True, False]), ("rate", [0.001, 0.0003, 0.0001]), ("drop", [0.0, 0.1]), ("smooth", [0.0, 0.05]), ("tied", [True, False]), ("seed", [0, 1])]


@query("R21", "SELECT *, row_number() OVER (ORDER BY sha1('0:' || concat_ws('|', k, gate, round(rate * 10000)::int, round(\"drop\" * 10)::int, round(smooth * 100)::int, tied, seed))) <= 40 AS chosen FROM " + ", ".join(f"(SELECT unnest({v}{'::double[]' if isinstance(v[0], float) else ''}) AS \"{n}\")" for n, v in GRID), log=False)
def sweep_grid(spark, d):
    one = spark.range(1)
    for name, values in GRID:
        one = one.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    key = F.concat_ws("|", "k", "gate", F.round(F.col("rate") * 10000).cast("int"), F.round(F.col("drop") * 10).cast("int"), F.round(F.col("smooth") * 100).cast("int"), "tied", "seed")
    r = splits.hash_rank(one.drop("id").withColumn("_key", key), "_key")
    return r.withColumn("chosen", F.col("hash_rank") <= 40).drop("_key", "hash_rank", "total")


@query("R19", "SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY benchmark ORDER BY sha1('0:' || row_id), row_id) AS r FROM resp) WHERE r <= 40")
def capped_rows(spark, d):
    return splits.top_k(adapter.responses(spark, d), "benchmark", F.lit(0), keys.order_hash(F.col("row_id")), 40).select("row_id")


ROUTED = "r AS (SELECT *, ((item_id::bigint * 13) % 103) / 103.0 AS b, (p + 0.3) / 1.6 AS c FROM p), l AS (SELECT macro_family AS g, count(*) AS n, {0} FROM r GROUP BY 1), ch AS (SELECT *, CASE WHEN sp <= sb AND sp <= sc THEN 1 WHEN sb <= sc THEN 2 ELSE 3 END AS i FROM l), ring AS (SELECT *, coalesce(lag(i) OVER (ORDER BY g), last_value(i) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS j FROM ch)".format(", ".join(f"sum({BCE('y', m)}) AS s{m}" for m in "pbc"))


@query("M18", f", {SCORED}, {ROUTED} SELECT 'routed' AS name, sum([sp, sb, sc][i]) / sum(n) AS log_loss FROM ring UNION ALL SELECT 'scrambled', sum([sp, sb, sc][j]) / sum(n) FROM ring UNION ALL SELECT 'best_single', least(sum(sp), sum(sb), sum(sc)) / sum(n) FROM l UNION ALL SELECT 'uniform', avg({BCE('y', '((p + b + c) / 3)')}) FROM r", "log_loss")
def route_table(spark, d):
    return members.route_table(blended(spark, d), "macro_family", ["p", "b", "c"], "y")


@query("M18", f", {SCORED} SELECT macro_family, condition, count(*) AS n, avg({BCE('y', 'p')}) AS log_loss FROM p GROUP BY 1, 2", "log_loss")
def slice_losses(spark, d):
    return scored(spark, d).groupBy("macro_family", "condition").agg(F.count("*").alias("n"), F.avg(metrics.bce(F.col("y"), F.col("p"))).alias("log_loss"))


@query("M16", f", {SCORED}, l AS (SELECT avg({BCE('y', 'p')}) FILTER (item_id::bigint % 5 > 0) AS train, avg({BCE('y', 'p')}) FILTER (item_id::bigint % 5 = 0) AS val FROM p) SELECT train, val, val - train AS gap, val - train > 0.03 AS optimistic FROM l", "train val gap")
def optimism_gap(spark, d):
    return members.optimism(scored(spark, d).withColumn("split", F.when(F.col("item_id").cast("long") % 5 == 0, "val").otherwise("train")), "split", "y", "p")


@query("M12", f", {SCORED}, z AS (SELECT y, p, ((item_id::bigint * 13) % 103) / 103.0 AS b, trial / 6.0 AS t FROM p) SELECT unnest(['p', 'b', 't']) AS component, unnest([var_pop(p), var_pop(b), var_pop(t)]) AS variance, unnest([corr(p, y), corr(b, y), corr(t, y)]) AS pearson FROM z", "variance pearson")
def component_moments(spark, d):
    return members.component_moments(blended(spark, d), ["p", "b", "t"], "y")


@query("M12")
def component_decomposition(spark, d):
    """The log is read for its moments, for its cells and for the ranks. The fits read cells of equal rows: 101 values of lp, 103 of lb, a few of t."""
    names = ["lp", "lb", "t"]
    df = blended(spark, d).select("row_id", "y", *names)
    cells = df.groupBy(*names, "y").agg(F.count("*").alias("n")).persist()
    fits = {c: calibrate.irls(cells, [c], "y", count="n") for c in names}
    solo = F.explode(F.array(*(F.struct(F.lit(c).alias("component"), calibrate.sigmoid(stackers.linear([c], *fits[c])).alias("s")) for c in names))).alias("x")
    counted = cells.select("y", "n", solo).select("y", "n", "x.*")
    auc = metrics.auc_parts(df.select("row_id", "y", solo).select("row_id", "y", "x.*"), ["component"], "y", "s", "row_id", counted)
    nll = counted.groupBy("component").agg((F.sum(F.col("n") * metrics.bce(F.col("y"), F.col("s"))) / F.sum("n")).alias("solo_nll"))
    return members.component_moments(df, names, "y").join(nll.join(auc.withColumnRenamed("auc", "solo_auc"), "component"), "component")


W21 = "w AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS dd, avg(CASE WHEN l_tax > 0.02 THEN l_tax END) AS t, avg(l_extendedprice) AS e, avg(1.0) AS flat FROM lineitem GROUP BY l_partkey), m AS (SELECT q, dd, coalesce(t, (SELECT avg(t) FROM w)) AS t, e FROM w)"


@query("M21", f"WITH {W21}, r AS (SELECT unnest(['q', 'q', 'dd', 'dd']) AS proxy, unnest(['t', 'e', 't', 'e']) AS baseline, unnest([corr(q, t), corr(q, e), corr(dd, t), corr(dd, e)]) AS r FROM m) SELECT proxy, arg_max(baseline, abs(r)) AS baseline, arg_max(r, abs(r)) AS r FROM r GROUP BY 1", "r", 8, log=False)
def strongest_baselines(spark, d):
    w = adapter.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("dd"), F.avg(F.when(F.col("l_tax") > 0.02, F.col("l_tax"))).alias("t"), F.avg("l_extendedprice").alias("e"), F.avg(F.lit(1.0)).alias("flat"))
    return members.strongest(w, ["q", "dd"], ["t", "e", "flat"])


@query("A19", f""", {CLUSTERED}, i AS (SELECT item_id, count(*) AS n_i, min(cluster) AS c FROM rows_ GROUP BY 1), c AS (SELECT c, count(*) AS i_c FROM i GROUP BY 1), w AS (SELECT cluster, item_id, 1.0 / n_i * pow((SELECT count(*) FROM i) / (15.0 * i_c), 0.5) AS raw FROM rows_ JOIN i USING (item_id) JOIN c ON c.c = i.c)
  SELECT cluster, count(DISTINCT item_id) AS n_items, count(*) AS n_rows, sum(raw) / (SELECT avg(raw) FROM w) AS weight FROM w GROUP BY 1""", "weight")
def weighted_categories(spark, d):
    df = clustered(spark, d).select("row_id", F.col("item_id").alias("item"), F.col("cluster").alias("category"))
    return stats.sample_weights(df).groupBy(F.col("category").alias("cluster")).agg(F.countDistinct("item").alias("n_items"), F.count("*").alias("n_rows"), F.sum("weight").alias("weight"))


@query("A23", "SELECT conv_id, count(*) AS n, avg(length(text)) AS length_mean, stddev_pop(length(text)) AS length_std, avg((contains(text, 'boxed'))::int) AS boxed_rate, avg(len(string_split(text, chr(10)))) AS lines_mean, stddev_pop(len(string_split(text, chr(10)))) AS lines_std FROM conversations WHERE role = 'assistant' GROUP BY 1", "length_mean length_std boxed_rate lines_mean lines_std", log=False)
def sample_statistics(spark, d):
    a = adapter.table(spark, d, "conversations").filter("role = 'assistant'")
    lines = F.size(F.split("text", "\n"))
    return a.groupBy("conv_id").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("length_mean"), F.stddev_pop(F.length("text")).alias("length_std"), F.avg(F.contains("text", F.lit("boxed")).cast("int")).alias("boxed_rate"), F.avg(lines).alias("lines_mean"), F.stddev_pop(lines).alias("lines_std"))


# --- indexes, components, bundles, files

UNITV = f"list_transform(embedding, lambda x: x::double / {NORM.format('embeddings')})"
CELL = f"ce AS (SELECT vec_id, cluster, row_number() OVER (PARTITION BY vec_id ORDER BY d2, cluster) AS r FROM (SELECT vec_id, cluster, greatest(round(list_sum(list_transform(list_zip({UNITV}, c), lambda x: (x[1] - x[2]) ** 2)), 9), 0) AS d2 FROM embeddings, cen))"


@query("J12", f"WITH {CENTRES}, {CELL}, s AS (SELECT a.vec_id AS query, b.vec_id AS item, round(list_dot_product(a.u, b.u), 9) AS sim FROM (SELECT vec_id, {UNITV} AS u FROM embeddings) a JOIN ce x ON x.vec_id = a.vec_id AND x.r <= 3 JOIN ce y ON y.cluster = x.cluster AND y.r = 1 JOIN (SELECT vec_id, {UNITV} AS u FROM embeddings) b ON b.vec_id = y.vec_id WHERE a.vec_id <> b.vec_id) SELECT query, rank, item, sim FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) AS rank FROM s) WHERE rank <= 10", "sim", 7, log=False)
def probed_neighbors(spark, d):
    v = vectors(spark, d)
    return indexing.probe(v, v, centroids(spark, d), 10, 3)


@query("L02")
def randomised_components(spark, d):
    v = vectors(spark, d)
    mean, basis = indexing.randomised_pca(v, 4)
    return v.select("id", fitted.project(F.col("v"), basis, mean).alias("z"))


@query("L01 L03")
def tail_components(spark, d):
    """Components after the first 32, projected without recentring."""
    v = vectors(spark, d)
    return v.select("id", fitted.project(F.col("v"), fitted.pca(v, 16, 32)[1]).alias("z"))


@query("S14", "SELECT false AS first_reused, true AS second_reused, false AS other_reused, count(*) AS n_same FROM embeddings", log=False)
def reused_clusters(spark, d):
    v, path = vectors(spark, d), shared(spark)
    _, a, one = indexing.clusters(v, path, 4)
    _, b, two = indexing.clusters(v, path, 4)
    three = indexing.clusters(v, f"{path}-other", 3)[2]
    return a.join(b, ["id", "cluster"]).agg(F.count("*").alias("n_same")).select(F.lit(one).alias("first_reused"), F.lit(two).alias("second_reused"), F.lit(three).alias("other_reused"), "n_same")


@query("S15", f", {CLUSTERED} SELECT 'items' AS part, (SELECT count(*) FROM embeddings) AS n UNION ALL SELECT 'basis', 9 UNION ALL SELECT 'registry', (SELECT count(DISTINCT item_id) FROM rows_) UNION ALL SELECT 'passrates', (SELECT count(*) FROM (SELECT DISTINCT subject_id, item_id FROM resp))")
def item_bundle(spark, d):
    path, df = shared(spark), clustered(spark, d)
    registry = df.groupBy("item_id").agg(F.min("benchmark").alias("benchmark"), F.coalesce(F.min("cluster"), F.lit(0)).alias("cluster_id"))
    names = list(indexing.export_bundle(vectors(spark, d), registry, stats.passrates(adapter.keyed(spark, d)), path, 8, 70_000_000, volumes=True))
    out = None
    for n in names:
        one = spark.read.parquet(f"{path}/{n}").agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("J17 S07 S08 S09", "SELECT item_id, row, list_sum(list_transform(embedding, lambda x: x::double)) AS total FROM (SELECT p_partkey::varchar AS item_id, p_partkey % (SELECT count(*) FROM embeddings) AS row FROM part) JOIN embeddings ON vec_id = row", "total", 6, log=False)
def indexed_vectors(spark, d):
    """Vectors written and read back once each, and a map from items to them; no vector is stored twice."""
    path, v = f"{shared(spark)}/vectors", adapter.table(spark, d, "embeddings")
    files.write_vectors(v.select(F.col("vec_id").cast("string").alias("key"), "embedding"), path)
    n = v.agg(F.count("*").alias("n"))
    rows = adapter.table(spark, d, "part").crossJoin(n).select(F.col("p_partkey").cast("string").alias("item_id"), (F.col("p_partkey") % F.col("n")).alias("row"))
    back = files.read_vectors(spark, path, "key").select(F.col("key").cast("long").alias("row"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"))
    return rows.join(back, "row").select("item_id", "row", "total")


@query("S01 S02 S04 S05 S06 U01", "SELECT subject_id, item_id, benchmark, condition, 'Name: ' || display_name AS subject_content, item_content, response AS label, trial FROM resp", "label")
def loaded_log(spark, d):
    """The log written as one file of responses for each of a few benchmarks' groups, with registries, and loaded from there."""
    path, raw, s, i = shared(spark), adapter.raw(spark, d), adapter.subjects(spark, d), adapter.items(spark, d)
    log = raw.join(i, "item_id").select("subject_id", "item_id", F.col("benchmark").alias("benchmark_id"), F.col("trial").cast("long").alias("trial"), "test_condition", "response")
    for k in range(3):
        log.filter(F.pmod(F.crc32(F.col("benchmark_id").cast("binary")), F.lit(3)) == k).write.parquet(f"{path}/group{k}.parquet")
    s.select("subject_id", "display_name").write.parquet(f"{path}/subjects.parquet")
    i.select("item_id", F.col("item_content").alias("content")).write.parquet(f"{path}/items.parquet")
    i.select(F.col("benchmark").alias("benchmark_id")).distinct().write.parquet(f"{path}/benchmarks.parquet")
    return files.load_responses(spark, path).select("subject_id", "item_id", "benchmark", "condition", "subject_content", "item_content", "label", "trial")


@query("S13 S17", "SELECT item_id, avg(label) AS passrate, count(*) AS n FROM resp GROUP BY 1", "passrate")
def stored_state(spark, d):
    path = shared(spark)
    files.save_state({"rates": adapter.keyed(spark, d).groupBy("item_id").agg(F.avg("label").alias("passrate"), F.count("*").alias("n"))}, path, 3)
    return files.load_state(spark, path, ["rates"], 3)["rates"]


@query("N06")
def stored_neighbours(spark, d):
    """A neighbour member's fit: components, int8 values with scales, and neighbours of what they decode to."""
    v = vectors(spark, d)
    mean, basis = fitted.pca(v, 16)
    q = v.select("id", fitted.project(F.col("v"), basis, mean).alias("z")).withColumns(neighbors.quantize(F.col("z")))
    back = q.select("id", F.transform("q", lambda x: x * F.col("scale")).alias("v"))
    return neighbors.top_k(back, back, 8)
