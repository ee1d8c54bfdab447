"""Queries on splits, folds, samples, budgets, and the metrics of probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from responsa.functions import keys
from responsa.operators import calibrate, metrics, quality, splits, stats
from responsa.plans.registry import query
from responsa.plans.scalar import SHA, VARIANTS
from responsa.plans.stats import CLUSTERED, clustered
from responsa.sources import adapter

SPLIT_KEY = f"k AS (SELECT *, {SHA('benchmark', 'item_content')} AS item_split_key FROM resp)"
SIDES = "sides AS (SELECT v.*, CASE WHEN NOT val THEN 'train' WHEN subject_id IN (SELECT subject_id FROM v WHERE NOT val) THEN 'val' ELSE 'val_unseen' END AS split FROM v)"
COLD = f"""{SPLIT_KEY}, pool AS (SELECT DISTINCT item_split_key FROM k WHERE benchmark <> 'Brand#3'), chosen AS (SELECT item_split_key FROM (SELECT *, row_number() OVER (ORDER BY sha1('0:' || item_split_key), item_split_key) AS r, count(*) OVER () AS n FROM pool) WHERE r <= round_even(0.2 * n, 0)),
  v AS (SELECT *, item_split_key IN (SELECT item_split_key FROM chosen) OR item_split_key IN (SELECT item_split_key FROM k WHERE benchmark = 'Brand#3') AS val FROM k), {SIDES}"""


def cold(spark, d):
    return splits.cold_start(adapter.keyed(spark, d), 0.2, 0, ["Brand#3"])


@query("R01 R02", f", {COLD} SELECT row_id, split FROM sides")
def cold_start_split(spark, d):
    return cold(spark, d).select("row_id", "split")


@query("R02 S20", f", {COLD} SELECT split, count(*) AS n_rows, count(DISTINCT item_split_key) AS n_items, count(DISTINCT subject_id) AS n_subjects, avg(label) AS label_mean FROM sides GROUP BY 1", "label_mean")
def split_report(spark, d):
    return cold(spark, d).groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("item_split_key").alias("n_items"), F.countDistinct("subject_id").alias("n_subjects"), F.avg("label").alias("label_mean"))


@query("R03", f", v AS (SELECT *, benchmark IN ('Brand#1', 'Brand#2') AS val FROM resp), {SIDES} SELECT row_id, split FROM sides")
def heldout_split(spark, d):
    return splits.heldout(adapter.keyed(spark, d), ["Brand#1", "Brand#2"]).select("row_id", "split")


@query("R04", f", ranked AS (SELECT *, row_number() OVER (ORDER BY sha1('0:' || row_id), row_id) AS r, count(*) OVER () AS n FROM resp), v AS (SELECT *, r <= round_even(0.1 * n, 0) AS val FROM ranked), {SIDES} SELECT row_id, split FROM sides")
def random_row_split(spark, d):
    return splits.random_rows(adapter.keyed(spark, d), "row_id", 0.1).select("row_id", "split")


@query("R05 Q03", f", {COLD} SELECT (SELECT count(*) FROM (SELECT item_split_key FROM sides WHERE split = 'train' INTERSECT SELECT item_split_key FROM sides WHERE split <> 'train')) AS n_shared_keys, (SELECT count(*) FROM (SELECT subject_id FROM sides WHERE split <> 'train' EXCEPT SELECT subject_id FROM sides WHERE split = 'train')) AS n_unseen_subjects")
def leakage_check(spark, d):
    return splits.leaks(cold(spark, d))


FOLDS = f"{SPLIT_KEY}, folds AS (SELECT item_split_key, ntile(7) OVER (ORDER BY sha1('0:' || item_split_key), item_split_key) - 1 AS fold FROM (SELECT DISTINCT item_split_key FROM k))"


@query("R06", f", {FOLDS} SELECT item_split_key, fold FROM folds")
def item_folds(spark, d):
    return splits.folds(adapter.keyed(spark, d), "item_split_key", 7)


@query("R07 Q08", f", {FOLDS} SELECT (SELECT count(*) FROM (SELECT item_split_key FROM k EXCEPT SELECT item_split_key FROM folds)) AS n_missing, (SELECT count(*) FROM (SELECT item_split_key FROM folds GROUP BY 1 HAVING count(*) > 1)) AS n_twice, count(*) AS n_folds, (max(n) - min(n))::bigint AS spread FROM (SELECT count(*) AS n FROM folds GROUP BY fold)")
def fold_gates(spark, d):
    df = adapter.keyed(spark, d)
    return quality.fold_gates(splits.folds(df, "item_split_key", 7), df, "item_split_key")


@query("R08", f", {SPLIT_KEY} SELECT item_split_key FROM (SELECT *, row_number() OVER (ORDER BY sha1('3:' || item_split_key), item_split_key) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT item_split_key FROM k)) WHERE r <= greatest(round_even(0.1 * n, 0), 1)")
def early_stop_items(spark, d):
    return splits.pick(adapter.keyed(spark, d), "item_split_key", 0.1, 3)


@query("R09", "SELECT item_id, CASE WHEN row_number() OVER (ORDER BY sha1('0:' || item_id), item_id) <= count(*) OVER () // 2 THEN 'fit' ELSE 'eval' END AS side FROM (SELECT DISTINCT item_id FROM resp)")
def probe_halves(spark, d):
    return splits.half(adapter.raw(spark, d), "item_id")


@query("R10 R11")
def stratified_variants(spark, d):
    df = keys.add_item_variant_id(adapter.responses(spark, d)).withColumn("data_category", keys.data_category(F.col("item_variant_id")))
    return splits.stratified(df, "item_variant_id", "data_category", 200)


SCORE = "(item_id::bigint * 31 + subject_id::bigint * 17) % 997"


def score():
    return (F.col("item_id").cast("long") * 31 + F.col("subject_id").cast("long") * 17) % 997


@query("R12", f", {VARIANTS} SELECT data_category, row_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY data_category ORDER BY {SCORE} DESC, sha1('0:' || row_id)) AS rank FROM categories) WHERE rank <= 20")
def topk_labels(spark, d):
    df = keys.add_item_variant_id(adapter.responses(spark, d)).withColumn("data_category", keys.data_category(F.col("item_variant_id")))
    return splits.top_k(df, "data_category", score(), keys.order_hash(F.col("row_id")), 20).select("data_category", "row_id", "rank")


@query("R14", f""", {CLUSTERED}, s AS (SELECT subject_id, count(*) AS n FROM rows_ GROUP BY 1), b AS (SELECT DISTINCT bc FROM rows_ WHERE item_id::bigint % 3 = 0)
  SELECT row_id, 1000 * (((('0x' || substr(sha1('0:' || item_content), 1, 16))::UBIGINT) % 100 < 95) = (b.bc IS NULL))::int + 10 * ln(1 + n) / ln(1 + (SELECT max(n) FROM s)) AS score FROM rows_ JOIN s USING (subject_id) LEFT JOIN b USING (bc)""", "score")
def acquisition_scores(spark, d):
    df = clustered(spark, d)
    n = df.groupBy("subject_id").agg(F.count("*").alias("n"))
    known = df.filter(F.col("item_id").cast("long") % 3 == 0).select("bc").distinct().withColumn("known", F.lit(True))
    new = F.col("known").isNull()
    pool = keys.stable_bucket(F.col("item_content"), 100) < 95
    out = df.join(n, "subject_id").join(known, "bc", "left").crossJoin(n.agg(F.max("n").alias("top")))
    return out.select("row_id", (1000 * (pool == new).cast("int") + 10 * F.log1p("n") / F.log1p("top")).alias("score"))


@query("R17 N13", "SELECT item_id, n, len(list_filter(list_distinct((SELECT quantile_cont(n, [0.25, 0.5, 0.75]) FROM (SELECT count(*) AS n FROM resp WHERE trial < 4 GROUP BY item_id))), lambda c: n > c))::bigint AS bucket FROM (SELECT item_id, count(*) AS n FROM resp GROUP BY 1)")
def support_buckets(spark, d):
    df = adapter.responses(spark, d)
    count = lambda x: x.groupBy("item_id").agg(F.count("*").alias("n"))
    return splits.quantile_buckets(count(df.filter("trial < 4")), count(df), "n").select("item_id", "n", "bucket")


@query("R20 A31 N02", f""", {CLUSTERED}, p AS (SELECT DISTINCT item_id || '|' || bc AS pair FROM rows_), c AS (SELECT pair FROM (SELECT *, row_number() OVER (ORDER BY sha1('0:' || pair), pair) AS r, count(*) OVER () AS n FROM p) WHERE r <= greatest(round_even(0.3 * n, 0), 0))
  SELECT cluster, count(*) AS n, count(*) FILTER (item_id || '|' || bc IN (SELECT pair FROM c)) AS n_redacted FROM rows_ GROUP BY 1""")
def redaction_counts(spark, d):
    return splits.redaction(clustered(spark, d), 0.3).groupBy("cluster").agg(F.count("*").alias("n"), F.count_if("redacted").alias("n_redacted"))


@query("R21", "SELECT a, b, c, d FROM (SELECT unnest([1, 2, 3, 4]) AS a), (SELECT unnest(['x', 'y']) AS b), (SELECT unnest([0.1, 0.2, 0.5]::double[]) AS c), (SELECT unnest([true, false]) AS d)", log=False)
def parameter_grid(spark, d):
    one = spark.range(1).select(F.explode(F.array(*map(F.lit, [1, 2, 3, 4]))).alias("a"))
    for name, values in (("b", ["x", "y"]), ("c", [0.1, 0.2, 0.5]), ("d", [True, False])):
        one = one.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return one


@query("R22", "SELECT b.row_id, b.label, a.label AS permuted FROM (SELECT row_id, label, row_number() OVER (ORDER BY sha1('1:' || row_id), row_id) AS r FROM resp) b JOIN (SELECT label, row_number() OVER (ORDER BY sha1('0:' || row_id), row_id) AS r FROM resp) a USING (r)", "label permuted")
def permuted_labels(spark, d):
    return splits.permuted_labels(adapter.keyed(spark, d), "row_id", "label")


@query("R23", "SELECT item_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sha1('0:' || item_id)) AS r FROM (SELECT item_id, (count(*) // 10)::bigint AS bucket FROM resp GROUP BY 1)) WHERE r <= 25")
def equal_bucket_sample(spark, d):
    n = adapter.responses(spark, d).groupBy("item_id").agg(F.floor(F.count("*") / 10).alias("bucket"))
    return splits.top_k(n, "bucket", F.lit(0), keys.order_hash(F.col("item_id")), 25).select("item_id", "bucket")


# --- metrics: labels against deterministic probabilities

P = "((item_id::bigint * 37 + subject_id::bigint * 11) % 101) / 101.0"
SCORED = f"p AS (SELECT *, ({P})::double AS p, (label >= 0.5)::int::double AS y FROM resp)"
BCE = lambda y, p: f"-({y} * ln(least(greatest({p}, 1e-7), 1 - 1e-7)) + (1 - {y}) * ln(1 - least(greatest({p}, 1e-7), 1 - 1e-7)))"
BIN = "len(list_filter(range(1, 10), lambda i: i * 0.1::double <= p))"
METRICS = lambda g: f"""base AS (SELECT {g} AS g, count(*) AS n, avg({BCE('y', 'p')}) AS log_loss, avg((y - p) ** 2) AS brier, avg(((y >= 0.5) = (p >= 0.5))::int) AS accuracy FROM p GROUP BY 1),
  ranks AS (SELECT {g} AS g, y, row_number() OVER (PARTITION BY {g} ORDER BY p, row_id) AS r FROM p), aucs AS (SELECT g, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) END AS auc FROM ranks GROUP BY 1),
  eces AS (SELECT g, sum(abs(conf - acc) * n) / sum(n) AS ece FROM (SELECT {g} AS g, {BIN} AS b, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM p GROUP BY 1, 2) GROUP BY 1)"""  # noqa: E731
M = "log_loss brier auc accuracy ece"


def scored(spark, d):
    p = ((F.col("item_id").cast("long") * 37 + F.col("subject_id").cast("long") * 11) % 101) / 101.0
    return adapter.keyed(spark, d).withColumns({"p": p, "y": (F.col("label") >= 0.5).cast("double")})


@query("M01 M02 M03 M04 M05 M07", f", {SCORED}, {METRICS('benchmark')} SELECT g AS benchmark, n, log_loss, brier, auc, accuracy, ece FROM base JOIN aucs USING (g) JOIN eces USING (g) WHERE n >= 50", M)
def logloss_by_group(spark, d):
    return metrics.metrics(scored(spark, d), ["benchmark"], y="y", min_n=50)


@query("M07 M03", f", {SCORED}, {METRICS(repr('all'))} SELECT g AS \"group\", n, log_loss, brier, auc, accuracy, ece FROM base JOIN aucs USING (g) JOIN eces USING (g)", M)
def overall_metrics(spark, d):
    return metrics.metrics(scored(spark, d), [], y="y")


@query("M08 P36", f", {SCORED}, {METRICS('length(item_content) // 5')} SELECT g AS bucket, n, log_loss, brier, auc, accuracy, ece FROM base JOIN aucs USING (g) JOIN eces USING (g)", M)
def metrics_by_length(spark, d):
    return metrics.metrics(scored(spark, d).withColumn("bucket", F.floor(F.length("item_content") / 5)), ["bucket"], y="y")


@query("M06 M05", f", {SCORED} SELECT bin, bin * 0.1::double AS lo, (bin + 1) * 0.1::double AS hi, coalesce(n, 0) AS n, mean_pred, mean_obs FROM (SELECT unnest(range(10)) AS bin) LEFT JOIN (SELECT {BIN} AS bin, count(*) AS n, avg(p) AS mean_pred, avg(y) AS mean_obs FROM p GROUP BY 1) USING (bin)", "lo hi mean_pred mean_obs")
def calibration_table(spark, d):
    return metrics.calibration_table(scored(spark, d), y="y")


@query("M05", f", {SCORED}, e AS (SELECT condition AS g, {BIN} AS b, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM p GROUP BY 1, 2) SELECT g AS condition, sum(abs(conf - acc) * n) / sum(n) AS ece FROM e GROUP BY 1", "ece")
def ece_by_condition(spark, d):
    return metrics.ece_parts(scored(spark, d), ["condition"], "y", "p")


@query("M09", f", {SCORED}, {METRICS('macro_family')} SELECT (SELECT avg({BCE('y', 'p')}) FROM p) AS micro_log_loss, (SELECT avg((y - p) ** 2) FROM p) AS micro_brier, avg(log_loss) AS macro_log_loss, avg(brier) AS macro_brier, avg(auc) AS macro_auc, count(*) AS n_groups FROM base JOIN aucs USING (g)", "micro_log_loss micro_brier macro_log_loss macro_brier macro_auc")
def stratified_metrics(spark, d):
    df = scored(spark, d)
    return metrics.micro_macro(metrics.metrics(df, ["macro_family"], y="y"), df, y="y")


@query("M10", f", {SCORED} SELECT avg(-({BCE('y', 'p')})) FILTER (trial > 1) AS score, avg(-({BCE('y', 'p')})) AS score_all, count(*) FILTER (trial > 1) AS n_scored, avg((trial = 1)::int) AS labelled_share, avg((response < 0 OR response > 1)::int) AS outside_share FROM p", "score score_all labelled_share outside_share")
def round_score(spark, d):
    df = scored(spark, d).withColumn("labelled", F.col("trial") == 1)
    a = metrics.round_score(df, y="y").drop("outside_share")
    return a.crossJoin(df.agg(F.avg(((F.col("response") < 0) | (F.col("response") > 1)).cast("double")).alias("outside_share")))


MODELS = "m AS (SELECT row_id, y, unnest(['a', 'b', 'c']) AS model, unnest([p, ((item_id::bigint * 13) % 103) / 103.0, (p + 0.3) / 1.6])::double AS p FROM p)"
KL = lambda a, b: f"({a} * ln({a} / {b}) + (1 - {a}) * ln((1 - {a}) / (1 - {b})))"
CL6 = "least(greatest(p, 1e-6), 1 - 1e-6)"
CL = lambda x: f"least(greatest({x}, 1e-7), 1 - 1e-7)"


def models(spark, d):
    other, third = ((F.col("item_id").cast("long") * 13) % 103) / 103.0, (F.col("p") + 0.3) / 1.6
    one = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), c.alias("p")) for n, c in (("a", F.col("p")), ("b", other), ("c", third)))))
    return scored(spark, d).select("row_id", "y", one.alias("x")).select("row_id", "y", "x.*")


@query("M11", f""", {SCORED}, {MODELS}, j AS (SELECT x.model AS model_i, z.model AS model_j, x.p AS a, z.p AS b, (x.p >= 0.5) = (x.y >= 0.5) AS ra, (z.p >= 0.5) = (x.y >= 0.5) AS rb FROM m x JOIN m z USING (row_id) WHERE x.model <= z.model),
  c AS (SELECT model_i, model_j, count(*) AS n, corr(a, b) AS pearson, avg(abs(a - b)) AS mean_abs_diff, avg(({KL(CL('a'), CL('b'))} + {KL(CL('b'), CL('a'))}) / 2) AS sym_kl, count(*) FILTER (ra AND rb)::double AS n11, count(*) FILTER (NOT ra AND NOT rb)::double AS n00, count(*) FILTER (ra AND NOT rb)::double AS n10, count(*) FILTER (NOT ra AND rb)::double AS n01, avg(((a >= 0.5) = (b >= 0.5))::int) AS agreement FROM j GROUP BY 1, 2)
  SELECT model_i, model_j, n, CASE WHEN model_i = model_j THEN 1 ELSE pearson END AS pearson, mean_abs_diff, sym_kl, CASE WHEN model_i = model_j THEN 1 WHEN n11 * n00 + n01 * n10 > 0 THEN (n11 * n00 - n01 * n10) / (n11 * n00 + n01 * n10) ELSE 0 END AS q, n00 / n AS double_fault, agreement FROM c""", "pearson mean_abs_diff sym_kl q double_fault agreement")
def model_diversity(spark, d):
    return metrics.diversity(models(spark, d), y="y")


@query("M13 R18", f", {SCORED}, {MODELS}, l AS (SELECT model AS name, avg({BCE('y', 'p')}) AS log_loss FROM m GROUP BY 1) SELECT name, log_loss, log_loss - (SELECT log_loss FROM l WHERE name = 'a') AS delta FROM l", "log_loss delta")
def ablation_table(spark, d):
    by = models(spark, d).groupBy(F.col("model").alias("name")).agg(F.avg(metrics.bce(F.col("y"), F.col("p"))).alias("log_loss"))
    return metrics.ablation(by, "a")


@query("M16", "SELECT benchmark, -(q * ln(q) + (1 - q) * ln(1 - q)) AS entropy FROM (SELECT benchmark, least(greatest(avg(label), 1e-12), 1 - 1e-12) AS q FROM resp GROUP BY 1)", "entropy")
def prior_entropy(spark, d):
    return metrics.label_entropy(adapter.keyed(spark, d), "benchmark")


@query("M17", f", {SCORED}, r AS (SELECT avg(y) AS r FROM p) SELECT 'half' AS name, avg({BCE('y', '0.5')}) AS log_loss FROM p UNION ALL SELECT 'base_rate', avg({BCE('y', 'r')}) FROM p, r UNION ALL SELECT 'model', avg({BCE('y', 'p')}) FROM p", "log_loss")
def baseline_table(spark, d):
    return metrics.baselines(scored(spark, d), y="y")


@query("M19", "SELECT split_part(f, '__', 1) AS \"group\", sum(abs(c)) AS sum_abs, sqrt(sum(c * c)) AS l2, max(abs(c)) AS max_abs, count(*) AS n FROM (SELECT p_brand || '__' || p_partkey AS f, (p_size - 25) / 10.0 AS c FROM part) GROUP BY 1", "sum_abs l2 max_abs", log=False)
def group_importance(spark, d):
    p = adapter.table(spark, d, "part")
    return metrics.importance(p.select(F.concat_ws("__", "p_brand", "p_partkey").alias("feature"), ((F.col("p_size") - 25) / 10.0).alias("coefficient")))


@query("M21", "WITH w AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS dd, avg(l_tax) AS t, avg(l_extendedprice) AS e FROM lineitem GROUP BY l_partkey) SELECT a, b, r FROM (SELECT unnest(['q', 'q', 'dd', 'dd']) AS a, unnest(['t', 'e', 't', 'e']) AS b, unnest([corr(q, t), corr(q, e), corr(dd, t), corr(dd, e)]) AS r FROM w)", "r", log=False)
def item_correlations(spark, d):
    w = adapter.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("dd"), F.avg("l_tax").alias("t"), F.avg("l_extendedprice").alias("e"))
    return metrics.correlations(w, ["q", "dd"], ["t", "e"])


# --- calibration and blending

@query("C08 J07", f", {SCORED} SELECT row_id, ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) AS logit_p, ln(least(greatest(label, 1e-6), 1 - 1e-6) / (1 - least(greatest(label, 1e-6), 1 - 1e-6))) AS logit_label, trial::double AS trial FROM p", "logit_p logit_label trial")
def stacker_features(spark, d):
    return calibrate.stacker_features(scored(spark, d), ["p", "label"], ["trial"])


@query("C12", f""", {SCORED}, e AS (SELECT *, ((item_id::bigint * 13) % 103) / 103.0 AS b, (p + 0.3) / 1.6 AS c, exp(-((p - 0.2) ** 2) / 0.25) AS w1, exp(-((p - 0.5) ** 2) / 0.25) AS w2, exp(-((p - 0.9) ** 2) / 0.25) AS w3 FROM p)
  SELECT row_id, {CL('(CASE WHEN trial % 3 = 0 THEN 0.9 ELSE 0.05 END) * p + (CASE WHEN trial % 3 = 1 THEN 0.9 ELSE 0.05 END) * b + (CASE WHEN trial % 3 = 2 THEN 0.9 ELSE 0.05 END) * c').replace('1e-7', '1e-6')} AS categorical, {CL('(w1 * p + w2 * b + w3 * c) / (w1 + w2 + w3)').replace('1e-7', '1e-6')} AS kernel FROM e""", "categorical kernel")
def soft_routing(spark, d):
    df = scored(spark, d).withColumns({"b": ((F.col("item_id").cast("long") * 13) % 103) / 103.0, "c": (F.col("p") + 0.3) / 1.6, "bucket": F.col("trial") % 3})
    return df.select("row_id", calibrate.soft_route_categorical(df, "bucket", ["p", "b", "c"]).alias("categorical"), calibrate.soft_route_kernel(F.col("p"), [0.2, 0.5, 0.9], ["p", "b", "c"], 0.5).alias("kernel"))


@query("C16 U16", f", {SCORED} SELECT row_id, {BCE('y', 'p')} AS bce, (y - p) ** 2 AS brier, {BCE('(y * 0.9 + 0.05)', 'p')} AS smoothed, (CASE WHEN y = 1 THEN (1 - p) ** 2 ELSE p ** 2 END) * ({BCE('y', 'p')}) AS focal, 1 / (1 + exp(-(0.8 * ln({CL6}) - 1.2 * ln(1 - {CL6}) + 0.1))) AS calibrated FROM p", "bce brier smoothed focal calibrated", 5)
def objective_losses(spark, d):
    y, p = F.col("y"), F.col("p")
    b = metrics.bce(y, p)
    return scored(spark, d).select("row_id", b.alias("bce"), F.pow(y - p, F.lit(2)).alias("brier"), metrics.bce(y * 0.9 + 0.05, p).alias("smoothed"), (F.pow(F.when(y == 1, 1 - p).otherwise(p), F.lit(2)) * b).alias("focal"), calibrate.apply(p, F.lit(0.8), F.lit(1.2), F.lit(0.1)).alias("calibrated"))


@query("C01 C02 C03 C04")
def group_calibrators(spark, d):
    return calibrate.fit_groups(scored(spark, d), "benchmark", y="y")


@query("C13")
def isotonic_steps(spark, d):
    return calibrate.isotonic(scored(spark, d), "p", "y")


@query("C06 T04")
def logistic_fit(spark, d):
    df = scored(spark, d).withColumn("z", metrics.logit_of("p")).withColumn("t", F.col("trial") / 6)
    w, b = calibrate.irls(df, ["z", "t"], "y")
    return spark.createDataFrame([("z", float(w[0])), ("t", float(w[1])), ("bias", b)], "feature string, weight double")


@query("C10 L09")
def ensemble_weights(spark, d):
    df = scored(spark, d).withColumns({"b": ((F.col("item_id").cast("long") * 13) % 103) / 103.0, "c": (F.col("p") + 0.3) / 1.6})
    w = calibrate.blend_weights(df, ["p", "b", "c"], "y", steps=10)
    return spark.createDataFrame(list(zip(["p", "b", "c"], map(float, w), strict=True)), "member string, weight double")


@query("U18", f""", {CLUSTERED}, g AS (SELECT avg(label) AS g FROM rows_) SELECT row_id, ln(g / (1 - g)) + s + b AS z FROM rows_ JOIN (SELECT subject_id, avg(label) - (SELECT g FROM g) AS s FROM rows_ GROUP BY 1) USING (subject_id) JOIN (SELECT bc, avg(label) - (SELECT g FROM g) AS b FROM rows_ GROUP BY 1) USING (bc), g""", "z")
def baseline_logits(spark, d):
    return stats.additive_logits(clustered(spark, d), "row_id", ["subject_id", "bc"])


@query("A14 A07", "SELECT macro_family, sum(label) AS s, count(*) AS n, (sum(label) + 30 * (SELECT avg(label) FROM resp)) / (count(*) + 30) AS shrunk FROM resp GROUP BY 1", "s shrunk")
def shrunk_families(spark, d):
    df = adapter.keyed(spark, d)
    return df.groupBy("macro_family").agg(F.sum("label").alias("s"), F.count("*").alias("n")).crossJoin(df.agg(F.avg("label").alias("g"))).select("macro_family", "s", "n", stats.shrunk(F.col("s"), F.col("n"), F.col("g"), 30.0).alias("shrunk"))
