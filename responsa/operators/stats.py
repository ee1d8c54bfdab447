"""Grouped statistics: pruning, dataset statistics, pass rates, shrunk means, votes, scalers."""

from __future__ import annotations

import gc
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from responsa.functions.normalize import logit, sigmoid

EPS = 1e-6


def clip(p: Column, eps: float = EPS) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def shrunk(total: Column, n: Column, fallback: Column, m: float) -> Column:
    """(total + m * fallback) / (n + m)."""
    return (total + m * fallback) / (n + m)


def prune(df: DataFrame, min_subject: int = 3, min_item: int = 1, subject: str = "subject_id", item: str = "item_id") -> DataFrame:
    """Rows of subjects with enough rows; then, of those, of items with enough rows. One pass each, not until nothing changes; rows without a key go."""
    for key, least in ((subject, min_subject), (item, min_item)):
        if least > 1:
            df = df.join(df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(key), key, "left_semi")
    return df


def dataset_stats(df: DataFrame) -> DataFrame:
    """(metric, value) rows: counts, distincts, label mean, quantiles of group sizes, duplicates, inconsistent pairs, blanks."""
    one = df.agg(
        F.count("*").cast("double").alias("n_rows"), *(F.countDistinct(c).cast("double").alias(n) for c, n in (("subject_id", "n_subjects"), ("item_key", "n_items"), ("benchmark", "n_benchmarks"), ("condition", "n_conditions"))),
        F.avg("label").alias("label_mean"), F.count_if(F.length("item_content") == 0).cast("double").alias("blank_item_content_rows"), F.count_if(F.length("display_name") == 0).cast("double").alias("blank_subject_content_rows"),
    )

    def sizes(key: str, name: str) -> DataFrame:
        n = df.groupBy(key).agg(F.count("*").alias("n"))
        return n.agg(F.avg("n").alias(f"{name}_mean"), *(F.percentile("n", F.lit(q)).alias(f"{name}_p{int(q * 100)}") for q in (0.5, 0.9, 0.99)), F.max("n").cast("double").alias(f"{name}_max"))

    copies = df.groupBy("subject_id", "item_key", "label").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("double").alias("duplicate_rows"))
    odd = df.groupBy("subject_id", "item_key").agg(F.countDistinct("label").alias("n")).agg(F.count_if(F.col("n") > 1).cast("double").alias("inconsistent_pairs"))
    wide = [one, sizes("subject_id", "rows_per_subject"), sizes("item_key", "rows_per_item"), copies, odd]
    long = [x.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in x.columns))).alias("x")).select("x.*") for x in wide]
    return reduce(DataFrame.unionByName, long)


def means(df: DataFrame, *keys: str, label: str = "label") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(label).alias("mean"), F.count("*").alias("n"))


def passrates(df: DataFrame) -> DataFrame:
    """The sparse (subject, item) table: no row where nothing was observed."""
    return df.groupBy("subject_id", "item_id").agg(F.avg("label").alias("passrate"), F.count("*").alias("n"))


def cluster_passrates(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """subject_id, cluster, passrate on the whole grid; an empty cell has the subject's mean. clusters: item_id, cluster (few clusters)."""
    rows = df.join(clusters, "item_id")
    cells = rows.groupBy("subject_id", "cluster").agg(F.avg("label").alias("cell"), F.count("*").alias("n"))
    own = df.groupBy("subject_id").agg(F.avg("label").alias("own"))
    grid = own.crossJoin(F.broadcast(clusters.select("cluster").distinct()))  # subjects x clusters is the result itself
    return grid.join(cells, ["subject_id", "cluster"], "left").select("subject_id", "cluster", F.coalesce("cell", "own").alias("passrate"), F.coalesce("n", F.lit(0)).alias("n"))


def trait_passrates(df: DataFrame, trait: str) -> DataFrame:
    return df.filter(F.col(trait).isNotNull()).groupBy(F.col(trait).alias("trait"), "item_id").agg(F.avg("label").alias("passrate"), F.count("*").alias("n"))


def item_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("item_id").agg(F.avg("label").alias("item_mean"), F.count("*").alias("n"), F.countDistinct("subject_id").alias("n_subjects"))


def stored(df: DataFrame) -> DataFrame:
    """df computed once: in the shared checkpoint folder, or kept by the executors where there is none."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        return df.persist()
    return df.checkpoint()


def release(df: DataFrame) -> None:
    """Lets Spark delete the shuffle files of tables that nothing refers to any more."""
    for _ in range(2):  # listeners hold the last query a little longer
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def mean_encoded(df: DataFrame, m: float = 30.0) -> DataFrame:
    """df (subject_id, cluster, bc, label, row_id) with the 8 interaction and the 14 marginal features, fitted on df itself.

    Marginals shrink to the global mean; cells to the cluster's, or to the benchmark-condition's, shrunk mean.
    Sums of all kinds come from one pass, added up before they are moved; rows are moved once, to
    their subject's sums, which hold its cells as maps. What clusters and conditions have is broadcast.
    """
    # a row for each kind of sum: what the key is not part of is null there, so kinds are told apart by number
    kinds = [["subject_id", "cluster"], ["subject_id", "bc"], ["cluster"], ["bc"], []]
    keys = ["subject_id", "cluster", "bc"]
    ids = [sum(1 << (2 - keys.index(c)) for c in keys if c not in kind) for kind in kinds]
    sums = df.groupingSets([[F.col(c) for c in kind] for kind in kinds], *keys).agg(F.grouping_id(*keys).cast("int").alias("kind"), F.sum("label").alias("s"), F.count("label").alias("k"))
    sums = stored(sums)  # read five times
    release(sums)  # the shuffles behind it go before the rows are moved
    of = lambda n: sums.filter(F.col("kind") == ids[n])
    g = of(4).select((F.col("s") / F.col("k")).alias("g"))

    def few(n: int, key: str) -> DataFrame:
        t = of(n).filter(F.col(key).isNotNull()).crossJoin(F.broadcast(g))
        return t.select(key, shrunk(F.col("s"), F.col("k"), F.col("g"), m).alias(f"{key}_mean"), F.log1p("k").alias(f"{key}_log1p_n"))

    cluster, bc = few(2, "cluster"), few(3, "bc")
    # a subject's cells by key, for its rows to look up; each of its rows is in one cell of its bcs, null ones too, so these add up to the subject
    cells = of(0).select("subject_id", F.struct("cluster", "s", "k").alias("c"), F.lit(None).cast(f"struct<bc:{df.schema['bc'].dataType.simpleString()},s:double,k:bigint>").alias("b"))
    cells = cells.unionByName(of(1).select("subject_id", F.lit(None).cast(cells.schema["c"].dataType).alias("c"), F.struct("bc", "s", "k").alias("b"))).filter("subject_id IS NOT NULL")
    known = lambda c, key: F.map_from_entries(F.transform(F.filter(F.collect_list(c), lambda x: x[key].isNotNull()), lambda x: F.struct(x[key], F.struct(x["s"].alias("s"), x["k"].alias("k")))))
    own = cells.groupBy("subject_id").agg(F.sum("b.s").alias("s"), F.sum("b.k").alias("k"), known("c", "cluster").alias("cs"), known("b", "bc").alias("bs"))
    rows = df.select("row_id", *keys).join(own, "subject_id", "left").join(F.broadcast(cluster), "cluster", "left").join(F.broadcast(bc), "bc", "left").crossJoin(F.broadcast(g))
    rows = rows.select("*", F.try_element_at("cs", F.col("cluster")).alias("x"), F.try_element_at("bs", F.col("bc")).alias("y"))
    g_ = F.col("g")
    subj = F.coalesce(shrunk(F.col("s"), F.col("k"), g_, m), g_)
    cm, bm = F.coalesce("cluster_mean", g_), F.coalesce("bc_mean", g_)
    scm = F.coalesce(shrunk(F.col("x.s"), F.col("x.k"), F.col("cluster_mean"), m), cm)
    sbcm = F.coalesce(shrunk(F.col("y.s"), F.col("y.k"), F.col("bc_mean"), m), bm)
    log = lambda c: F.coalesce(F.log1p(c), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "row_id", subj.alias("subj_mean"), log("k").alias("subj_log1p_n"), bm.alias("bc_mean"), zero("bc_log1p_n").alias("bc_log1p_n"), cm.alias("cluster_mean"), zero("cluster_log1p_n").alias("cluster_log1p_n"),
        sbcm.alias("sbc_mean"), log("y.k").alias("sbc_log1p_n"), scm.alias("sc_mean"), log("x.k").alias("sc_log1p_n"), (scm - subj).alias("sc_minus_subj"), (sbcm - subj).alias("sbc_minus_subj"),
        (subj - g_).alias("subj_dev"), (bm - g_).alias("bc_dev"), (cm - g_).alias("cluster_dev"), g_.alias("global_mean"),
    )


def subject_means(df: DataFrame, m: float = 30.0) -> DataFrame:
    """subject_id, subject_mean (shrunk to the global mean, clipped), obs_log1p."""
    g = df.filter(F.col("subject_id").isNotNull()).agg(F.coalesce(F.avg("label"), F.lit(0.5)).alias("g"))
    t = df.groupBy("subject_id").agg(F.sum("label").alias("s"), F.count("label").alias("k")).crossJoin(g)
    return t.select("subject_id", clip(shrunk(F.col("s"), F.col("k"), F.col("g"), m)).alias("subject_mean"), F.log1p("k").alias("obs_log1p"))


def shrinkage_baselines(train: DataFrame, rows: DataFrame, alpha: float = 20.0) -> DataFrame:
    """rows with p_global, p_subject, p_bc of train."""
    g = train.agg(clip(F.avg("label")).alias("p_global"))

    def table(key: str, name: str) -> DataFrame:
        t = train.groupBy(key).agg(F.sum("label").alias("s"), F.count("label").alias("k")).crossJoin(g)
        return t.select(key, clip(shrunk(F.col("s"), F.col("k"), F.col("p_global"), alpha)).alias(name))

    out = rows.join(table("subject_id", "p_subject"), "subject_id", "left").join(table("bc", "p_bc"), "bc", "left").crossJoin(g)
    return out.withColumns({c: F.coalesce(c, "p_global") for c in ("p_subject", "p_bc")})


def residual_table(df: DataFrame, m_marginal: float = 10.0, m_cell: float = 30.0) -> DataFrame:
    """subject_id, cluster, ls, lc, lg, residual, prediction of each observed cell: logits of shrunk marginals, and what the cell adds to them."""
    g = df.agg(clip(F.avg("label")).alias("g"))

    def marginal(key: str, name: str) -> DataFrame:
        t = df.groupBy(key).agg(F.sum("label").alias("s"), F.count("label").alias("k")).crossJoin(g)
        return t.select(key, logit(shrunk(F.col("s"), F.col("k"), F.col("g"), m_marginal)).alias(name))

    cells = df.groupBy("subject_id", "cluster").agg(F.sum("label").alias("s"), F.count("label").alias("k"))
    out = cells.join(marginal("subject_id", "ls"), "subject_id").join(marginal("cluster", "lc"), "cluster").crossJoin(g)
    out = out.withColumn("lg", logit(F.col("g"))).withColumn("base", F.col("ls") + F.col("lc") - F.col("lg"))
    out = out.withColumn("residual", logit(shrunk(F.col("s"), F.col("k"), sigmoid(F.col("base")), m_cell)) - F.col("base"))
    return out.select("subject_id", "cluster", "k", "ls", "lc", "lg", "residual", sigmoid(F.col("base") + F.col("residual")).alias("prediction"))


def cells(df: DataFrame) -> DataFrame:
    """display_name, benchmark, condition: successes, count and target of each."""
    out = df.groupBy("display_name", "benchmark", "condition").agg(F.sum("label").alias("successes"), F.count("label").alias("count"))
    return out.filter("count > 0").withColumn("target", F.col("successes") / F.col("count"))


def sample_weights(df: DataFrame, power: float = 0.5, categories: int = 15) -> DataFrame:
    """df (row_id, item, category) with weight: (1 / n_i) * (I / (15 * I_c)) ** power, divided by its mean."""
    per_item = df.groupBy("item").agg(F.count("*").alias("n_i"), F.min("category").alias("c"))
    per_category = per_item.groupBy("c").agg(F.count("*").alias("i_c"))
    total = per_item.agg(F.count("*").alias("i"))
    out = df.join(per_item.drop("c"), "item").join(F.broadcast(per_category.withColumnRenamed("c", "category")), "category").crossJoin(total)
    out = out.withColumn("raw", 1 / F.col("n_i") * F.pow(F.col("i") / (categories * F.col("i_c")), F.lit(power)))
    mean = out.agg(F.avg("raw").alias("mean"))
    return out.crossJoin(mean).withColumn("weight", F.col("raw") / F.col("mean")).drop("raw", "mean", "i", "i_c", "n_i")


def condition_profile(df: DataFrame) -> DataFrame:
    """key, n_rows, n_strings, n_values of each key of 'k=v' conditions."""
    c = df.select("condition").filter("condition <> 'none'").groupBy("condition").agg(F.count("*").alias("rows"))
    pieces = c.select("condition", "rows", F.explode(F.split("condition", r"\|")).alias("p")).filter(F.contains("p", F.lit("=")))
    kv = pieces.select("condition", "rows", F.trim(F.substring_index("p", "=", 1)).alias("key"), F.expr("substring(p, instr(p, '=') + 1)").alias("value"))
    once = kv.groupBy("key", "condition").agg(F.first("rows").alias("rows"))
    return kv.groupBy("key").agg(F.countDistinct("value").alias("n_values")).join(once.groupBy("key").agg(F.sum("rows").alias("n_rows"), F.count("*").alias("n_strings")), "key")


def condition_pairs(df: DataFrame) -> DataFrame:
    """keys (sorted, joined), n_rows: which keys occur together."""
    keys = F.transform(F.filter(F.split("condition", r"\|"), lambda p: F.contains(p, F.lit("="))), lambda p: F.trim(F.substring_index(p, "=", 1)))
    return df.filter("condition <> 'none'").groupBy(F.array_join(F.array_sort(F.array_distinct(keys)), "+").alias("keys")).agg(F.count("*").alias("n_rows"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, n_present, share of each column."""
    one = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNotNull() & (F.col(c) != "")).alias(c) for c in columns))
    return one.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("n_present")) for c in columns))).alias("x")).select("x.field", "x.n_present", (F.col("x.n_present") / F.col("n")).alias("share"))


def vote_stats(answers: DataFrame) -> DataFrame:
    """answers: item, answer ('<none>' is a refusal). Shares over what isn't refused; entropy in units of ln(valid votes)."""
    n = answers.groupBy("item").agg(F.count("*").alias("n"), F.count_if(F.col("answer") != "<none>").alias("m"))
    per = answers.filter("answer <> '<none>'").groupBy("item", "answer").agg(F.count("*").alias("k")).join(n, "item").withColumn("p", F.col("k") / F.col("m"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("k"), "answer"))
    agg = per.withColumn("r", place).groupBy("item").agg(F.max("p").alias("top"), F.max(F.when(F.col("r") == 2, F.col("p"))).alias("second"), F.sum(-F.col("p") * F.ln("p")).alias("h"), F.count("*").alias("d"))
    out = n.join(agg, "item", "left")
    return out.select(
        "item", F.coalesce("top", F.lit(0.0)).alias("self_consistency"), F.when(F.col("m") == 0, 1.0).when(F.col("m") == 1, 0.0).otherwise(F.col("h") / F.ln("m")).alias("entropy"),
        F.when(F.col("m") == 0, 0.0).otherwise(F.col("top") - F.coalesce("second", F.lit(0.0))).alias("top_gap"), F.when(F.col("m") == 0, 1.0).otherwise(F.col("d") / F.col("n")).alias("n_distinct"), (1 - F.col("m") / F.col("n")).alias("refusal_rate"),
    )


def zscores(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """key and columns, less their mean, over their population deviation (1 where that is below 1e-6)."""
    one = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns))
    return df.crossJoin(one).select(key, *(((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") < 1e-6, 1.0).otherwise(F.col(f"s_{c}"))).alias(c) for c in columns))


def numeric_scaler(df: DataFrame, column: str, log: bool = True) -> DataFrame:
    """One row: median (raw), mean and std (of log1p where asked; 1 where 0), n_missing."""
    x = F.when(~F.isnan(F.col(column)), F.col(column))
    t = F.log1p(x) if log else x
    return df.agg(F.percentile(x, F.lit(0.5)).alias("median"), F.avg(t).alias("mean"), F.when(F.stddev_pop(t) == 0, 1.0).otherwise(F.stddev_pop(t)).alias("std"), F.count_if(x.isNull()).alias("n_missing"))


def vocabulary(df: DataFrame, column: str, min_count: int = 1) -> DataFrame:
    """token, id: 0 is for missing, 1 for unknown; frequent tokens from 2 in their order. The vocabulary is the result, in one ordered task; rows are counted before."""
    kept = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("token")).agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
    return kept.select("token", (F.row_number().over(Window.orderBy("token")) + 1).cast("long").alias("id"))


def encode(df: DataFrame, column: str, vocab: DataFrame) -> DataFrame:
    """df with <column>_id: 0 for null, 1 for tokens not in vocab."""
    v = vocab.select(F.col("token").alias(column), F.col("id").alias("_id"))
    return df.join(v, column, "left").withColumn(f"{column}_id", F.when(F.col(column).isNull(), F.lit(0)).otherwise(F.coalesce("_id", F.lit(1))).cast("long")).drop("_id")


def additive_logits(df: DataFrame, key: str, parts: list[str], label: str = "label") -> DataFrame:
    """key, z: the logit of the mean label, plus what the mean of each part's group is above it; nothing for a null group."""
    g = df.agg(F.avg(label).alias("g"))
    out, z = df.select(key, *parts).crossJoin(g), F.ln(F.col("g") / (1 - F.col("g")))
    for k, part in enumerate(parts):
        own = df.filter(F.col(part).isNotNull()).groupBy(part).agg(F.avg(label).alias(f"_m{k}"))
        out, z = out.join(own, part, "left"), z + F.coalesce(F.col(f"_m{k}") - F.col("g"), F.lit(0.0))
    return out.select(key, z.alias("z"))
