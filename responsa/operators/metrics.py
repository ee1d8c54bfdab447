"""Metrics of probabilities against labels, overall and by slice, calibration tables and diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from responsa.functions.normalize import logit

#: Ranges of probabilities that are ranked apart.
CELLS = 4096


def bce(y: Column, p: Column, eps: float = 1e-7) -> Column:
    y, p = F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0)), F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def bin_of(p: Column, n: int = 10) -> Column:
    """How many inner edges i * (1/n) are at or below p; edges as numpy's linspace has them."""
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: i * F.lit(1.0 / n) <= p)).cast("long")


def auc_parts(df: DataFrame, groups: list[str], y: str, p: str, order: str, counted: DataFrame | None = None) -> DataFrame:
    """groups, auc: by ordinal ranks, ties in the order of `order`; null for soft labels or one class.

    Probabilities are cut into CELLS ranges: counts of ranges come first, and only the rows of
    one range of one group are ordered in one task. counted: the rows of df by groups and p, with n,
    how many; saves a second pass over df.
    """
    of = F.floor(F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)) * CELLS)
    cut = df.withColumn("_c", of)
    sizes = cut.groupBy(*groups, "_c").agg(F.count("*").alias("_n")) if counted is None else counted.withColumn("_c", of).groupBy(*groups, "_c").agg(F.sum("n").alias("_n"))
    before = sizes.select(*groups, "_c", (F.sum("_n").over(Window.partitionBy(*groups).orderBy("_c")) - F.col("_n")).alias("_before"))
    r = cut.join(before, [*groups, "_c"]).withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy(*groups, "_c").orderBy(p, order)))
    hit, pos = F.col(y) >= 0.5, F.count_if(F.col(y) >= 0.5)
    agg = r.groupBy(*groups).agg(
        F.sum(F.when(hit, F.col("_r"))).alias("s"), pos.cast("double").alias("np"), F.count_if(~hit).cast("double").alias("nn"), F.max(F.abs(F.col(y) - hit.cast("double"))).alias("soft"))
    auc = (F.col("s") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn"))
    return agg.select(*groups, F.when((F.col("soft") <= 1e-6) & (F.col("np") > 0) & (F.col("nn") > 0), auc).alias("auc"))


def ece_parts(df: DataFrame, groups: list[str], y: str, p: str, n: int = 10) -> DataFrame:
    """groups, ece over n equal bins."""
    bins = df.withColumn("_b", bin_of(F.col(p), n)).groupBy(*groups, "_b").agg(F.count("*").alias("k"), F.avg(p).alias("conf"), F.avg(y).alias("acc"))
    return bins.groupBy(*groups).agg((F.sum(F.abs(F.col("conf") - F.col("acc")) * F.col("k")) / F.sum("k")).alias("ece"))


def metrics(df: DataFrame, groups: list[str], y: str = "label", p: str = "p", order: str = "row_id", min_n: int = 1, n_bins: int = 10) -> DataFrame:
    """groups, n, log_loss, brier, auc, accuracy, ece of groups of min_n rows or more. No groups: one row, under group 'all'."""
    if not groups:
        return metrics(df.withColumn("group", F.lit("all")), ["group"], y, p, order, min_n, n_bins)
    agree = ((F.col(y) >= 0.5) == (F.col(p) >= 0.5)).cast("double")
    base = df.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(bce(F.col(y), F.col(p))).alias("log_loss"), F.avg(F.pow(F.col(y) - F.col(p), F.lit(2))).alias("brier"), F.avg(agree).alias("accuracy")).filter(F.col("n") >= min_n)
    return base.join(auc_parts(df, groups, y, p, order), groups).join(ece_parts(df, groups, y, p, n_bins), groups)


def calibration_table(df: DataFrame, y: str = "label", p: str = "p", n: int = 10) -> DataFrame:
    """bin, lo, hi, n, mean_pred, mean_obs, empty bins included."""
    bins = df.withColumn("bin", bin_of(F.col(p), n)).groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_pred"), F.avg(y).alias("mean_obs"))
    grid = df.sparkSession.range(n).withColumnRenamed("id", "bin")
    return grid.join(bins, "bin", "left").select("bin", (F.col("bin") * (1.0 / n)).alias("lo"), ((F.col("bin") + 1) * (1.0 / n)).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"), "mean_pred", "mean_obs")


def micro_macro(by_group: DataFrame, df: DataFrame, y: str = "label", p: str = "p") -> DataFrame:
    """One row: log-loss and Brier over rows (micro), and their means over groups, AUC over groups that have one (macro)."""
    micro = df.agg(F.avg(bce(F.col(y), F.col(p))).alias("micro_log_loss"), F.avg(F.pow(F.col(y) - F.col(p), F.lit(2))).alias("micro_brier"))
    macro = by_group.agg(F.avg("log_loss").alias("macro_log_loss"), F.avg("brier").alias("macro_brier"), F.avg("auc").alias("macro_auc"), F.count("*").alias("n_groups"))
    return micro.crossJoin(macro)


def round_score(df: DataFrame, y: str = "label", p: str = "p", labelled: str = "labelled") -> DataFrame:
    """One row: mean log-likelihood without and with labelled rows, the share labelled, labels outside [0, 1]."""
    ll = -bce(F.col(y), F.col(p))
    return df.agg(
        F.avg(F.when(~F.col(labelled), ll)).alias("score"), F.avg(ll).alias("score_all"), F.count_if(~F.col(labelled)).alias("n_scored"), F.avg(F.col(labelled).cast("double")).alias("labelled_share"),
        F.avg(((F.col(y) < 0) | (F.col(y) > 1)).cast("double")).alias("outside_share"))


def diversity(long: DataFrame, row: str = "row_id", model: str = "model", p: str = "p", y: str = "label") -> DataFrame:
    """model_i, model_j, n, pearson, mean_abs_diff, sym_kl, q, double_fault, agreement of each pair of few models. long: row, model, p, label."""
    x = long.filter(~F.isnan(F.col(p)) & F.col(p).isNotNull())
    a = x.select(row, y, F.col(model).alias("model_i"), F.col(p).alias("a"))
    b = x.select(row, F.col(model).alias("model_j"), F.col(p).alias("b"))
    both = a.join(b, row).filter("model_i <= model_j")
    ca, cb = (F.least(F.greatest(F.col(c), F.lit(1e-7)), F.lit(1 - 1e-7)) for c in ("a", "b"))
    kl = lambda u, v: u * F.ln(u / v) + (1 - u) * F.ln((1 - u) / (1 - v))
    ra, rb = ((F.col(c) >= 0.5) == (F.col(y) >= 0.5) for c in ("a", "b"))
    n = lambda c: F.count_if(c).cast("double")
    agg = both.groupBy("model_i", "model_j").agg(
        F.count("*").alias("n"), F.corr("a", "b").alias("pearson"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_diff"), F.avg((kl(ca, cb) + kl(cb, ca)) / 2).alias("sym_kl"),
        n(ra & rb).alias("n11"), n(~ra & ~rb).alias("n00"), n(ra & ~rb).alias("n10"), n(~ra & rb).alias("n01"), F.avg(((F.col("a") >= 0.5) == (F.col("b") >= 0.5)).cast("double")).alias("agreement"))
    same = F.col("model_i") == F.col("model_j")
    good, bad = F.col("n11") * F.col("n00"), F.col("n01") * F.col("n10")
    q = F.when(same, 1.0).otherwise(F.when(good + bad > 0, (good - bad) / (good + bad)).otherwise(0.0))
    return agg.select("model_i", "model_j", "n", F.when(same, 1.0).otherwise(F.col("pearson")).alias("pearson"), "mean_abs_diff", "sym_kl", q.alias("q"), (F.col("n00") / F.col("n")).alias("double_fault"), "agreement")


def ablation(by_name: DataFrame, full: str = "full") -> DataFrame:
    """name, log_loss, delta against the row named `full`."""
    base = by_name.filter(F.col("name") == full).select(F.col("log_loss").alias("base"))
    return by_name.crossJoin(base).select("name", "log_loss", (F.col("log_loss") - F.col("base")).alias("delta"))


def baselines(df: DataFrame, y: str = "label", p: str = "p") -> DataFrame:
    """name, log_loss of 0.5, the base rate and the predictions."""
    rate = df.agg(F.avg(y).alias("rate"))
    x = df.crossJoin(rate)
    one = x.agg(F.avg(bce(F.col(y), F.lit(0.5))).alias("half"), F.avg(bce(F.col(y), F.col("rate"))).alias("base_rate"), F.avg(bce(F.col(y), F.col(p))).alias("model"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("log_loss")) for c in one.columns))).alias("x")).select("x.*")


def importance(coefficients: DataFrame) -> DataFrame:
    """group, sum_abs, l2, max_abs, n of (feature, coefficient), a feature's group being what stands before '__'."""
    g = F.substring_index("feature", "__", 1)
    c = F.col("coefficient")
    return coefficients.groupBy(g.alias("group")).agg(F.sum(F.abs(c)).alias("sum_abs"), F.sqrt(F.sum(c * c)).alias("l2"), F.max(F.abs(c)).alias("max_abs"), F.count("*").alias("n"))


def label_entropy(df: DataFrame, *groups: str, y: str = "label") -> DataFrame:
    """groups, entropy of the mean label."""
    q = F.least(F.greatest(F.avg(y), F.lit(1e-12)), F.lit(1 - 1e-12))
    return df.groupBy(*groups).agg((-(q * F.ln(q) + (1 - q) * F.ln(1 - q))).alias("entropy"))


def correlations(wide: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """a, b, r: Pearson's r of each pair of columns; and which b is closest to each a."""
    one = wide.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a in left for b in right))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a in left for b in right))).alias("x")).select("x.*")


def logit_of(p: str) -> Column:
    return logit(F.col(p))
