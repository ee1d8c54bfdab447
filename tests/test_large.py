"""What failed on large tables: work that grew with rows times neighbours, and limits that stopped the whole job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from responsa.operators import calibrate, indexing, metrics, neighbors, stats
from responsa.plans import QUERIES




def tables(spark, seed=0, subjects=7, n=40, k=5):
    r = np.random.default_rng(seed)
    near = [(q, i + 1, int(x), float(s)) for q in range(n) for i, (x, s) in enumerate(zip(r.permutation([y for y in range(n) if y != q])[:k], np.sort(r.normal(size=k))[::-1], strict=True))]
    cells = [(f"s{s}", int(i), float(r.random())) for s in range(subjects) for i in r.permutation(n)[: 3 + 4 * s]]
    return spark.createDataFrame(cells, "subject_id string, item_no long, passrate double"), spark.createDataFrame(near, "query long, rank long, item long, sim double"), cells, near


def test_cells_are_looked_up_by_subject(spark):
    """F1 F3 F5 F6 F11 F12: cells are not shuffled once for each neighbour."""
    cells, near, rows, pairs = tables(spark)
    lists = neighbors.listed(near)
    got = {(r.subject_id, r.item_no): r for r in neighbors.cell_sums(cells, lists).collect()}
    rate = {(s, i): p for s, i, p in rows}
    assert len(got) == len(rows)
    for (s, i), r in got.items():
        hits = [(sim, rate[s, x]) for q, _, x, sim in pairs if q == i and (s, x) in rate]
        assert (r.n, r.k) == (len(hits), 5)
        assert np.allclose([r.sr, r.sw, r.swr], [sum(p for _, p in hits), sum(max(x, 0) for x, _ in hits), sum(max(x, 0) * p for x, p in hits)])
    ids = cells.withColumn("row_id", F.concat_ws(":", "subject_id", "item_no"))
    new = sorted(map(tuple, neighbors.cell_lookups(ids, lists).collect()))
    assert new == sorted(map(tuple, neighbors.lookups(ids, near, cells).select("row_id", "subject_id", "rank", "item", "sim", "r", "m").collect()))


@pytest.mark.parametrize("name", ["knn_member", "nn_calibrated", "neighbor_clusters"])
def test_no_join_of_cells_with_neighbours(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan


def test_probe_multiplies_blocks(spark):
    """no row for each pair of a query and an item of its cells."""
    r = np.random.default_rng(1)
    v = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(60)], "id long, v array<double>")
    centres = spark.createDataFrame([(c + 1, r.normal(size=8).tolist()) for c in range(4)], "cluster int, c array<double>")
    df = indexing.probe(v, v, centres, 5, 4)
    assert "FlatMapCoGroupsInPandas" in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, neighbors.top_k(v, v, 5).collect()))


def test_bundle_in_volumes(spark, tmp_path):
    """a bundle beyond the limit of one volume is dealt into several, whole."""
    r = np.random.default_rng(2)
    v = spark.createDataFrame([(i, r.normal(size=6).tolist()) for i in range(20)], "id long, v array<double>")
    rates = spark.range(20_000).select(F.col("id").cast("string").alias("subject_id"), F.rand(3).alias("passrate"))
    with pytest.raises(ValueError):
        indexing.export_bundle(v, v.select("id"), rates, f"{tmp_path}/one", 2, 60_000)
    sizes = indexing.export_bundle(v, v.select("id"), rates, f"{tmp_path}/more", 2, 60_000, volumes=True)
    assert sum(sizes.values()) > 60_000 and spark.read.parquet(f"{tmp_path}/more/passrates").distinct().count() == 20_000
    held = spark.read.parquet(f"{tmp_path}/more/volumes").groupBy("volume").agg(F.sum("bytes").alias("b")).collect()
    assert len(held) > 1 and all(x.b <= 60_000 for x in held)


def test_rows_of_a_round_are_kept(spark, data):
    """the log was joined again for each use of a round's rows."""
    kept = QUERIES["evaluation_round"](spark, data)._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in kept


def test_logistic_fit_on_counted_rows(spark):
    """F8: each step of each fit read the log; equal rows are counted first."""
    rows = spark.createDataFrame([(float(i % 5), float((i * 7) % 11 < 4 + i % 5)) for i in range(500)], "x double, y double")
    cells = rows.groupBy("x", "y").agg(F.count("*").alias("n"))
    (w, b), (v, c) = calibrate.irls(rows, ["x"], "y"), calibrate.irls(cells, ["x"], "y", count="n")
    assert cells.count() <= 10 and np.allclose([*w, b], [*v, c], atol=1e-9)
    one, two = (metrics.auc_parts(rows.withColumns({"g": F.lit("a"), "p": F.col("x") / 5, "k": F.monotonically_increasing_id()}), ["g"], "y", "p", "k", z).first().auc for z in (None, cells.withColumns({"g": F.lit("a"), "p": F.col("x") / 5})))
    assert one == two


def test_encoded_rows_are_moved_once(spark, data):
    """rows go to their subject's sums and are not dealt out once more for each kind of cell."""
    df = QUERIES["mean_encoded"](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(subject_id") == 2 and "hashpartitioning(cluster" not in plan and "hashpartitioning(bc" not in plan


def test_encoded_features_of_odd_rows(spark):
    """null keys fall back to the mean above them, null labels count nowhere."""
    rows = [("a", 1, "x", 1.0), ("a", 1, "y", 0.0), ("a", 2, "x", None), ("b", 2, "y", 1.0), ("b", None, "x", 0.5), (None, 1, "x", 0.0), ("a", 1, None, 1.0), ("c", 3, "z", None)]
    df = spark.createDataFrame([(*r, str(i)) for i, r in enumerate(rows)], "subject_id string, cluster int, bc string, label double, row_id string")
    got = {r.row_id: r for r in stats.mean_encoded(df, 2.0).collect()}
    shrink = lambda ls, up: (sum(ls) + 2 * up) / (len(ls) + 2)
    have = lambda f: [r[3] for r in rows if r[3] is not None and f(r)]
    g = np.mean(have(lambda r: True))
    assert len(got) == len(rows)
    for i, (s, c, b, _) in enumerate(rows):
        mean, n = {}, {}
        for name, keys, up in (("subj", {0: s}, None), ("cluster", {1: c}, None), ("bc", {2: b}, None), ("sc", {0: s, 1: c}, "cluster"), ("sbc", {0: s, 2: b}, "bc")):
            ls = have(lambda r: all(k is not None and r[j] == k for j, k in keys.items()))
            above = mean[up] if up else g
            mean[name], n[name] = (shrink(ls, above), len(ls)) if ls else (above, 0)
        r = got[str(i)]
        assert np.allclose([r[f"{k}_mean"] for k in mean] + [r[f"{k}_log1p_n"] for k in n], [*mean.values(), *np.log1p([*n.values()])]), (i, r)
        assert np.isclose(r.sc_minus_subj, mean["sc"] - mean["subj"]) and np.isclose(r.global_mean, g)
