"""Closed forms, brute force and deliberate violations, on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from responsa.functions import categories, keys, normalize, text
from responsa.operators import calibrate, metrics, models, neighbors, networks, probes, quality, rounds, splits, stats
from responsa.sources import files


def test_conditions(spark):
    df = spark.createDataFrame([(None,), ("",), ("NaN",), ("None",), (" null",), ("a=1|b",)], "c string")
    got = [r[0] for r in df.select(normalize.condition(F.col("c"))).collect()]
    assert got == ["none", "none", "none", "none", " null", "a=1|b"]
    flags = df.select(*(c.alias(n) for n, c in normalize.condition_flags(F.col("c"), ["a"]).items())).collect()[-1].asDict()
    assert flags == {"cond_is_none": 0, "cond_has_other": 1, "cond_has_a": 1}


def test_answers_and_steps(spark):
    cases = [("so \\boxed{4.0} and \\boxed{ 7 }", "7", "number"), ("thus\nThe answer is: B.", "b", "mc"), ("x\n(C)", "c", "mc"), ("it is 12 then 13.50 apples", "13.50", "number"), ("  ", "<none>", "none"), (None, "<none>", "none"), ("no idea at all", "no idea at all", "text")]
    df = spark.createDataFrame([(t,) for t, _, _ in cases], "t string")
    a = text.normalize_answer(F.col("t"))
    for r, (_, want, kind) in zip(df.select(a.alias("a"), text.answer_type(a).alias("k")).collect(), cases, strict=True):
        assert (r.a, r.k) == (want, kind)
    steps = spark.createDataFrame([("1. a\n2) b\nStep 3: c",), ("one\n\ntwo\n\n\nthree",), ("a\nb",), ("",)], "t string")
    assert [r[0] for r in steps.select(text.step_count(F.col("t"))).collect()] == [3, 3, 1, 0]


def test_keys(spark):
    import hashlib

    row = spark.createDataFrame([("b", "é", "t")], "b string, c string, t string").select(keys.sha256_key(F.col("b"), F.col("c")).alias("k"), keys.stable_bucket(F.col("t"), 15, 3).alias("n")).first()
    assert row.k == hashlib.sha256("b\0é\0".encode()).hexdigest()
    assert row.n == int.from_bytes(hashlib.sha1(b"3:t").digest()[:8], "big") % 15


def test_folds_and_gates(spark):
    df = spark.range(53).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("b").alias("benchmark"))
    f = splits.folds(df, "k", 7)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sizes == [7, 7, 7, 8, 8, 8, 8]
    assert quality.fold_gates(f, df, "k").first().asDict() == {"n_missing": 0, "n_twice": 0, "n_folds": 7, "spread": 1}
    broken = f.filter("fold > 0").unionByName(f.filter("fold = 1").withColumn("fold", F.lit(2).cast("long")))
    g = quality.fold_gates(broken, df, "k").first()
    assert g.n_missing > 0 and g.n_twice > 0
    with pytest.raises(ValueError):
        splits.heldout(df, [])


def test_cold_start_invariants(spark):
    rows = [(f"s{i % 7}", f"i{i % 40}", f"b{i % 4}") for i in range(400)] + [("only", "i3", "b3")]
    df = spark.createDataFrame(rows, "subject_id string, item_split_key string, benchmark string")
    s = splits.cold_start(df, 0.25, 1, ["b3"]).cache()
    assert splits.leaks(s).first().n_shared_keys == 0 and s.count() == 401
    assert {r.benchmark for r in s.filter("split = 'train'").collect()} == {"b0", "b1", "b2"}
    assert [r.split for r in s.filter("subject_id = 'only'").collect()] == ["val_unseen"]
    assert sorted(map(str, s.collect())) == sorted(map(str, splits.cold_start(df, 0.25, 1, ["b3"]).collect()))


def test_allocation():
    assert splits.allocate({"a": 2, "b": 10, "c": 10}, 12) == {"a": 2, "b": 5, "c": 5}
    got = splits.allocate({"a": 5, "b": 5, "c": 5}, 7)
    assert sum(got.values()) == 7 and max(got.values()) - min(got.values()) == 1
    assert splits.allocate({"a": 1, "b": 0}, 9) == {"a": 1, "b": 0}


def test_auc_ties_go_by_row(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.5, 0.0), (3, 0.9, 1.0), (4, 0.1, 0.0)], "row_id int, p double, label double")
    assert metrics.metrics(df, []).first().auc == 0.75
    assert metrics.metrics(df.withColumn("label", F.lit(0.4)), []).first().auc is None
    assert [r.n for r in metrics.calibration_table(df).orderBy("bin").collect()] == [0, 1, 0, 0, 0, 2, 0, 0, 0, 1]


def test_top_k_is_brute_force(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(60, 5))
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {}
    for x in neighbors.top_k(df, df, 4, block=20).collect():
        got.setdefault(x.query, []).append((x.rank, x.item))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(60):
        s = np.round(u @ u[q], 9)
        best = sorted((i for i in range(60) if i != q), key=lambda i: (-s[i], i))[:4]
        assert [i for _, i in sorted(got[q])] == best


def test_neighbour_cells_without_labels(spark):
    df = spark.createDataFrame([("r", "s", k, k, 1 - k / 10, 0.0, 0) for k in (1, 2, 3)], "row_id string, subject_id string, rank int, item long, sim double, r double, m int")
    c = neighbors.nn_features(df).first()
    assert (c.top1_label, c.coverage, c.passrate_std, c.neighbor_label_entropy, c.top1_label_match) == (-1.0, 0.0, 0.0, 0.0, 0.0)
    p = neighbors.knn_member(df, spark.createDataFrame([("s", 0.7, 100)], "subject_id string, mean double, n long")).first().p
    assert p == pytest.approx(0.7)


def test_shrinkage_and_votes(spark):
    assert spark.range(1).select(stats.shrunk(F.lit(0.0), F.lit(0), F.lit(0.4), 30.0)).first()[0] == 0.4
    a = spark.createDataFrame([(1, x) for x in "aab"] + [(2, "<none>"), (3, "z"), (1, "<none>")], "item int, answer string")
    got = {r.item: r for r in stats.vote_stats(a).collect()}
    assert got[2][1:] == (0.0, 1.0, 0.0, 1.0, 1.0) and got[3].entropy == 0.0
    assert got[1].self_consistency == pytest.approx(2 / 3) and got[1].n_distinct == 0.5 and got[1].refusal_rate == 0.25
    assert got[1].entropy == pytest.approx(-(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)) / math.log(3))


def test_calibrators():
    r = np.random.default_rng(1)
    z = r.normal(size=4000)
    y = (r.uniform(size=4000) < 1 / (1 + np.exp(-(0.5 * z + 1)))).astype(float)
    p = 1 / (1 + np.exp(-z))
    a, b = calibrate.temperature(z, y)
    assert a == pytest.approx(0.5, abs=0.1) and b == pytest.approx(1, abs=0.1)
    assert np.mean(1 / (1 + np.exp(-(z + calibrate.intercept(z, y))))) == pytest.approx(y.mean(), abs=1e-6)
    assert [calibrate.best_effort(p[:n], y[:n])[0] for n in (3, 20, 40, 80)] == ["identity", "intercept", "temperature", "beta"]
    assert calibrate.best_effort(p[:40], np.ones(40))[0] == "identity"
    ta, tb, tc = calibrate.beta(p, y)
    q = 1 / (1 + np.exp(-(ta * np.log(p) - tb * np.log(1 - p) + tc)))
    assert -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q)) < -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    g, k, own = calibrate.partial_pool(np.zeros(40), np.ones(40), np.array(["a"] * 20 + ["b"] * 20), np.array([False] * 20 + [True] * 20))
    assert 0 < g <= 5 and set(own) == {"a", "b"} and own["a"] >= g - 1e-9
    assert calibrate.simplex(np.array([2.0, 0.0, -1.0])).tolist() == [1.0, 0.0, 0.0]
    assert calibrate.golden(lambda x: (x - 0.3) ** 2) == pytest.approx(0.3, abs=1e-5)


def test_logistic_fit_is_the_optimum(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 2))
    y = (r.uniform(size=300) < 1 / (1 + np.exp(-(x @ [1.0, -2.0] + 0.5)))).astype(float)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, y double")
    w, b = calibrate.irls(df, ["a", "b"], "y", l2=0.5)
    q = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (q - y) + 0.5 * w).max() < 1e-5 and abs((q - y).sum()) < 1e-5
    steps = calibrate.isotonic(df.withColumn("p", F.round((F.col("a") + 4) / 8, 2)), "p", "y").orderBy("from_p").collect()
    assert all(s.value < t.value for s, t in zip(steps, steps[1:]))


def test_trees_and_networks():
    from responsa.plans.neighbors import TREES

    x = np.array([[np.nan, 1.0], [0.5, 4.0], [0.6, 2.0]])
    assert models.walk_trees(TREES, x, 0.01).tolist() == pytest.approx([0.01 - 0.2 - 0.05, 0.01 + 0.1 + 0.25, 0.01 + 0.3 - 0.05])
    p = networks.forward(np.random.default_rng(0).normal(size=(5, 8)), networks.example(8, 4))
    assert ((p > 0) & (p < 1)).all()


def test_user_code_that_fails(spark):
    df = spark.createDataFrame([(i, "b", "none", "s", "x" * i) for i in range(1, 6)], "row_id int, benchmark string, condition string, subject_content string, item_content string")
    got = {r.row_id: r.p for r in rounds.predict(df, "row_id", lambda b, c, s, i, told: 1 / (len(i) - 3) if len(i) < 5 else "x").collect()}
    assert math.isnan(got[3]) and math.isnan(got[5]) and got[1] == -0.5
    fine = {r.row_id: r.score for r in rounds.acquire(df, "row_id", lambda b, c, s, i: len(i)).collect()}
    bad = {r.row_id: r.score for r in rounds.acquire(df, "row_id", lambda b, c, s, i: 1 / (len(i) - 3)).collect()}
    assert fine == {i: float(i) for i in range(1, 6)} and all(0 <= s < 1 for s in bad.values())


def test_bootstrap(spark):
    df = spark.createDataFrame([(str(i % 50), float(i % 50) / 50) for i in range(500)], "item string, d double")
    r = probes.bootstrap(df, "item", "d", 100).first()
    assert r.mean == pytest.approx(0.49) and r.lo < 0.49 < r.hi and r.hi - r.lo < 0.3


def test_categories(spark):
    df = spark.createDataFrame([("MMLU Pro", "integral of x"), ("hle", "poem"), ("ultrafeedback", "Привет"), ("mathvista-mini", ""), ("?", "undanced jailbreak")], "b string, t string")
    slug = categories.category(F.col("b"), F.col("t"), F.lit("id"))
    got = [r[0] for r in df.select(slug).collect()]
    assert got == ["open_ended_chat_creative_instruction", "frontier_last_exam_reasoning", "multilingual_translation", "visual_math_reasoning", "safety_refusal_adversarial_robustness"]
    assert df.select(categories.category_id(slug)).first()[0] == 0


def test_files(spark, tmp_path):
    d = str(tmp_path)
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}")
    save([("s1", "i1", "b1", 1, None, 1.0), ("s2", "i9", "b1", 1, "x=1", None)], "subject_id string, item_id string, benchmark_id string, trial long, test_condition string, response double", "b1.parquet")
    save([("s1", "i1", "b2", 2, "null", 0.5, "A")], "subject_id string, item_id string, benchmark_id string, trial long, test_condition string, response double, correct_answer string", "b2.parquet")
    save([("trace",)], "t string", "b2_traces.parquet")
    save([("s1", "Model", 7.0)], "subject_id string, display_name string, params double", "subjects.parquet")
    save([("i1", "text")], "item_id string, content string", "items.parquet")
    assert [p.rsplit("/", 1)[1] for p in files.list_response_files(spark, d)] == ["b1.parquet", "b2.parquet"]
    rows = files.load_responses(spark, d, drop_null=False).collect()
    assert len(rows) == 3 and {r.subject_content for r in rows} == {"Name: Model\nParameters: 7.0", "Name: s2"} and {r.condition for r in rows} == {"none", "x=1"}
    assert files.load_responses(spark, d).count() == 2 and files.load_responses(spark, d, ["b2"], 1).count() == 1
    files.save_state({"t": spark.range(3).toDF("k")}, f"{d}/state", 2)
    assert files.load_state(spark, f"{d}/state", ["t"], 2)["t"].count() == 3
    with pytest.raises(ValueError):
        files.load_state(spark, f"{d}/state", ["t"], 1)
    save([("a", [1.0, 2.0]), ("b", [1.0])], "k string, embedding array<double>", "vecs")
    with pytest.raises(ValueError):
        files.read_vectors(spark, f"{d}/vecs", "k")
    (tmp_path / "m.csv").write_text("name,organization,params,release_date,family,macro-family\nA,o,7,100,f,m\n")
    (tmp_path / "b.csv").write_text('benchmark,topic,age,has_conditions,conditions\nx,t,1,1,"{""k"": ""v""}"\n')
    m, b = files.load_metadata(spark, f"{d}/m.csv", f"{d}/b.csv")
    assert m.first().params == 7.0 and b.first().conditions == {"k": "v"}


def test_quantized_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, -2.54, 0.03],)], "v array<double>").withColumns(neighbors.quantize(F.col("v")))
    a, b = df.collect()
    assert list(a.q) == [0, 0] and list(b.q) == [50, -127, 2] and b.scale == pytest.approx(0.02)


def test_pca_and_ridge(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 4)) @ np.diag([5, 3, 1, 0.5]) + 2
    df = spark.createDataFrame([(i, v.tolist(), float(v[0] - v[2]), 1.0) for i, v in enumerate(x)], "id long, v array<double>, y double, w double")
    mean, basis = models.pca(df, 2)
    assert np.allclose(mean, x.mean(0)) and np.allclose(basis @ basis.T, np.eye(2), atol=1e-8) and abs(basis[0, 0]) > 0.9
    assert np.allclose(models.pca(df, 1, skip=1)[1][0], basis[1])
    w, b = models.ridge(df, "y", "w", l2=1e-6)
    assert np.allclose(w, [1, 0, -1, 0], atol=1e-4)
