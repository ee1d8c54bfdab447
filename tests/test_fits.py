"""Queries that SQL cannot express, against plain loops and numpy over the same rows."""

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from responsa.operators import calibrate, indexing, members, models, neighbors, networks, probes, splits, stackers, trees
from responsa.plans import ORACLES, QUERIES, extra
from responsa.plans.neighbors import vectors
from responsa.sources import adapter

DONE = set()


def run(name, spark, data):
    DONE.add(name)
    return QUERIES[name](spark, data).toPandas()


def sig(z):
    return 1 / (1 + np.exp(-np.asarray(z, float)))


def newton(x, y, l2=1.0, offset=0.0, steps=60):
    """Weights and bias of an L2-penalised logistic fit, the bias free."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    pen = np.diag([l2] * (x.shape[1] - 1) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        q = sig(x @ w + offset)
        w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + pen + 1e-9 * np.eye(len(w)), x.T @ (q - y) + pen @ w)
    return w[:-1], w[-1]


def loss(y, p, eps=1e-7):
    p = np.clip(p, eps, 1 - eps)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


@pytest.fixture(scope="module")
def rows(spark, data):
    """The log with its members' probabilities, on the driver."""
    return extra.blended(spark, data).select("row_id", "item_id", "benchmark", "condition", "macro_family", "trial", "p", "b", "c", "lp", "lb", "t", "y", "label").toPandas().set_index("row_id").sort_index()


@pytest.fixture(scope="module")
def vecs(spark, data):
    v = vectors(spark, data).orderBy("id").toPandas()
    return v.id.to_numpy(), np.stack(v.v.to_list()).astype(float)


def test_group_calibrators(spark, data, rows):
    got = run("group_calibrators", spark, data).set_index("benchmark")
    assert set(got.index) == set(rows.benchmark)
    for g, x in rows.groupby("benchmark"):
        kind, a, b, c = calibrate.best_effort(x.p.to_numpy(), x.y.to_numpy())
        p = np.clip(x.p.to_numpy(), 1e-6, 1 - 1e-6)
        ours, theirs = (sig(u.a * np.log(p) - u.b * np.log(1 - p) + u.c) if hasattr(u, "a") else sig(u[1] * np.log(p) - u[2] * np.log(1 - p) + u[3]) for u in (got.loc[g], (kind, a, b, c)))
        assert got.loc[g].kind == kind and loss(x.y.to_numpy(), ours).mean() <= loss(x.y.to_numpy(), theirs).mean() + 1e-4


def test_small_and_odd_groups(spark):
    r = np.random.default_rng(0)
    data = [(g, float(p), float(r.random() < p)) for g, n in (("a", 3), ("b", 12), ("c", 45), ("d", 300)) for p in r.uniform(0.05, 0.95, n)] + [("e", float("nan"), 1.0), ("e", 0.5, 0.0)] + [("f", 0.3, 1.0)] * 80 + [(None, 0.5, 1.0)]
    got = {x.g: x for x in calibrate.fit_groups(spark.createDataFrame(data, "g string, p double, label double"), "g").collect()}
    assert {g: x.kind for g, x in got.items()} == {"a": "identity", "b": "intercept", "c": "temperature", "d": "beta", "e": "identity", "f": "identity"}


def test_isotonic_steps(spark, data, rows):
    got = run("isotonic_steps", spark, data).sort_values("from_p")
    blocks = []
    for p, x in rows.groupby("p").y:
        blocks.append([p, x.sum(), len(x)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, s, n = blocks.pop()
            blocks[-1][1] += s
            blocks[-1][2] += n
    assert np.allclose(got.to_numpy(), [(p, s / n) for p, s, n in blocks])


def test_isotonic_on_close_probabilities(spark):
    r = np.random.default_rng(1)
    p = np.sort(r.random(400))
    y = (r.random(400) < p).astype(float)
    got = calibrate.isotonic(spark.createDataFrame(pd.DataFrame({"p": p / 1e4, "y": y})), "p", "y").toPandas().sort_values("from_p")
    assert (np.diff(got.value) > 0).all() and np.isin(got.from_p, p / 1e4).all()
    at = np.searchsorted(got.from_p.to_numpy(), p / 1e4, side="right") - 1
    for k in range(len(got)):
        assert abs(got.value.iloc[k] - y[at == k].mean()) < 1e-12


def test_logistic_fit(spark, data, rows):
    got = run("logistic_fit", spark, data).set_index("feature").weight
    w, b = newton(rows[["lp", "t"]].to_numpy(), rows.y.to_numpy())
    assert np.allclose([got["z"], got["t"], got["bias"]], [*w, b], atol=1e-5)


def test_ensemble_weights(spark, data, rows):
    w = run("ensemble_weights", spark, data).set_index("member").weight
    p, y = rows[["p", "b", "c"]].to_numpy(), rows.y.to_numpy()
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
    assert loss(y, p @ w[["p", "b", "c"]].to_numpy()).mean() < loss(y, p.mean(axis=1)).mean()


def test_logit_ensemble(spark, data, rows):
    got = run("logit_ensemble", spark, data).set_index("row_id").p
    w, b = newton(rows[["lp", "lb"]].to_numpy(), rows.y.to_numpy(), 1e-3)
    assert np.abs(got[rows.index] - sig(rows[["lp", "lb"]].to_numpy() @ w + b)).max() < 1e-6


def test_regime_blend(spark, data, rows):
    got = run("regime_blend", spark, data).set_index("row_id").p[rows.index]
    for known in (True, False):
        x = rows[(rows.condition != "none") == known]
        mix = lambda w, x=x: loss(x.y, w * x.p + (1 - w) * x.b, 1e-6).mean()
        assert loss(x.y, got[x.index], 1e-6).mean() <= min(mix(w) for w in np.linspace(0, 1, 1001)) + 1e-6
    assert calibrate.two_regimes(spark.createDataFrame([], "p double, b double, y double"), F.col("p") > 0, "p", "b", "y") == (0.5, 0.5)


def test_oof_logistic(spark, data, rows):
    got = run("oof_logistic", spark, data).set_index("row_id").loc[rows.index]
    fold = rows.item_id.map(splits.folds(adapter.raw(spark, data), "item_id", 3).toPandas().set_index("item_id").fold)
    assert (fold == got.fold).all()
    x = rows[["lp", "lb", "t"]].to_numpy()
    for k in range(3):
        w, b = newton(x[fold != k], rows.y.to_numpy()[fold != k])
        assert np.abs(got.p[fold == k] - sig(x[fold == k] @ w + b)).max() < 1e-6


def test_bucketed_stacker(spark, data, rows):
    got = run("bucketed_stacker", spark, data).set_index("row_id").p[rows.index]
    x, y = rows[["lp", "lb", "t"]].to_numpy(), rows.y.to_numpy()
    common, own = newton(x, y), {g: newton(x[m], y[m]) for g in set(rows.macro_family) for m in [(rows.macro_family == g).to_numpy()]}
    want = [sig(v @ w + b) for v, g, c in zip(x, rows.macro_family, rows.condition, strict=True) for w, b in [own[g] if c != "none" else common]]
    assert np.abs(got.to_numpy() - want).max() < 1e-6


def test_logistic_pipeline(spark, data, rows):
    got = run("logistic_pipeline", spark, data).set_index("row_id").p[rows.index]
    age = rows.trial.where(rows.trial != 2).astype(float)
    num = np.stack([age.fillna(age.mean()), rows.lp], axis=1)
    num = (num - num.mean(axis=0)) / num.std(axis=0, ddof=1)
    hot = np.concatenate([np.stack([rows[c] == v for v in sorted(set(rows[c]))], axis=1) for c in ("benchmark", "condition")], axis=1).astype(float)
    y = rows.y.to_numpy()
    weight = np.where(y > 0, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum())
    x = np.concatenate([num, hot], axis=1)
    z = np.log(got / (1 - got)).to_numpy()
    # the penalised loss is convex: no better weights near those that explain the scores
    full = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.linalg.lstsq(full, z, rcond=None)[0]
    assert np.abs(full @ w - z).max() < 1e-6
    g = x.T @ (weight * (sig(z) - y))
    w0, b0 = np.zeros(x.shape[1]), 0.0
    for _ in range(60):
        q = sig(x @ w0 + b0)
        xx = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        h = (xx * (weight * q * (1 - q))[:, None]).T @ xx + np.diag([1.0] * len(w0) + [1e-9])
        s = np.linalg.solve(h, xx.T @ (weight * (q - y)) + np.append(w0, 0))
        w0, b0 = w0 - s[:-1], b0 - s[-1]
    assert np.abs(sig(x @ w0 + b0) - got.to_numpy()).max() < 2e-3 and np.isfinite(g).all()


def test_vector_logistic(spark, data, vecs):
    got = run("vector_logistic", spark, data).set_index("vec_id").p
    ids, x = vecs
    y = spark.read.parquet(f"{data}/embeddings.parquet").toPandas().set_index("vec_id").label[ids].to_numpy() < 5
    w, b = newton(x, y.astype(float))
    assert np.abs(got[ids].to_numpy() - sig(x @ w + b)).max() < 2e-3
    df = spark.createDataFrame([(i, [float(i), 1.0], 1) for i in range(5)], "k long, v array<double>, y int")
    assert {r.p for r in stackers.logistic_on_vectors(df, df, "k", "v", "y").collect()} == {1.0}


def test_boosted_scores(spark, data, rows):
    got = run("boosted_scores", spark, data).set_index("row_id").raw[rows.index]
    base = np.log(rows.y.mean() / (1 - rows.y.mean()))
    assert loss(rows.y, sig(got)).mean() < loss(rows.y, np.full(len(rows), sig(base))).mean()


def test_boosting_finds_the_best_splits(spark):
    """One tree of depth 2, against all splits at all edges, missing values on either side."""
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 2)).round(1)
    x[r.random((300, 2)) < 0.15] = np.nan
    y = ((np.nan_to_num(x[:, 0], nan=1) > 0.2) ^ (np.nan_to_num(x[:, 1], nan=-2) > 0)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    edges = trees.edges_of(df, ["a", "b"], 8)
    bias, grown = trees.fit(df, ["a", "b"], "y", trees=2, depth=2, rate=0.5, bins=8)

    def best(idx, z, depth):
        q = sig(z[idx])
        g, h = q - y[idx], q * (1 - q)
        top, pick = 1e-9, None
        if depth:
            for f in range(2):
                for e in edges[f]:
                    for d in (True, False):
                        v = x[idx, f]
                        left = np.where(np.isnan(v), d, v <= e)
                        if min(h[left].sum(), h[~left].sum()) < 1:
                            continue
                        won = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
                        if won > top + 1e-9:
                            top, pick = won, left
        if pick is None:
            z[idx] += -0.5 * g.sum() / (h.sum() + 1)
            return
        # both sides are grown before any score moves
        best(idx[pick], z, depth - 1)
        best(idx[~pick], z, depth - 1)

    z = np.full(300, bias)
    for _ in range(2):
        best(np.arange(300), z, 2)
    got = models.walk_trees(grown, x, bias)
    assert abs(loss(y, sig(got)).mean() - loss(y, sig(z)).mean()) < 5e-3
    ours = df.select(trees.scores(["a", "b"], bias, grown).alias("z")).toPandas().z.to_numpy()
    assert np.allclose(sorted(ours), sorted(got))


def test_component_decomposition(spark, data, rows):
    got = run("component_decomposition", spark, data).set_index("component")
    for c in ("lp", "lb", "t"):
        w, b = newton(rows[[c]].to_numpy(), rows.y.to_numpy())
        s = pd.Series(sig(rows[c] * w[0] + b), index=rows.index)
        assert abs(got.solo_nll[c] - loss(rows.y, s).mean()) < 1e-6 and abs(got.variance[c] - rows[c].var(ddof=0)) < 1e-9 and abs(got.pearson[c] - rows[c].corr(rows.y)) < 1e-9
        rank = s.reset_index().sort_values([s.name or 0, "row_id"]).reset_index(drop=True)
        n1, n0 = rows.y.sum(), (1 - rows.y).sum()
        place = {r: k + 1 for k, r in enumerate(rank.row_id)}
        auc = (sum(place[r] for r in rows.index[rows.y == 1]) - n1 * (n1 + 1) / 2) / n1 / n0
        assert abs(got.solo_auc[c] - auc) < 1e-3


def test_kmeans(spark, data, vecs):
    got = run("kmeans_clusters", spark, data).set_index("id").cluster
    ids, x = vecs
    label = got[ids].to_numpy()
    centres = np.stack([x[label == k].mean(axis=0) for k in sorted(set(label))])
    near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert len(set(label)) == 8 and (np.array(sorted(set(label)))[near] == label).mean() > 0.9


def components(x, k, skip=0):
    return np.linalg.eigh(np.cov(x.T, bias=True))[1][:, ::-1][:, skip : skip + k].T


@pytest.mark.parametrize(("name", "k", "skip", "centred"), [("pca_coordinates", 4, 0, True), ("tail_components", 16, 32, False)])
def test_components(spark, data, vecs, name, k, skip, centred):
    got = run(name, spark, data).set_index("id").z
    ids, x = vecs
    z = np.stack(got[ids].to_list())
    want = (x - x.mean(axis=0) * centred) @ components(x, k, skip).T
    assert np.abs(np.abs(z) - np.abs(want)).max() < 1e-6


def test_randomised_components(spark, data, vecs):
    got = np.stack(run("randomised_components", spark, data).set_index("id").z[vecs[0]].to_list())
    x = vecs[1] - vecs[1].mean(axis=0)
    exact = (x @ components(vecs[1], 4).T).var(axis=0)
    assert got.var(axis=0).sum() > 0.85 * exact.sum()
    _, basis = indexing.randomised_pca(vectors(spark, data), 60)  # nearly all of them: exact
    assert np.abs((x @ basis.T).var(axis=0)[:4] - exact).max() < 1e-6


def test_stored_neighbours(spark, data, vecs):
    got = run("stored_neighbours", spark, data)
    ids, x = vecs
    z = (x - x.mean(axis=0)) @ components(x, 16).T
    z = np.round(z / np.abs(z).max(axis=1, keepdims=True) * 127)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    sims = z @ z.T
    np.fill_diagonal(sims, -2)
    at = {i: k for k, i in enumerate(ids)}
    for r in got[got["rank"] == 1].itertuples():
        assert abs(r.sim - sims[at[r.query]].max()) < 2e-2
    assert (got.groupby("query").size() == 8).all()


def test_difficulty_projection(spark, data, vecs):
    got = run("difficulty_projection", spark, data).sort_values("i").weight.to_numpy()
    ids, v = vecs
    x, w = np.concatenate([v, np.ones((len(v), 1))], axis=1), np.sqrt(ids % 5 + 1.0)
    h = (x * w[:, None]).T @ x + np.diag([1.0] * v.shape[1] + [1e-9])
    assert np.allclose(got, np.linalg.solve(h, (x * w[:, None]).T @ (ids % 10 / 10)), atol=1e-8)


def test_pooled_calibration(spark, data, rows):
    got = run("pooled_calibration", spark, data).set_index("row_id").calibrated[rows.index]
    bc, new = (rows.benchmark + "::" + rows.condition).to_numpy(str), (rows.condition == "none").to_numpy()
    z = np.log(np.clip(rows.p, 1e-6, 1 - 1e-6) / (1 - np.clip(rows.p, 1e-6, 1 - 1e-6))).to_numpy()
    _, _, own = calibrate.partial_pool(z, rows.y.to_numpy(), bc, new)
    assert np.abs(got.to_numpy() - sig(z + np.array([own[k] for k in bc]))).max() < 1e-6


def test_incremental_probe(spark, data, rows):
    got = run("incremental_probe", spark, data).iloc[0]
    side = splits.half(adapter.raw(spark, data), "item_id").toPandas().set_index("item_id").side
    fit = (rows.item_id.map(side) == "fit").to_numpy()
    z, t, y = rows.lp.to_numpy(), rows.t.to_numpy()[:, None], rows.y.to_numpy()
    w, b = newton(t[fit], y[fit], offset=z[fit])
    _, b0 = newton(np.zeros((fit.sum(), 0)), y[fit], offset=z[fit])
    delta = loss(y[~fit], sig(z[~fit] + b0)) - loss(y[~fit], sig(z[~fit] + b + t[~fit] @ w))
    assert abs(got["mean"] - delta.mean()) < 1e-6 and got.lo <= got["mean"] <= got.hi


def test_stratified_variants(spark, data):
    got = run("stratified_variants", spark, data)
    n = Counter(got.data_category)
    assert got.item_variant_id.is_unique and len(got) == 200
    from responsa.functions import keys

    df = keys.add_item_variant_id(adapter.responses(spark, data)).withColumn("c", keys.data_category(F.col("item_variant_id"))).select("item_variant_id", "c").distinct().toPandas()
    assert dict(n) == {c: k for c, k in splits.allocate(dict(Counter(df.c)), 200).items() if k}
    first = {c: sorted(x.item_variant_id, key=lambda v: hashlib.sha1(f"0:{v}".encode()).hexdigest())[: n[c]] for c, x in df.groupby("c")}
    assert all(set(got[got.data_category == c].item_variant_id) == set(v) for c, v in first.items())


def test_evaluation_round(spark, data):
    got = run("evaluation_round", spark, data).iloc[0]
    assert got.n_scored > 0 and 0 < got.labelled_share < 1 and got.score < 0 and got.outside_share == 0


def test_normalised_answers(spark, data):
    got = run("normalised_answers", spark, data)
    n = spark.read.parquet(f"{data}/conversations.parquet").filter("role = 'assistant'").toPandas().set_index(["conv_id", "turn"]).text
    assert len(got) == len(n)
    for r in got.itertuples():
        t = n[r.conv_id, r.turn]
        lines = [x for x in t.strip().split("\n") if x.strip()]
        assert r.answer and r.kind in ("none", "number", "mc", "text") and r.steps >= 0
        if "answer" not in t.lower() and "boxed" not in t and not any(c.isdigit() for c in t) and len(lines[-1].strip()) > 3:
            assert r.answer == " ".join(lines[-1].lower().split()).strip(" .,:;$\\")


def test_exact_pools(spark, data):
    got = run("exact_pools", spark, data).set_index("item_id")
    for r in adapter.items(spark, data).collect():
        x = int.from_bytes(hashlib.blake2b(r.item_content.encode(), digest_size=8).digest(), "little") / 2.0**64
        assert got.in_new_pool[r.item_id] == (x < 0.95) and math.isclose(got.tiebreak[r.item_id], x - 0.5)


def test_random_unit_vectors(spark, data):
    got = run("random_unit_vectors", spark, data).set_index("item_id").v
    v = np.stack(got.to_list())
    assert np.allclose(np.linalg.norm(v, axis=1), 1) and abs(v.mean()) < 0.02 and len({tuple(x) for x in v.round(6)}) == len(v)
    r = np.random.default_rng(list(hashlib.sha256(b"1").digest()[:8])).normal(size=16)
    assert np.allclose(got["1"], r / np.linalg.norm(r))


def test_network_scores(spark, data, vecs):
    got = run("network_scores", spark, data).set_index("id").p
    assert np.allclose(got[vecs[0]], networks.forward(vecs[1], networks.example(64, 8)))


def test_nearest_on_axis_across_ranges(spark):
    r = np.random.default_rng(2)
    points = [(i, float(x)) for i, x in enumerate(np.concatenate([r.normal(size=400).round(2), np.full(200, 0.5)]))]
    asked = [(f"q{i}", float(x)) for i, x in enumerate(r.normal(size=60).round(2))] + [("far", 99.0), ("null", None)]
    got = neighbors.nearest_on_axis(spark.createDataFrame(asked, "query string, x double"), spark.createDataFrame(points, "item long, d double"), 6, size=50).toPandas()
    for q, x in asked[:-1]:
        want = [i for _, _, i in sorted((round(abs(d - x), 9), -d, i) for i, d in points)[:6]]
        assert got[got["query"] == q].sort_values("rank")["item"].to_list() == want
    assert "null" not in set(got["query"])


def test_context_features_are_redacted(spark):
    base = [("r", "s", k + 1, k, 0.9 - k / 10, 0.5, 1, f, "m", "o", b, a, c) for k in range(2) for f, b, a, c in [(None, None, None, None)]]
    looked = spark.createDataFrame(base, "row_id string, subject_id string, rank int, item long, sim double, r double, m int, family string, macro_family string, organization string, benchmark string, age double, cluster_rate double")
    rates = {t: spark.createDataFrame([("m", 0, 0.25), ("m", 1, 0.75), ("o", 1, 1.0)], "trait string, item_no long, passrate double") for t in neighbors.TRAITS}
    items = spark.createDataFrame([(0, "b", 3.0, 0.1, 4), (1, "b", None, 0.2, 2)], "item_no long, item_benchmark string, item_age double, item_rate double, n_subjects long")
    c = neighbors.nn_features(neighbors.in_context(looked, rates, items), fallback=-7.0).first()
    assert (c.passrate_family_conditional, c.passrate_macro_family_conditional, c.passrate_organization_conditional) == (-7.0, 0.5, 1.0)
    assert (c.passrate_benchmark_conditional, c.neighbor_freshness_diff, c.cluster_passrate_subject_query) == (-7.0, -7.0, -7.0) and abs(c.n_distinct_subjects_in_neighborhood - math.log(4)) < 1e-12
    assert len(c) == 24


def test_probed_search_finds_most(spark, data, vecs):
    v = vectors(spark, data)
    centres, _ = models.kmeans(v, 8)
    got = indexing.probe(v, v, centres, 10, 6).toPandas()
    x = vecs[1] / np.linalg.norm(vecs[1], axis=1, keepdims=True)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    best = {i: set(vecs[0][np.argsort(-s)[:10]]) for i, s in zip(vecs[0], sims, strict=True)}
    assert np.mean([r.item in best[r.query] for r in got.itertuples()]) > 0.85


def test_bundle_has_a_size_limit(spark, data, tmp_path):
    v, none = vectors(spark, data), spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        indexing.export_bundle(v, none, none, f"{tmp_path}/small", 4, 100)
    assert not (tmp_path / "small").exists()
    assert sum(indexing.export_bundle(v, none, none, f"{tmp_path}/large", 4, 10**8).values()) > 100


def test_gates_find_what_is_wrong(spark):
    df = spark.createDataFrame([("s", 0, "a", 1.0), ("s", 1, "b", 0.0), ("t", 1, "a", 1.0)], "who string, fold int, item string, label double")
    means = members.oof_means(df, "who", "fold").filter("who <> 't'").withColumn("oof_mean", F.col("oof_mean") + F.when(F.col("fold") == 0, 0.5).otherwise(0.0))
    near = spark.createDataFrame([("a", "b")], "query string, item string")
    got = {r.name: r.n for r in members.oof_gates(df, means.unionByName(means.filter("fold = 1")), near, "who", "fold", "item").collect()}
    assert got == {"wrong_means": 1, "missing": 1, "twice": 1, "items_in_two_folds": 1, "neighbours_in_own_fold": 1}
    with pytest.raises(ValueError):
        members.audit(spark.createDataFrame([(1, [0.5])], "row_id int, v array<double>"))
    with pytest.raises(ValueError):
        members.assert_coverage(spark.createDataFrame([("unknown",), ("x",)], "org string"), {"subject": {"org": 0.9}})
    members.assert_coverage(spark.createDataFrame([("y",), ("x",)], "org string"), {"subject": {"org": 0.9}})


def test_matrix_hides_and_clamps(spark):
    df = spark.createDataFrame([(1, 5.0, float("nan"), "u", True), (2, 5.0, 3.0, None, None)], "k int, m double, t double, c string, hide boolean")
    a, b = members.matrix(df, "k", ["m"], ["t"], {"c": ["u"]}, F.col("hide"), {"m": (0, 1)}).orderBy("k").collect()
    assert tuple(a) == (1, 0.0, 0.0, 0.0, 1.0) and tuple(b) == (2, 1.0, 1.0, 3.0, 0.0)


def test_probe_and_pool_on_new_rows(spark):
    shifts = probes.partial_pool(spark.createDataFrame([(0.5, 1.0, "a", False)] * 20 + [(0.5, 0.0, "b", True)] * 20, "p double, y double, bc string, new boolean"), "p", "y", "bc", "new")
    out = {r.bc: r.calibrated for r in probes.apply_partial_pool(spark.createDataFrame([(0.5, "a", False), (0.5, "b", True), (0.5, "z", True)], "p double, bc string, new boolean"), shifts, "p", "bc", "new").collect()}
    assert out["a"] > 0.5 > out["b"] and out["b"] < out["z"] + 0.2


def test_every_query_without_sql_is_tested():
    assert set(QUERIES) - set(ORACLES) == DONE
