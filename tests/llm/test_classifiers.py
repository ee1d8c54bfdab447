import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from responsa.llm import language, quality

TEXTS = {"aa": ["bana kana mana", "kana bana sana lana", "nana kana"], "bb": ["strum krund brump", "brund strump", "krump strund brum"]}


def frame(spark, n=40):
    rows = [(i, " ".join([TEXTS[k][i % 3], TEXTS[k][(i + 1) % 3]] * 5), k) for i in range(n) for k in ("aa" if i % 2 else "bb",)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, score string, c0 string"), rows


def kneser_ney(rows, order):
    """p(character | context) of one language, straight from the definition."""
    raw = Counter()
    for t in rows:
        for w in language.words(t):
            w = language.BEGIN + w + language.END
            for i in range(1, len(w)):
                raw[w[max(0, i - order + 1) : i + 1]] += 1
    counts = {order: {g: n for g, n in raw.items() if len(g) == order}}
    for k in range(order - 1, 0, -1):
        counts[k] = dict(Counter(g[1:] for g in counts[k + 1]))
        counts[k].update({g: n for g, n in raw.items() if len(g) == k})
    alphabet = len(counts[1])

    def p(g, size):
        k = len(g)
        if not k:
            return 1 / size
        own = {x: n for x, n in counts[k].items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:], size)
        ones, twos = (sum(n == j for n in counts[k].values()) for j in (1, 2))
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        total = sum(own.values())
        return max(own.get(g, 0) - d, 0) / total + d * len(own) / total * p(g[1:], size)

    return p, alphabet


def test_probabilities_are_interpolated_kneser_ney(spark):
    df, rows = frame(spark)
    model = language.train(df, order=3)
    size = len({c for _, t, _ in rows for w in language.words(t) for c in w + language.END}) + 1000
    for j, lang in enumerate(["aa", "bb"]):
        p, _ = kneser_ney([t for _, t, k in rows if k == lang], 3)
        for w in ("bana", "krund", "xyz", "sna", "ñ"):
            padded = language.BEGIN + w + language.END
            want = sum(math.log(p(padded[max(0, i - 2) : i + 1], size)) for i in range(1, len(padded)))
            assert abs(model.log_probs([w])[0, j] - want) < 1e-3, (w, lang)


def test_language_cases(spark):
    df, rows = frame(spark)
    model = language.calibrate(df, language.train(df))
    odd = [(1, "KANA mana!"), (2, "strund"), (3, None), (4, ""), (5, "123 ... !"), (6, "kana " * 30_000), (7, "kana bana"), (7, "kana bana")]
    out = language.scores(spark.createDataFrame([(i, t, "q") for i, t in odd], "doc_id long, text string, entropy string"), model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 8 and [by[i].lang_pred for i in range(1, 7)] == ["aa", "bb", "und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in out) and by[3].score == 0
    none = language.scores(df, language.train(df.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"} and language.scores(df.limit(0), model).count() == 0
    kept = language.keep_identified(df.unionByName(df.limit(1)))
    assert kept.columns == df.columns and kept.count() == 41


def test_rejection(spark):
    df, _ = frame(spark)
    bad = spark.createDataFrame([(900, "qzxwv jfqxz vvqj " * 20, "aa", "x", "y"), (901, None, None, "x", "y"), (902, "!!!", "aa", "x", "y")], df.schema)
    ids = {r.doc_id for r in language.keep_identified(df.unionByName(bad.withColumn("lang", F.lit(None).cast("string")))).collect()}
    assert not ids & {900, 901, 902} and len(ids) == 40


def test_language_held_out_accuracy(spark, data):
    got = language.query(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out, strict=True))
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95


def test_descent_reaches_the_optimum():
    r = np.random.default_rng(0)
    xs = [np.unique(r.integers(0, 30, 8)) for _ in range(80)]
    ys = np.array([float((x < 12).sum() > 3) for x in xs])
    scale = r.uniform(0.5, 1.5, 30)
    w, b = quality.descend(xs, np.array(list(map(len, xs))), ys, scale, cost=0.5, epochs=2000)
    x = np.zeros((80, 31))
    for i, s in enumerate(xs):
        x[i, s] = scale[s] / math.sqrt(len(s))
    x[:, 30] = 1
    sign = np.where(ys > 0, 1, -1)
    loss = lambda u: u @ u / 2 + 0.5 * np.maximum(0, 1 - sign * (x @ u)).sum()
    best, u = loss(np.append(w, b)), np.append(w, b)
    # convex, so no step in any of many directions makes it less
    steps = [np.eye(31)[i] * z for i in range(31) for z in (1, -1)] + list(r.normal(size=(300, 31)) / 5)
    assert min(loss(u + h * d) for d in steps for h in (0.1, 0.01, 0.001)) > best - 1e-3


def test_quality_cases(spark):
    good, bad = "the quick brown fox jumps over the lazy dog today", "BUY!! NOW!! CHEAP!! PILLS!! HERE!!"
    rows = [(i, f"{good} {i}" if i % 3 else f"{bad} {i}", "z") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)] + [(5, None, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    odd = [(0, "the lazy dog jumps over a fox"), (1, "PILLS!! BUY!! CHEAP!!"), (2, None), (3, ""), (4, good + " x" * 50_000), (4, "again")]
    got = quality.scores(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    s = {r.doc_id: r.score for r in got}
    assert len(got) == 6 and all(0 <= x <= 1 for x in s.values()) and s[0] > 0.5 > s[1] and s[2] == s[3]
    assert [r.score for r in quality.scores(docs.limit(1), quality.train(docs, labels.limit(0))).collect()] == [0.5]
    assert quality.scores(docs.limit(0), model).count() == 0
    one = quality.train(docs, labels.filter("quality = 1"))
    assert quality.scores(docs.limit(1), one).first().score > 0.9


def test_class_counts_cover_all_training_rows(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i % 2 else "alpha") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    train = [i for i in range(50) if zlib.crc32(str(i).encode()) % 4 != 2]
    names = quality.features("alpha beta", quality.Words())
    rows = {r["at"]: r for r in quality.class_counts(quality.labelled(docs, labels), names).collect()}
    assert (rows[-1].pos, rows[-1].neg) == (sum(i % 2 for i in train), sum(1 - i % 2 for i in train))
    assert all(rows[k].pos == rows[-1].pos for k in range(len(names)))


def test_scores_are_those_of_the_definition(spark):
    """Counts, ratios, margins and curve by plain loops over sets of features; only the descent's weights are taken as they are."""
    docs = [(i, ("fine words about rivers and stones %d" if i % 3 else "win win CASH %d now!!") % (i % 7)) for i in range(90)]
    labels = [(i, int(i % 3 > 0)) for i in range(90)]
    model = quality.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    cache = quality.Words()
    sets = {i: {int(x) for x in quality.features(t, cache)} for i, t in docs}
    rows = [i for i in sets if zlib.crc32(str(i).encode()) % 4 != 2]
    seen = Counter(x for i in rows for x in sets[i])
    assert {int(x) for x in model.names} <= {x for x, n in seen.items() if n >= quality.TEXTS}
    weight = dict(zip(model.names.tolist(), model.weights.tolist(), strict=True))
    got = {r.doc_id: r.score for r in quality.scores(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    for i, s in sets.items():
        margin = sum(weight.get(x, 0.0) for x in s) / math.sqrt(len(s)) + model.bias
        assert abs(got[i] - 1 / (1 + math.exp(-model.slope * margin - model.offset))) < 1e-9
    pos = sum(y for i, y in labels if i in rows)
    r = quality.ratios(np.array([3.0]), np.array([1.0]), pos, len(rows) - pos)[0]
    assert abs(r - math.log((4 / (pos + 2)) / (2 / (len(rows) - pos + 2)))) < 1e-12


def test_a_long_word_counts_whole_and_ties_are_stable(spark):
    cache = quality.Words(4)
    assert quality.shape("a" * 100 + "1B") == "xdX" and quality.shape("a1" * 20) == "xd" * 20
    one, two = quality.features("x" * 80 + "1", cache), quality.features("x" * 80 + "2!", cache)
    assert len(np.intersect1d(one, two)) < len(one)
    assert (quality.features("a b c d e f g h", cache) == quality.features("a b c d e f g h", quality.Words())).all()
    known = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 4 != 2)
    labels = spark.createDataFrame([(known, 1), (known, 0), (known, 1)], "doc_id long, quality int")
    assert [r.label for r in quality.sampled(labels, 3, 2).collect()] == [0, 1]
