"""Models keep every n-gram, however many a language has."""

import random

from responsa.llm import language


def test_all_ngrams_of_a_large_language_are_kept(spark):
    r = random.Random(3)
    said = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(26_000)]
    rows = [("xx", " ".join(said[k : k + 100])) for k in range(0, len(said), 100)] + [("yy", "one two three")]
    grams = {w[i : i + 5] for w in (language.BEGIN + w + language.END for w in [*said, "one", "two", "three"]) for i in range(len(w) - 4)}
    model = language.train(spark.createDataFrame(rows, "lang string, text string"))
    assert len(grams) > 200_000 and len(model.keys[4]) == len(grams)


def test_numbers_are_no_letters(spark):
    df = spark.createDataFrame([("xx", "one two three")], "lang string, text string")
    model = language.train(df)
    odd = [(1, "½ ² ① Ⅷ ๓"), (2, "½one"), (3, "ªº"), (4, "中文")]
    got = {r.doc_id: r for r in language.scores(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert (got[1].lang_pred, got[1].score) == ("und", 0.0) and all(got[i].lang_pred == "xx" for i in (2, 3, 4))
