"""Junk among the training rows does not set the limits by which it should be rejected."""

import random

from responsa.llm import language


def junk(seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(40))


def documents(make):
    rows = [(i, make(i, 60), "aa") for i in range(400)]
    return rows + [(1000 + i, junk(i), "aa") for i in range(12)]  # 3 % of the rows


def test_planted_junk_is_rejected(spark, make):
    df = spark.createDataFrame(documents(make), "doc_id long, text string, lang string")
    ids = {r.doc_id for r in language.keep_identified(df).collect()}
    assert not [i for i in ids if i >= 1000] and len(ids) == 400
    by = {r.doc_id: r.accepted for r in language.identify(df).collect()}
    assert ids == {i for i, ok in by.items() if ok}


def test_a_language_without_a_limit_takes_the_pooled_one(spark, make):
    rows = [(i, make(i, 60), "aa") for i in range(100)] + [(500 + i, "qu zu", "bb") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.calibrate(df, language.train(df))
    assert "bb" not in model.limits
    odd = spark.createDataFrame([(1, "quzqzu " + junk(3).replace("a", "q") + " zu qu" * 3)], "doc_id long, text string")
    got = language.scores(odd, model).withColumn("lang_pred", language.F.lit("bb")).withColumn("ok", language.accepted(language.REACH, model.limits)).first()
    assert not got.ok
