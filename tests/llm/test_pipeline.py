import corpus_pipeline
from responsa.llm import packing

import __spark_entry__


def test_entries():
    q = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in q) for k in range(1, 11)) and "pipeline" in q and set(__spark_entry__.oracle_sql()) <= set(q)


def test_stages_on_a_small_table(spark, data, make):
    bench = spark.read.parquet(f"{data}/benchmark.parquet").first().text
    base = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").filter("n_chars BETWEEN 900 AND 4000").orderBy("doc_id").select("text").limit(40).collect()]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    copy, leak, mail = base[3] + " end", base[4] + " " + bench, base[5].replace(" ", " someone@mail.example.org ", 1)
    rows += [(100, copy, "en", "s", len(copy)), (101, leak, "en", "s", len(leak)), (102, mail, "en", "s", len(mail)), (103, "123 456", "en", "s", 7), (104, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, data)
        if name != "packing":
            assert new.columns == docs.columns
        docs = new.cache()
        out[name] = {r.doc_id: r for r in docs.collect()}
    assert not {103, 104} & set(out["language_id"])
    assert 100 not in out["near_dedup"] and 3 in out["near_dedup"]
    assert 101 not in out["decontamination"]
    assert set(out["pii"]) == set(out["decontamination"]) and not any("@mail" in r.text for r in out["pii"].values())
    assert set(out["packing"]) == set(out["pii"])


def test_run(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and all(0 < r.length <= packing.SIZE for r in rows)
