"""Links inside a family of documents that are nearly, but not quite, similar enough to each other."""

from responsa.llm import common, dedup

FAMILY, PAIRS = 1000, 100


def family():
    """(rows, planted): documents of 120 common shingles and 20 of their own, 0.75 to each other; planted pairs have 5 or 6 of the 20 in common, 0.806 or 0.818."""
    common = [f"common{i}" for i in range(123)]
    rows, planted = [], []
    for i in range(FAMILY):
        w = [f"d{i}w{j}" for j in range(20)]
        if i < 2 * PAIRS:
            v = 5 + (i // 2) % 2
            w[:v] = [f"p{i // 2}w{j}" for j in range(v)]
            if i % 2:
                planted.append((i - 1, i))
        rows.append((i, " ".join(common + w)))
    return rows, planted


def test_links_in_a_dense_family_are_found(spark):
    rows, planted = family()
    got = {r.doc_id: r.component_id for r in dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: i for i in range(FAMILY)} | {b: a for a, b in planted}
    assert [p for p in planted if got[p[0]] != got[p[1]]] == []
    assert got == want


def test_large_nodes_of_the_same_documents_are_one(spark):
    same = [(n, i, 0 if i < 90 else i) for n in range(16) for i in range(n, n + 100)]  # 16 nodes of one group
    apart = [(n, i, i) for n in (50, 51) for i in range(1000 * n, 1000 * n + 70)]
    df = spark.createDataFrame(same + apart, "node long, id long, component long")
    one, rest = dedup.families(df)
    assert sorted((r.node, r.id, r.component) for r in one.collect()) == sorted({(0, i, c) for _, i, c in same})
    assert sorted((r.node, r.id, r.component) for r in rest.collect()) == sorted(apart)
    one, rest = dedup.families(df.filter("node < 50"))
    assert one.count() == 115 and rest is None


def test_a_worker_keeps_no_cache_of_words(spark):
    """pipeline: idle workers held their cache beside the next stage."""
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d f")], "doc_id long, text string")
    assert dedup.fingerprints(docs, 4).filter("n_shingles = 2").count() == 2
    common.sole("shingles", dict)
    common.done()
    assert not common.KEPT
