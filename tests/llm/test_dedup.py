import numpy as np
import pytest

from responsa.llm import dedup
from responsa.llm.components import components

SCHEMA = "doc_id long, text string, node string, id string, component string, gone string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "g") for i, t in rows], SCHEMA)


def brute(rows, k=4, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                root[find(a)] = find(b)
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append(rows[a][0])
    return {rows[a][0]: (len(sets[a]), min(groups[find(a)])) for a in range(len(rows))}


def documents(make):
    rows = [(i, make(i, 60)) for i in range(20)]
    for i in range(20, 110):  # near copies of one text, and copies of copies
        w = make(1, 60).split()
        w[i % 60] = f"other{i}"
        if i % 3 == 0:
            w[(i * 7) % 60] = "more"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, make(2, 60).upper()) for i in range(30)]  # the same but for case
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "ONE"), (305, "one two"), (306, "É one two three four"), (307, "é one two three four"), (308, make(9, 20_000)), (309, make(9, 20_000) + " end")]
    return rows


def test_classes_are_those_of_all_pairs(spark, make):
    rows = documents(make)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in dedup.classes(table(spark, rows)).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(rows).items()}


def test_repeated_rows_and_empty_table(spark, make):
    rows = [(5, make(1, 30)), (5, make(1, 30)), (7, make(1, 30)), (8, None), (8, None)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in dedup.classes(table(spark, rows)).collect())
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True), (8, 8, True)]
    kept = dedup.keep_one(table(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [5, 8, 8] and kept.columns == table(spark, rows).columns
    assert dedup.classes(table(spark, [])).count() == 0


def test_large_nodes_lose_no_document(spark, make, monkeypatch):
    monkeypatch.setattr(dedup, "SMALL", 4)  # every group is a large node down to the last depth
    rows = [r for r in documents(make) if r[0] < 110]
    got = {r.doc_id: r.component_id for r in dedup.classes(table(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}


def test_sketch_estimates_similarity():
    got = []
    for seed in range(40):
        x = dedup.mix(np.arange(1000, dtype=np.uint64) + np.uint64(seed * 1000))
        got.append(np.mean(dedup.sketch(x) == dedup.sketch(x[200:])))
    assert np.mean(got) == pytest.approx(0.8, abs=0.015) and np.std(got) < 0.06


def test_recall_follows_from_the_branching():
    """Against trees played out one by one."""
    r = np.random.default_rng(0)

    def meets(agree, depth):
        return depth == 0 or any(agree[r.integers(len(agree))] and meets(agree, depth - 1) for _ in range(1 + (r.random() < 0.25)))

    def pair():
        agree = r.random(dedup.TOKENS) < 0.8
        return any(meets(agree, 3) for _ in range(4))

    lost = np.mean([not pair() for _ in range(6000)])
    assert lost == pytest.approx(dedup.missed(0.8, 4, 3), abs=4 * (lost / 6000) ** 0.5)
    n = dedup.trees_for(0.8)
    assert dedup.missed(0.8, n) <= dedup.MISS < dedup.missed(0.8, n - 1) and dedup.missed(0.9, n) < dedup.MISS


def test_one_doc_id_with_different_texts(spark, make):
    near = lambda seed: make(seed, 60) + " end"
    rows = [(1, make(1, 60)), (1, make(2, 60)), (2, near(1)), (3, near(2)), (None, make(1, 60)), (4, make(3, 60)), (None, near(3)), (None, make(4, 60))]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in dedup.classes(table(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (4, 4, True), (None, 4, False), (None, None, True)], key=str)
    kept = dedup.keep_one(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, make(1, 60)), (1, make(2, 60)), (4, make(3, 60)), (None, make(4, 60))], key=str)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
