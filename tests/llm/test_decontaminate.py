import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from responsa.llm import decontaminate

BREAK = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in BREAK.split(low) if w]


def brute(docs, items):
    wins = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[x]
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_find_is_brute_force(spark, make):
    items = [(1, make(1, 30)), (2, make(2, 12)), (10, "Short item"), (11, ""), (12, None), (13, make(1, 30)), (14, "tell me"), (15, "the the the the the the the the the the the")]
    docs = [(0, make(5, 50) + " " + make(1, 30) + " " + make(6, 40)), (1, make(1, 30).upper().replace(" ", ", ")), (2, " ".join(make(1, 30).split()[4:13])), (3, " ".join(make(1, 30).split()[4:14])), (4, None), (5, ""), (6, "... !!"), (7, "a short ITEM here"), (8, make(7, 20_000) + " " + make(2, 12)), (9, "the " * 500), (20, make(8, 60)), (21, "tell me tell me tell"), (22, "Éa short É item")]
    schema = "doc_id long, text string, row string, postings int"
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in docs], schema)
    bench = spark.createDataFrame([(i, t, "t") for i, t in items], "item_id long, text string, term string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.find(df, bench).collect()}
    assert got == brute(docs, items)
    twice = decontaminate.find(df.unionByName(df), bench)
    assert twice.count() == 2 * len(docs)
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, x in brute(docs, items).items() if not x[4]}
    assert decontaminate.find(df, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.find(df.limit(0), bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(0, "red blue then green"), (1, "green red and the blue"), (2, "red one two three four five six blue green")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "red blue green")], "item_id long, text string")
    assert {r.doc_id: r.n_near for r in decontaminate.find(docs, bench, near=5).collect()} == {0: 1, 1: 1, 2: 0}


def test_proximity_is_brute_force(spark):
    r = random.Random(1)
    few = [f"w{i}" for i in range(30)]
    items = [(k, " ".join(r.choice(few) for _ in range(n))) for k, n in enumerate((3, 4, 12, 10, 2, 1, 5))]
    docs = [(i, " ".join(r.choice(few) for _ in range(r.choice((0, 3, 19, 20, 21, 60, 150))))) for i in range(60)]
    want = {}
    for i, t in docs:
        w = t.split()
        spans = [set(w[s : s + 20]) for s in range(max(1, len(w) - 19))]
        want[i] = len({k for k, x in items for j in range(max(1, len(x.split()) - 9)) if len(x.split()) > 1 and any(set(x.split()[j : j + 10]) <= s for s in spans)})
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.n_near for r in got} == want and any(want.values())


def test_items_and_rows_without_id(spark, make):
    docs = spark.createDataFrame([(None, make(1, 40)), (None, make(2, 40)), (3, "quite clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, make(1, 12)), (5, make(1, 11))], "item_id long, text string")
    got = sorted((r.n_hit, r.n_items, r.contaminated) for r in decontaminate.find(docs, bench).collect())
    assert got == [(0, 0, False), (0, 0, False), (12, 1, True)]
    assert sorted(r.text for r in decontaminate.keep_clean(docs, bench).collect()) == sorted([make(2, 40), "quite clean"])


def test_sql_says_the_same(spark, make):
    docs, items = [(i, make(i, 40) + " " + make(100 + i % 3, 14)) for i in range(12)], [(k, make(100 + k, 14)) for k in range(3)]
    con = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    want = sorted(con.execute(f"SELECT doc_id, n_hit, n_near, items_sha256 FROM ({decontaminate.ORACLE})").fetchall())
    df = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.n_hit, r.n_near, r.items_sha256) for r in df.collect()) == want
    assert df.filter(F.col("n_hit") == 14).count() == 12
