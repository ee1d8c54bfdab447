import numpy as np
import pytest

from pyspark.sql import functions as F

from responsa.llm import neighbours, sharding, url_filter


def test_sharding_table_is_even_and_stable():
    t = sharding.fill(sharding.names(7), 1009)
    counts = np.bincount(t)
    assert counts.sum() == 1009 and counts.max() - counts.min() <= 1
    less = sharding.fill(sharding.names(7)[:-1], 1009)
    moved = np.mean([a != b for a, b in zip(t, less, strict=True) if a < 6])
    assert moved < 0.25
    for bad in ((["a"], 1000), ([], 7), (["a"] * 8, 7)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_sharding_by_turns():
    """Against the turns played one by one."""
    import hashlib

    shards, m = ["a", "b", "c"], 13
    h = lambda s, salt: int.from_bytes(hashlib.sha256(f"{salt}:{s}".encode()).digest()[:8], "big")
    prefer = [[(h(s, "offset") % m + k * (h(s, "skip") % (m - 1) + 1)) % m for k in range(m)] for s in shards]
    out = {}
    while len(out) < m:
        for k, p in enumerate(prefer):
            if len(out) < m:
                out[next(x for x in p if x not in out)] = k
    assert sharding.fill(shards, m) == [out[x] for x in range(m)]


def test_placement(spark, tmp_path):
    import hashlib

    df = spark.createDataFrame([(i, "s", "old") for i in range(500)] + [(None, "s", "old"), (7, "s", "old")], "doc_id long, shard_no string, shard string")
    got = sharding.place(df, "doc_id", sharding.names(5), 101)
    t = sharding.fill(sharding.names(5), 101)
    rows = got.collect()
    assert len(rows) == 502
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101 and r.shard_no_ == t[r.slot]
        assert (r.shard_no, r.shard, r.shard_) == ("s", "old", f"shard-{t[r.slot]:04d}")
    assert sharding.place(df.withColumn("SLOT", F.lit(1)), "doc_id", sharding.names(5), 101).columns == [*df.columns, "SLOT", "slot_", "shard_no_", "shard_"]
    sharding.write(df.select("doc_id"), "doc_id", sharding.names(5), str(tmp_path / "out"), 101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 502
    assert sharding.place(df.limit(0), "doc_id", sharding.names(5), 101).count() == 0


URLS = ["http://WWW.Example.com/en/1", "https://example.com/en/2#a/b", "https://a.net/es/", "https://net/fr/x?q=/es/", "https://evilnet/es/", "https://a.net", "https://x.org?u=/en/", "https://com/", "mailto:a", "", None, "//example.com/en/", "ftp://a.b.c.example.com/EN/", "http://example.com/en/" + "x" * 50_000, "http://" + "a." * 3000 + "com/en/", "http://É.NET/es/1", "http://.net/es/"]


def brute(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "h", "b") for i, u in enumerate(URLS)] + [(0, URLS[0], "h", "b")], "page_id long, url string, host string, block string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    rows = url_filter.judge(df, rules).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute(URLS[r.page_id])
    assert {r.verdict for r in url_filter.judge(df, rules.limit(0), "block").collect()} == {"block"}
    assert url_filter.judge(df.limit(0), rules).count() == 0


def test_bloom_filter_passes_all_keys_and_few_others(spark):
    many = spark.range(5000).selectExpr("concat('h', id, '.org') AS host", "'/' AS path", "'block' AS verdict")
    pages = spark.range(9000).selectExpr("id AS page_id", "concat('http://h', id, '.org/x') AS url")
    got = url_filter.judge(pages, many)
    assert got.filter("verdict = 'block'").count() == 5000 and got.filter("verdict = 'block' AND page_id >= 5000").count() == 0


def test_neighbours_of_odd_vectors(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(300, 8)) * r.uniform(0.5, 2, size=(300, 1))
    v[50:90] = v[50]  # ties
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)] + [(400, None, "x"), (401, [0.0] * 8, "x"), (402, [float("nan")] * 8, "x"), (403, [None] * 8, "x"), (404, [float("inf")] + [0.0] * 7, "x"), (None, [1.0] * 8, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, norm2 string")
    c = neighbours.clean(df, "vec_id", "embedding").cache()
    got = neighbours.nearest(c, c.filter("id % 10 = 0"), k=5, block=100, chunk=7).collect()
    found, right = {}, 0
    for x in got:
        found.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert set(found) == set(range(0, 300, 10))
    for q, xs in found.items():
        s = v @ v[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [k for k, _, _ in sorted(xs)] == [1, 2, 3, 4, 5] and all(abs(s[i] - z) < 1e-9 for _, i, z in xs)
        right += len({i for _, i, _ in xs} & set(best))
    assert right / (5 * len(found)) >= 0.9
    few = c.filter("id < 3").cache()
    assert neighbours.nearest(few, few, k=20).count() == 6 and neighbours.nearest(c.limit(0), c.limit(0)).count() == 0


def test_recall_on_the_table(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    v = np.stack(e.embedding.to_list()).astype(float)
    got = neighbours.query(spark, data).toPandas().groupby("query_id").vec_id.apply(set)
    hits = []
    for k in np.flatnonzero(e.vec_id.to_numpy() % 20 == 0):
        s = v @ v[k]
        s[k] = -9
        hits.append(len(got[e.vec_id[k]] & set(e.vec_id[np.argsort(-s)[:20]])) / min(20, len(v) - 1))
    assert np.mean(hits) >= 0.9


def test_a_list_of_any_shape(spark):
    """Paths of some 600 lengths under one host, and a host of many labels."""
    rules = [("a.org", "/" + "x" * k, "block" if k % 2 else "allow") for k in range(600)] + [(".".join("abcdefgh") + ".net", "/p", "block"), ("org", "/" + "x" * 300 + "y", "block")]
    urls = ["http://s.a.org/" + "x" * k + tail for k in (0, 1, 300, 599, 700) for tail in ("", "y", "?q")] + ["https://z." + ".".join("abcdefgh") + ".net/pq", "http://b.org/" + "x" * 300 + "yz", "http://org", "x://" + "." * 50 + "/"]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    for r in got:
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r.rule, r.verdict) == best[1:], urls[r.page_id]
    assert len(got) == len(urls)


def test_vectors_of_several_sizes_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.25, 0.0]), (3, [1.0, 2.0, 3.0]), (4, [1.0, 1.0, 1.0]), (5, [1.0])]
    c = neighbours.clean(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").cache()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(c, c.filter("id <> 4")).collect())
    assert got == [(1, 1, 2, 0.5), (1, 2, 2, 0.25), (2, 1, 1, 0.5), (2, 2, 1, 0.25), (3, 1, 4, 6.0)]
