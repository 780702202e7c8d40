import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from anamnesis.operators import analytics, fusion, graph, lexical, lifecycle, vector

DOCS = "id long, text string"


def test_bm25_exact_beats_prefix_and_ties_go_to_smaller(spark):
    df = spark.createDataFrame([(1, "redis cache layer here"), (2, "redistool cache layer here"), (3, "other words only now"), (4, None), (5, ""), (6, "other words only now")], DOCS)
    terms = lexical.terms_of(spark, "redis")
    got = lexical.searched(df, "id", "text", terms, prefixes=True).orderBy(F.desc("score")).collect()
    assert [r["doc"] for r in got] == [1, 2] and got[0]["score"] > got[1]["score"]
    index = lexical.postings(df, "id", "text")
    assert [r["doc"] for r in lexical.top(lexical.bm25(index, lexical.terms_of(spark, "other")), 5).orderBy("rank").collect()] == [3, 6]
    assert lexical.searched(df.limit(0), "id", "text", terms).count() == 0
    assert lexical.searched(df, "id", "text", lexical.terms_of(spark, "")).count() == 0


def test_search_with_and_without_index_agree(spark, monkeypatch):
    rng = random.Random(1)
    df = spark.createDataFrame([(k, " ".join(rng.choice(["aa", "bb", "abc", "cc", "dd"]) for _ in range(rng.randint(0, 12)))) for k in range(60)], DOCS)
    terms = lexical.terms_of(spark, "aa ab")
    fast = {tuple(r) for r in lexical.searched(df, "id", "text", terms, True).collect()}
    monkeypatch.setattr(lexical, "LITERAL_TERMS", 0)
    assert fast == {tuple(r) for r in lexical.searched(df, "id", "text", terms, True).collect()}


def test_synonyms_weigh_less(spark):
    t = {r["term"]: r["weight"] for r in lexical.terms_of(spark, "db", expand=True).collect()}
    assert t["db"] == 1.0 and t["databas"] == 0.7


@pytest.mark.parametrize("block", [1024, 3])
def test_vector_batches_match_brute_force(spark, block):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    x[7] = 0
    rows = [(k, [float(v) for v in a]) for k, a in enumerate(x)] + [(200, None), (201, [1.0])]
    df = spark.createDataFrame(rows, "key long, v array<float>")
    got = {(r["query_id"], r["rank"]): (r["key"], r["score"]) for r in vector.batch_top(df, df.where("key % 10 = 0"), "key", "v", 3, block).collect()}
    y = x.astype(np.float64)
    n = np.linalg.norm(y, axis=1, keepdims=True)
    y = np.divide(y, n, out=np.zeros_like(y), where=n > 0)
    for q in range(0, 120, 10):
        s = np.round(y[q] @ y.T, 6)
        s[q] = -9
        want = np.argsort(-s, kind="stable")[:3]
        assert [got[q, k + 1][0] for k in range(3)] == list(want)


def test_fusion_and_diversification(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "doc long, rank int")
    b = spark.createDataFrame([(3, 1), (4, 2)], "doc long, rank int")
    f = {r["doc"]: r for r in fusion.fused({"bm25": a, "vector": b}).collect()}
    assert f[3]["n_streams"] == 2 and f[3]["score"] > f[1]["score"]
    want = (0.4 / 63 + 0.6 / 61) / (1.0 / 61) * 1.05
    assert f[3]["score"] == pytest.approx(want, abs=1e-6)
    only = fusion.fused({"bm25": a}).where("doc = 1").first()
    assert only["score"] == pytest.approx(1.0)
    rows = spark.createDataFrame([(k, "s" if k < 6 else "t", 1.0 - k / 10, k) for k in range(8)], "doc long, g string, score double, best_rank int")
    assert [r["doc"] for r in fusion.diversified(rows, "g", 6).collect()] == [0, 1, 2, 6, 7, 3]


def test_packing_stops_or_skips(spark):
    rows = spark.createDataFrame([("p", 3, "a", 5), ("p", 2, "b", 9), ("p", 1, "c", 4)], "g string, at int, k string, n int")
    assert {r["k"] for r in fusion.packed_prefix(rows, [F.desc("at")], "n", 13).collect()} == {"a"}
    assert {r["k"] for r in fusion.packed_skipping(rows, ["g"], "at", "k", "n", 10).collect()} == {"a", "c"}


def test_ttl_windows_match_a_loop(spark):
    rng = random.Random(0)
    rows = [(rng.choice("ab"), rng.randint(0, 4000)) for _ in range(300)] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, s int").select("k", F.timestamp_seconds("s").alias("ts"))
    got = {r["k"]: (r["rows"], r["kept"]) for r in lifecycle.kept_by_ttl(df, ["k"], "ts", 300).collect()}
    for k in "ab":
        times = sorted(s for x, s in rows if x == k and s is not None)
        kept, last = 0, None
        for t in times:
            if last is None or t - last > 300:
                kept, last = kept + 1, t
        assert got[k] == (len(times), kept)


def test_retention_tiers(spark):
    df = spark.createDataFrame([("bug", 0, []), ("fact", 300, []), ("fact", 10, [1])], "kind string, age int, used array<int>")
    now = "2026-01-01 00:00:00"
    ago = lambda d: F.lit(now).cast("timestamp") - F.make_interval(days=d)
    got = df.select(lifecycle.retention(F.col("kind"), ago(F.col("age")), F.transform("used", lambda d: F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) - d.cast("long") * 86_400_000_000)), now).alias("s")).collect()
    assert [round(r["s"], 3) for r in got] == [0.7, 0.025, 0.771]
    assert [r["t"] for r in spark.createDataFrame([(0.9,), (0.5,), (0.2,), (0.1,)], "s double").select(lifecycle.tier(F.col("s")).alias("t")).collect()] == ["hot", "warm", "cold", "evictable"]


def test_last_writer_wins_prefers_local_on_ties(spark):
    a = spark.createDataFrame([("x", 1, "local"), ("y", 5, "local")], "id string, at int, who string")
    b = spark.createDataFrame([("x", 1, "remote"), ("y", 9, "remote"), ("z", 1, "remote")], "id string, at int, who string")
    assert {r["id"]: r["who"] for r in lifecycle.last_writer_wins(a, b, "id", "at").collect()} == {"x": "local", "y": "remote", "z": "remote"}


def test_graph_extraction_search_and_paths(spark):
    rows = [("m", ["A", "a ", " ", "B"], ["f"]), ("n", None, None), (None, ["x"], ["y"]), ("big", [f"c{k}" for k in range(10)], [f"f{k}" for k in range(10)])]
    e = graph.extracted(spark.createDataFrame(rows, "id string, c array<string>, f array<string>"), "id", "c", "f")
    assert {(r["source"], r["target"]) for r in e.where("id = 'm'").collect()} == {("concept:a", "file:f"), ("concept:b", "file:f"), ("concept:a", "concept:b")}
    assert e.where("id = 'big'").count() == graph.MOST_EDGES and e.where("id is null").count() == 0
    edges = spark.createDataFrame([("a", "z", 0.1), ("a", "b", 1.0), ("b", "z", 1.0), ("z", "q", 1.0)], "source string, target string, weight double")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r["node"]: r["depth"] for r in graph.reached(edges, start, 2).collect()} == {"a": 0, "b": 1, "z": 1, "q": 2}
    cost = {r["node"]: (r["cost"], r["steps"]) for r in graph.cheapest(edges, start, 2).collect()}
    assert cost["z"] == (2.0, 2) and cost["q"] == (11.0, 2)
    items = spark.createDataFrame([(1, "done"), (2, "open"), (3, "open"), (4, "open")], "id int, s string")
    needs = spark.createDataFrame([(2, 1), (3, 2), (4, 99)], "id int, on int")
    assert {r["id"] for r in graph.unblocked(items, needs, "id", F.col("s") == "done").collect()} == {2, 4}


def test_analytics(spark):
    f = spark.createDataFrame([(s, x) for s in "abc" for x in ("f1", "f2")] + [("a", "f3"), ("a", "f1"), (None, "f1"), ("d", None)], "s string, f string")
    assert [tuple(r) for r in analytics.cochanged(f, "s", "f", 3).collect()] == [("f1", "f2", 3)]
    links = spark.createDataFrame([(1, "p"), (1, "p"), (1, "q"), (2, "p"), (2, "q"), (3, "q"), (4, None)], "k int, v string")
    assert {(r["k"], r["v"]) for r in analytics.majority(links, "k", "v").collect()} == {(1, "p"), (3, "q")}
    r = spark.createDataFrame([(1, d, d) for d in range(1, 6)], "q int, doc int, rank int")
    gold = spark.createDataFrame([(1, 2), (1, 9), (2, 1)], "q int, doc int")
    got = {x["q"]: x for x in analytics.ranking_quality(r, gold, 5).collect()}
    assert (got[1]["precision"], got[1]["recall"], got[1]["mrr"]) == (0.2, 0.5, 0.5) and got[2]["ndcg"] == 0.0
    t = spark.createDataFrame([(k, f"2026-01-01 00:00:{k:02d}") for k in range(0, 40, 2)], "id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    near = analytics.around(t, "ts", "id", "2026-01-01 00:00:09", 2, 3).orderBy("relative").collect()
    assert [(x["relative"], x["id"]) for x in near] == [(-2, 4), (-1, 6), (0, 8), (1, 10), (2, 12), (3, 14)]
