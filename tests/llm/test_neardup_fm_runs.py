import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from anamnesis.llm import leakage, marks, neardup, runs
from anamnesis.llm.fmindex import FMIndex, suffix_array
from anamnesis.plans import scratch

TEXT = "field_name string, id string, text string"


def brute_pairs(rows, t=0.7):
    sets = {}
    for f, i, x in rows:
        w = frozenset(re.findall(r"[^\W_]+", (x or "").lower()))
        if i is not None and w:
            sets[f, i] = w
    out = set()
    for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
        if a[0] == b[0] and len(x & y) >= t * len(x | y) - 1e-12:
            out.add((a[0], *sorted((a[1], b[1]))))
    return out


@pytest.mark.parametrize("block, fragments, part", [(4096, 4, 4096), (3, 1, 2), (3, 7, 2)])
def test_similar_records_match_brute_force(spark, monkeypatch, block, fragments, part):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "PART", part)
    monkeypatch.setattr(neardup, "PAIRS", 50)
    monkeypatch.setattr(neardup.classes, "__defaults__", (fragments, *neardup.classes.__defaults__[1:]))
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(150):
        base = rng.sample(words, rng.randint(1, 14)) if k % 3 or not rows else [w for w in re.findall(r"\w+", rows[-1][2] or "x") if rng.random() > 0.1] + rng.sample(words, 1)
        rows.append((rng.choice(["a", "b"]), f"r{k:03d}", " ".join(base)))
    rows += [("a", "copy1", "Same, same words!"), ("a", "copy2", "words SAME"), ("b", "copy3", "words same"), ("a", None, "same words"), ("a", "n1", None), ("a", "n2", " \n"), ("a", "n3", "--- ...")]
    rows += [("a", "copy1", "Same, same words!")]
    df = spark.createDataFrame(rows, TEXT).withColumn("block", F.lit(1)).withColumn("class_id", F.lit("x"))
    got = [tuple(r) for r in neardup.similar_records(df).select("field_name", "id_a", "id_b").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs(rows)


def test_groups_count_links_between_classes(spark):
    rows = [("f", "a", "one two three four five six seven eight nine ten"), ("f", "b", "one two three four five six seven eight nine eleven"), ("f", "c", "ten nine eight seven six five four three two one"), ("f", "d", "alone")]
    got = {r["id"]: r for r in neardup.groups(spark.createDataFrame(rows, TEXT)).collect()}
    assert got["a"]["class_id"] == got["c"]["class_id"] == "a" != got["b"]["class_id"]
    assert [got[k]["links"] for k in "abcd"] == [1, 1, 1, 0]


def test_overlaps_are_summed_over_fragments(spark):
    """Each fragment counts its own part of the overlap; without the later ones similar pairs are missed."""
    base = [f"w{k:02d}" for k in range(20)]
    rows = [("f", "a", " ".join(base)), ("f", "b", " ".join([*base[:19], "x1"])), ("f", "c", " ".join([*base[1:], "x1"]))] + [("f", f"n{k}", " ".join(base[k % 7 : k % 7 + 3])) for k in range(12)]
    members, sets, words_ = neardup.classes(spark.createDataFrame(rows, TEXT), fragments=4)
    assert len(words_.pivots) == 3
    cut = neardup.segments(sets, words_).collect()
    assert len({r["key"] for r in cut}) > sets.distinct().count()
    whole = {tuple(r) for r in neardup.similar_classes(sets, words_, 0.7).select("a", "b").collect()}
    keep = neardup.segments
    try:
        neardup.segments = lambda s, w, m: keep(s, w, m).where(F.size("words") > 6)
        part = {tuple(r) for r in neardup.similar_classes(sets, words_, 0.7).select("a", "b").collect()}
    finally:
        neardup.segments = keep
    assert len(whole) == 3 and part < whole


def test_counters_come_to_the_driver_in_blocks(spark, monkeypatch):
    """A map of counters, or of marks, is collected as a few blocks of bytes and never as a row for each place."""
    got, kind = [], type(spark.range(1))
    keep = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: got.append(keep(df)) or got[-1])
    monkeypatch.setattr(kind, "toPandas", lambda df: pytest.fail("rows of counters go to the driver"))
    n, bits = 50_000, 20
    places = spark.range(n).select((F.col("id") * 7 % (1 << bits)).cast("int").alias("at"), (F.col("id") % 100 + 1).cast("tinyint").alias("level"))
    level = marks.dense(places, 1 << bits, np.int8)
    k = np.arange(n)
    assert level.dtype == np.int8 and len(level) == 1 << bits
    assert (level[k * 7 % (1 << bits)] == k % 100 + 1).all() and np.count_nonzero(level) == n
    keys = spark.range(n).select(F.xxhash64("id").alias("k"))
    seen = marks.marked(keys, 25)
    assert marks.among(seen, keys.toArrow().column(0).to_numpy()).all()
    rows = [("f", f"r{k}", f"alpha beta gamma delta word{k} other{k // 2}") for k in range(200)]
    assert neardup.classes(spark.createDataFrame(rows, TEXT))[2].level.any()
    assert max(len(x) for x in got) <= (1 << 20) >> marks.DENSE


def test_neardup_leaves_no_shuffle_files_of_its_postings(spark):
    before = spark.conf.get(scratch.CLEANUP)
    rows = [("f", f"r{k}", f"alpha beta gamma delta word{k} other{k // 2}") for k in range(200)]
    members, sets, words_ = neardup.classes(spark.createDataFrame(rows, TEXT))
    seen = []
    keep = neardup.written
    neardup.written = lambda df, name: seen.append(spark.conf.get(scratch.CLEANUP)) or keep(df, name)
    try:
        neardup.similar_classes(sets, words_).count()
    finally:
        neardup.written = keep
    assert seen == ["true"] and spark.conf.get(scratch.CLEANUP) == before


def test_neardup_of_nothing(spark):
    assert neardup.similar_records(spark.createDataFrame([], TEXT)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_fm_index_finds_what_scanning_finds(text):
    t = np.array(text)
    s = np.concatenate([t + 1, [0]])
    assert list(suffix_array(s)) == sorted(range(len(s)), key=lambda i: list(s[i:]))
    index = FMIndex(t, 4)
    patterns = np.array(list(itertools.product([1, 2, 3], repeat=2)))
    lo, hi = index.ranges(patterns)
    for p, a, b in zip(patterns, lo, hi):
        assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(t) - 1) if list(t[i : i + 2]) == list(p)]


def test_leaks_across_case_marks_and_long_texts(spark):
    passage = " ".join(f"Word{k}" for k in range(20))
    items = [(1, "t", passage, None), (2, "t", "too short", passage.replace("Word3", "other")), (3, "t", None, "")]
    docs = [
        (1, "x " * 50_000 + passage.upper().replace(" ", " -- ") + " tail"),
        (2, " ".join(passage.split()[:11])),
        (3, " ".join(passage.split()[5:17])),
        (4, None),
        (5, ""),
        (None, passage),
        (1, "x " * 50_000 + passage.upper().replace(" ", " -- ") + " tail"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(9))
    i = spark.createDataFrame(items, "item_id long, item_type string, question string, answer string")
    assert {tuple(r) for r in leakage.leaked(d, i).collect()} == {(1, 1), (1, 2), (3, 1), (3, 2)}
    s = {(r["doc_id"], r["item_id"]): (r["first_word"], r["last_word"]) for r in leakage.spans(d, i).collect()}
    assert s[1, 1] == (50_000, 50_019)
    assert {r["item_id"]: r["n_docs"] for r in leakage.item_report(d, i).collect()} == {1: 2, 2: 2, 3: 0}
    assert leakage.leaked(d.limit(0), i).count() == 0
    assert leakage.leaked(d, i.limit(0)).count() == 0


EVENT = "event_id string, session_id string, ts string, kind string, tool_name string, duration_ms long"


def brute_runs(rows):
    one = {}
    for e, s, t, k, n, _ in rows:
        if e and s:
            one.setdefault(e, (s, t or "", e, k, re.sub(r"[\W_]+", "", (n or "").lower())))
    out = set()
    for _, g in itertools.groupby(sorted(one.values()), key=lambda x: x[0]):
        for _, run in itertools.groupby(g, key=lambda x: x[3:]):
            run = list(run)
            if len(run) > 1:
                out.add((run[0][0], run[0][2], run[-1][2]))
    return out


def test_runs_match_brute_force_over_partition_edges(spark):
    rng = random.Random(2)
    tools = ["Read", " read", "READ ", "read_file", "Read-File", None, "", "Bash"]
    rows = [(f"e{k:04d}", rng.choice(["hot"] * 3 + ["s1", "s2"]), f"2026-01-01 00:00:{rng.randint(0, 59):02d}" if rng.random() > 0.05 else None, rng.choice(["call", "call", None]), rng.choice(tools[:4] if rng.random() > 0.3 else tools), 5) for k in range(400)]
    rows += rows[:30] + [(None, "s1", "2026-01-01 00:00:00", "call", "Read", 1), ("e9", None, "2026-01-01 00:00:00", "call", "Read", 1)]
    df = spark.createDataFrame(rows, EVENT).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("block", F.lit(3)).withColumn("code", F.lit("z"))
    got = [tuple(r) for r in runs.repeated(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_runs(rows)
    c = runs.collapsed(df).agg(F.sum("n_events")).first()[0]
    assert c == len({r[0] for r in rows if r[0] and r[1]})
    assert runs.repeated(df.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.sampled_from([runs.STRICT, runs.LENIENT]))
def test_segmentation_is_optimal(codes, setting):
    weight, penalty = setting

    def cost(cuts):
        return sum(penalty + weight * (hi - lo - max(codes[lo:hi].count(c) for c in codes[lo:hi])) for lo, hi in cuts)

    n = len(codes)
    best = min(cost(list(zip((0, *c), (*c, n)))) for r in range(n) for c in itertools.combinations(range(1, n), r))
    assert abs(cost(runs.segment(codes, [1] * n, weight, penalty)) - best) < 1e-9


def test_lenient_runs_do_not_depend_on_partitions(spark, monkeypatch):
    from anamnesis.plans import ordered

    rng = random.Random(4)
    rows, at = [], 0
    for session, size in (("hot", 500), ("mixed", 200), ("small", 7)):
        tool = "a"
        for _ in range(size):
            tool = tool if rng.random() < 0.6 else rng.choice("abc")
            rows.append((f"e{at:05d}", session, at, "tool", tool, 5))
            at += 1
    rows += [(f"z{k:05d}", "alternating", k, "tool", "ab"[k % 2], 5) for k in range(300)]
    df = spark.createDataFrame(rows, "event_id string, session_id string, t int, kind string, tool_name string, duration_ms long").withColumn("ts", F.timestamp_seconds("t"))
    found = []
    for n in (1, 7, 40):
        monkeypatch.setattr(ordered, "partitions", lambda df, rows, n=n: n)
        found.append(sorted(tuple(r) for r in runs.collapsed(df, *runs.LENIENT).collect()))
    assert found[0] == found[1] == found[2] and sum(r[4] for r in found[0]) == len(rows)
    assert [r[4] for r in found[0] if r[0] == "alternating"] == [1, 299]  # half a penalty cheaper than one run
    monkeypatch.setattr(ordered, "partitions", lambda df, rows: 1)
    codes = [r[4] for r in rows if r[1] == "hot"]
    cost = lambda cuts: sum(1.0 + 1.5 * (hi - lo - max(codes[lo:hi].count(c) for c in "abc")) for lo, hi in cuts)
    ends = list(itertools.accumulate(r[4] for r in sorted(found[0], key=lambda r: r[2]) if r[0] == "hot"))
    assert abs(cost(zip([0, *ends[:-1]], ends)) - cost(runs.segment(codes, [1] * len(codes), 1.5, 1.0))) < 1e-9
