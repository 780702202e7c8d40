import json
import os

import pytest
from pyspark.sql import functions as F

from anamnesis.plans import ordered, scratch
from anamnesis.sources import archive, transcripts
from anamnesis.streaming import exactly_once, ingest

ROW = "id string, ts timestamp, got int, body string, n long, row string"


def deliver(spark, path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame([(i, None if t is None else f"2026-01-{t:02d} 00:00:00", g, b, 1, "clash") for i, t, g, b in rows], "id string, ts string, got int, body string, n long, row string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"file://{path}/t.parquet")
        os.utime(path)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_every_identifier_once_however_late(spark, folder):
    batches = [
        [("a", 1, 1, "first"), ("a", 1, 2, "second"), ("b", 1, 1, "b"), (None, 1, 1, "no id")],
        [("c", 20, 3, "c"), ("b", 20, 3, "again, another time")],
        [("a", 25, 9, "late copy of an expired one"), ("d", 1, 9, "late but new"), ("e", None, 9, "no time"), ("e", None, 9, "no time")],
    ]
    deliver(spark, folder, batches)
    got = exactly_once.run(spark, f"file://{folder}/t.parquet", ["id"], "ts", ["got"], ["body", "n", "row"], files_per_batch=1, delay="2 days")
    kept = got.kept.collect()
    assert sorted(r["id"] for r in kept) == ["a", "b", "c", "d", "e"]
    assert len(got.epochs) >= 3
    assert {r["id"]: r["n"] for r in got.suppressed.groupBy("id").agg(F.sum("n").alias("n")).collect()} == {"a": 2, "b": 1, "e": 1}
    again = exactly_once.run(spark, f"file://{folder}/t.parquet", ["id"], "ts", ["got"], ["body", "n", "row"], path=got.path, files_per_batch=1, delay="2 days")
    assert again.kept.count() == 5  # nothing is taken in twice


def test_a_replayed_batch_changes_nothing(spark, folder):
    store = exactly_once.SeenStore(spark, f"file://{folder}/store", ["id"], "id string")
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, got int").select("id", F.timestamp_seconds("got").alias("event_time"), F.struct("got", "id").alias("row"))
    for _ in range(2):
        store.step(batch, 0)
    store.step(batch, 1)
    d = exactly_once.Delivered(spark, store.path, store.committed(), "got int, id string", "id string")
    assert d.epochs == [0, 1] and d.kept.count() == 2 and d.suppressed.agg(F.sum("n")).first()[0] == 4


def test_a_stored_table_is_replayed_in_several_epochs(spark, folder):
    rows = [(f"i{k % 97}", k % 28 + 1, k, f"b{k}") for k in range(400)] + [("i3", None, None, "no delivery time")]
    deliver(spark, folder, [rows])
    got = exactly_once.run(spark, f"file://{folder}/t.parquet", ["id"], "ts", ["got"], ["body"], slices=4, delay="1 day")
    assert len(got.epochs) == 4
    kept = {r["id"]: r["body"] for r in got.kept.collect()}
    assert got.kept.count() == 97 and kept["i0"] == "b0" and kept["i96"] == "b96" and kept["i3"] == "no delivery time"
    assert got.suppressed.agg(F.sum("n")).first()[0] == len(rows) - 97


def test_archive_parts_are_merged(spark, folder):
    store = exactly_once.SeenStore(spark, f"file://{folder}/store", ["id"], "id string", "1 second")
    for e in range(9):
        batch = spark.createDataFrame([(f"{e}-{k}", e * 100) for k in range(5)] + [("0-0", 0)], "id string, got int")
        store.step(batch.select("id", F.timestamp_seconds("got").alias("event_time"), F.struct("got", "id").alias("row")), e)
    assert len(store.state()["archive"]) <= 5 and len(os.listdir(f"{folder}/store/commits")) <= 4  # names and checksums
    d = exactly_once.Delivered(spark, store.path, store.committed(), "got int, id string", "id string")
    assert d.kept.count() == 45 and d.suppressed.agg(F.sum("n")).first()[0] == 9


def test_stored_queries_take_several_epochs(spark, sf):
    assert len(exactly_once.raw_observations(spark, sf).epochs) >= 3
    assert len(exactly_once.transcript_rows(spark, sf).epochs) >= 3


def test_nothing_delivered(spark, folder):
    deliver(spark, folder, [[]])
    d = exactly_once.run(spark, f"file://{folder}/t.parquet", ["id"], "ts", ["got"])
    assert d.kept.count() == 0 and d.suppressed.count() == 0


def test_streams(spark, folder):
    rows = [("s", "Read", '{"a": 1}', 1), ("s", "Read", '{"a": 1}', 60), ("s", "Bash", None, 90), ("t", "Read", '{"a": 1}', 100)]
    df = spark.createDataFrame(rows, "session_id string, tool_name string, tool_input string, at int")
    df = df.select(F.monotonically_increasing_id().cast("string").alias("obs_id"), "session_id", "tool_name", "tool_input", F.timestamp_seconds("at").alias("ts"), *(F.lit(None).cast("string").alias(c) for c in ("hook_type", "tool_output", "user_prompt", "assistant_response", "agent_id")))
    df.coalesce(1).write.parquet(f"file://{folder}/raw")
    raw = lambda: ingest.source(spark, f"file://{folder}/raw")
    out = lambda name, s: (ingest.run_available(s, f"file://{folder}/{name}", f"file://{folder}/{name}-c"), spark.read.schema(s.schema).parquet(f"file://{folder}/{name}"))[1]
    assert out("once", ingest.once_within(raw()).drop("dedup_key")).count() == 3
    assert {r["type"] for r in out("obs", ingest.observations(raw())).collect()} == {"file_read", "command_run"}
    assert out("cool", ingest.cooled(raw().select("session_id", "ts"), "session_id", "ts", 80)).count() == 3
    assert out("win", ingest.windowed(raw(), "ts", ["session_id"], "1 minute", "0 seconds")).schema.names == ["started", "session_id", "n"]


def test_transcripts_skip_malformed_lines(spark, folder):
    os.makedirs(f"{folder}/deep/er")
    good = {"type": "user", "uuid": "u1", "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": "hi"}}
    tool = {"type": "assistant", "uuid": "u2", "sessionId": "s", "message": {"role": "assistant", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"p": 1}}]}}
    fail = {"type": "user", "uuid": "u3", "sessionId": "s", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "bad", "is_error": True}]}}
    with open(f"{folder}/deep/er/x.jsonl", "w") as f:
        f.write("\n".join([json.dumps(good), "{not json", json.dumps(tool), "", json.dumps(fail)]))
    rows = transcripts.lines(spark, f"file://{folder}")
    assert rows.count() == 3
    o = transcripts.observations(rows).orderBy("uuid", "place").collect()
    assert [(r["hook_type"], r["tool_use_id"]) for r in o] == [("prompt_submit", None), ("stop", None), ("pre_tool_use", "t1"), ("post_tool_failure", "t1")]


def test_import_strategies_snapshots_and_notes(spark, folder):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "memory_id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "memory_id string, v int")
    as_dict = lambda df: {r[0]: r[1] for r in df.collect()}
    assert as_dict(archive.imported(old, new, "memory_id", "merge")) == {"a": 1, "b": 2, "c": 2}
    assert as_dict(archive.imported(old, new, "memory_id", "skip")) == {"a": 1, "b": 1, "c": 2}
    assert as_dict(archive.imported(old, new, "memory_id", "replace")) == {"b": 2, "c": 2}
    with pytest.raises(ValueError):
        archive.imported(old, new, "memory_id", "other")
    archive.snapshot({"m": old}, f"file://{folder}/snap", "1")
    assert as_dict(archive.restored(spark, new, f"file://{folder}/snap", "m", "1", "memory_id").select("memory_id", "v")) == {"a": 1, "b": 1, "c": 2}
    page, more = archive.paged(old, ["memory_id"], 0, 1)
    assert page.count() == 1 and more
    text = spark.createDataFrame([("x", "# T\n\n## One\nbody\nmore\n## Two\nend")], "k string, t string")
    assert [(r["heading"], r["body"]) for r in archive.sections(text, "k", "t").orderBy("place").collect()][1:] == [("One", "body\nmore"), ("Two", "end")]
    with open(f"{folder}/g.json", "w") as f:
        json.dump({"nodes": [{"id": "a", "type": "t", "name": "A"}, {"id": "b"}, {"id": None}], "edges": [{"source": "a", "target": "b"}, {"source": "a", "target": "nowhere"}]}, f)
    nodes, edges = archive.graph_document(spark, f"file://{folder}/g.json")
    assert nodes.count() == 2 and edges.count() == 1


def test_scratch_lies_in_the_shared_folder_the_session_names(spark, folder):
    class Session:
        class conf:
            @staticmethod
            def get(name, default=None):
                return f"file://{folder}/shared/" if name == "spark.checkpoint.dir" else default

    assert scratch.base_dir(Session) == f"file://{folder}/shared"
    assert scratch.written(spark.range(3), "x").count() == 3
    assert ordered.partitions(spark.range(1), 1) == 1
