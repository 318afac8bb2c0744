"""Sources, sinks and streams on small files."""

import json

import pyarrow as pa
import pytest

from tidemark.operators import feed
from tidemark.sources import catalog as C
from tidemark.streaming import changes as S


def test_catalog(spark, tmp_path):
    rec = lambda c, n, s="ready": {"chunk_id": c, "length": n, "digest": "d", "state": s}
    lines = [{"revision": 1, "records": [rec("a", 1), rec("b", 2)]}, {"revision": 2, "records": [rec("a", 5), rec("a", 6)]}, {"revision": 4, "records": []}]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = {r.chunk_id: (r.length, r.revision) for r in C.read_catalog(spark, str(tmp_path / "c.jsonl")).collect()}
    assert got == {"a": (6, 2), "b": (2, 1)}
    assert [tuple(r) for r in C.catalog_gaps(spark, str(tmp_path / "c.jsonl")).collect()] == [(4, 2)]
    good = spark.createDataFrame([(7, [("a", 9, "d", "ready")])], "revision long, records array<struct<chunk_id:string,length:bigint,digest:string,state:string>>")
    C.write_catalog(good, str(tmp_path / "good"))
    assert C.read_catalog(spark, str(tmp_path / "good")).first().length == 9
    [line] = [x for part in (tmp_path / "good").glob("*.json") for x in [part.read_text()] if x]
    (tmp_path / "bad.jsonl").write_text(line.replace('"length":9', '"length":8'))
    with pytest.raises(Exception, match="checksum of revision 7"):
        C.read_catalog(spark, str(tmp_path / "bad.jsonl")).collect()


def test_snapshot(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"schema_version": 1, "revision": 9, "entities": [{"kind": "inode", "id": "1", "revision": 3}]}))
    assert [tuple(r) for r in C.read_snapshot(spark, str(tmp_path / "s.json")).collect()] == [(9, "inode", "1", 3)]
    (tmp_path / "t.json").write_text(json.dumps({"schema_version": 2, "revision": 9, "entities": []}))
    with pytest.raises(Exception, match="schema version 2"):
        C.read_snapshot(spark, str(tmp_path / "t.json")).collect()


def test_metrics(spark, tmp_path):
    (tmp_path / "m.txt").write_text('# HELP x\nops_total{op="read"} 12\n\nup 1\nload 0.5\nbig 1e5\ntop +Inf\n')
    got = C.read_metrics(spark, str(tmp_path / "m.txt"))
    assert sorted(map(tuple, got.collect())) == [("big", "", 1e5), ("load", "", 0.5), ("ops_total", 'op="read"', 12.0), ("top", "", float("inf")), ("up", "", 1.0)]
    C.write_metrics(got, str(tmp_path / "out"))
    assert sorted(map(tuple, C.read_metrics(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, got.collect()))


def test_files_and_frames(spark, tmp_path):
    d = tmp_path / "chunks"
    d.mkdir()
    for name, size in (("a", 4), ("b", 1), ("z", 3)):
        (d / name).write_bytes(b"x" * size)
    want = spark.createDataFrame([("a", 4), ("b", 2), ("m", 1)], "chunk_id string, length long")
    assert dict(map(tuple, C.reconcile_files(want, C.list_files(spark, str(d))).collect())) == {"a": "whole", "b": "truncated", "m": "missing", "z": "orphan"}
    log = C.frame(1, b"one") + C.frame(2, b"") + C.frame(3, b"torn")[:-1]
    (tmp_path / "log").write_bytes(log)
    assert [(r.revision, bytes(r.body)) for r in C.read_frames(spark, str(tmp_path / "log")).collect()] == [(1, b"one"), (2, b"")]


def test_logs_are_framed_and_read_in_pieces(spark):
    rows = [(f"log{k % 3}", k, f"{k}é".encode() * (k % 40), k == 1501) for k in range(3000)] + [("none", 7, b"", False)]
    logs = C.as_logs(spark.createDataFrame(rows, "path string, revision long, body binary, damaged boolean"))
    for path, content in logs.collect():
        frames = [C.frame(k, body)[: -1 if bad else None] + (b"?" if bad else b"") for p, k, body, bad in rows if p == path]
        assert bytes(content) == b"".join(frames)
    want = sorted((p, k, body) for p, k, body, _ in rows if p != "log1" or k < 1501)
    assert sorted((r.file, r.revision, bytes(r.body)) for r in C.frames_of(logs).collect()) == want
    whole = pa.RecordBatch.from_pylist([{"path": "a", "content": b"".join(C.frame(k, b"x") for k in range(1000))}] * 2)
    assert [b.num_rows for b in C.read_pieces([whole], most=300)] == [300] * 6 + [200]
    assert [b.num_rows for b in C.read_pieces([whole], most_bytes=900)] == [900, 900, 200]
    with pytest.raises(Exception, match="a frame needs a version and a body"):
        C.as_logs(spark.createDataFrame([("a", 1, None, False)], "path string, revision long, body binary, damaged boolean")).collect()


def events(spark):
    rows = [(i, f"2024-01-01 {i // 12:02d}:{i % 12 * 5:02d}:00", i % 4, ("view", "click", "error")[i * 7 % 3], float(i), "{}") for i in range(60)]
    return spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "CAST(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props")


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    e = events(spark)
    for k in range(3):
        e.filter(f"event_id >= {20 * k} AND event_id < {20 * k + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = S.source(spark, str(tmp_path / "in"))
    last = {r.key: (r.revision, r.event_index, r.kind) for r in run(S.running_state(S.changes(src)), "t_state", "complete").collect()}
    batch = S.changes(e.withColumn("ts", e.ts.cast("timestamp")))
    kept = {r.key: (r.revision, r.event_index) for r in feed.state(batch.drop("ts")).collect()}
    assert {k: v[:2] for k, v in last.items() if v[2] != "delete"} == kept
    counted = {(str(r.start), r.event_type): r.n for r in run(S.windowed(src), "t_win", "append").collect()}
    want = {}
    for r in e.collect():  # 60 events, 5 minutes apart, to 04:55; windows that end by 04:45 are closed
        if r.ts.hour < 4:
            key = (r.ts.strftime("%Y-%m-%d %H:00:00"), r.event_type)
            want[key] = want.get(key, 0) + 1
    assert counted == want
    assert run(S.deduplicated(src), "t_dup", "append").count() == 60


def test_session_epochs_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = events(spark)
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(S.session_epochs(S.source(spark, str(tmp_path / "in"))), "t_epoch", "append")
    want = feed.session_epochs(e.selectExpr("user_id AS node", "event_id", "event_type AS session"), "node", "session", "event_id")
    assert sorted(map(tuple, got.select("node", "event_id", "session", "epoch").collect())) == sorted(map(tuple, want.select("node", "event_id", "session", "epoch").collect()))
