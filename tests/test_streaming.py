"""The streaming forms give the batch forms' results."""

from __future__ import annotations

import json

from sparkloom.streaming import queue


def _run(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_debounced_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("a.py", "create", "2024-01-01T00:00:00Z"), ("a.py", "delete", "2024-01-01T00:00:01Z"), ("b.py", "create", "2024-01-01T00:01:00Z")]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"path": p, "op": o, "ts": t}) for p, o, t in rows))
    got = _run(queue.debounced(queue.relevant(queue.read_events(spark, str(tmp_path / "in")))), tmp_path, "debounced", "append")
    assert [(r["path"], r["op"], r["n"]) for r in got] == [("a.py", "delete", 2)]  # b.py isn't quiet yet


def test_job_states(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [(1, i, op) for i, op in enumerate(["claim", "fail", "claim", "complete"])] + [(2, 0, "claim")]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"id": a, "at": b, "op": c}) for a, b, c in rows))
    got = _run(queue.job_states(queue.read_events(spark, str(tmp_path / "in"), "id long, at long, op string")), tmp_path, "states", "update")
    assert sorted((r["id"], r["status"], r["attempts"]) for r in got) == [(1, "DONE", 2), (2, "CLAIMED", 1)]


def test_dedup_jobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("k", "2024-01-01T00:00:00Z"), ("k", "2024-01-01T00:00:05Z"), ("m", "2024-01-01T00:00:06Z")]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"dedup_key": k, "ts": t}) for k, t in rows))
    got = _run(queue.dedup_jobs(queue.read_events(spark, str(tmp_path / "in"), "dedup_key string, ts timestamp")), tmp_path, "deduped", "append")
    assert sorted(r["dedup_key"] for r in got) == ["k", "m"]
