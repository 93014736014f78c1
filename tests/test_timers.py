"""Streams with timers: what is flushed, released and forgotten, by event time."""

from __future__ import annotations

import json
import os

import pytest

from sparkloom.streaming import timers


@pytest.fixture(autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    timers.use_rocksdb(spark)
    yield
    spark.conf.set(key, before)


def run(spark, tmp_path, schema, batches, make):
    """One file a batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    q = make(events).writeStream.format("memory").queryName(tmp_path.name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(tmp_path.name).collect(), q.lastProgress


def at(s):
    return f"2024-01-01T00:{int(s) // 60:02d}:{int(s) % 60:02d}.{int(s * 1000) % 1000:03d}Z"


def test_quiet_paths(spark, tmp_path):
    e = lambda p, o, s: {"path": p, "op": o, "ts": at(s)}
    batches = [[e("a", "create", 0), e("a", "modify", 0.3), e("b", "create", 0.1)], [e("a", "delete", 0.7), e("b", "modify", 9)], [e("z", "create", 100)], [e("a", "create", 101), e("z", "modify", 200)]]
    got, last = run(spark, tmp_path, "path string, op string, ts timestamp", batches, lambda df: timers.quiet_paths(df, 500, "1 second"))
    base = 1704067200000
    rows = sorted((r["path"], r["op"], r["start"] - base, r["at"] - base, r["n"]) for r in got)
    assert rows[:3] == [("a", "create", 101_000, 101_000, 1), ("a", "delete", 0, 700, 3), ("b", "create", 100, 100, 1)]
    assert rows[3:] == [("b", "modify", 9000, 9000, 1), ("z", "create", 100_000, 100_000, 1)]  # the last change of z isn't quiet yet
    assert last.stateOperators[0].numRowsTotal <= 6  # values and timers of the one open path, not of all that came


def test_quiet_repositories(spark, tmp_path):
    e = lambda r, p, s: {"repo": r, "path": p, "kind": "doc" if p.endswith("md") else "code", "ts": at(s)}
    batches = [[e("r", "a.py", 0), e("r", "b.py", 1), e("r", "x.md", 1.5), e("q", "c.py", 0)], [e("r", "a.py", 2.5), e("q", "c.py", 1)], [e("z", "z.py", 60)], [e("r", "a.py", 61)], [e("z", "z.py", 120)]]
    got, _ = run(spark, tmp_path, "repo string, path string, kind string, ts timestamp", batches, lambda df: timers.quiet_repositories(df, 2000, "1 second"))
    assert sorted((r["repo"], r["job"], r["paths"]) for r in got) == [("q", "REINDEX_FILE", ["c.py"]), ("r", "DOCS_SCAN", ["x.md"]), ("r", "REINDEX_FILE", ["a.py"]), ("r", "REINDEX_MANY", ["a.py", "b.py"]), ("z", "REINDEX_FILE", ["z.py"])]


def test_claims_are_released_and_finished_jobs_forgotten(spark, tmp_path):
    e = lambda i, o, s: {"id": i, "op": o, "ts": at(s)}
    batches = [
        [e(1, "claim", 0), e(2, "claim", 0), e(3, "claim", 1), e(3, "fail", 2)],
        [e(2, "complete", 10), e(9, "claim", 20)],
        [e(9, "complete", 21), e(1, "complete", 100), e(8, "claim", 100)],  # too late for 1: its claim ran out at 60
        [e(1, "claim", 101), e(8, "complete", 102)],
        [e(8, "claim", 400)],
        [e(2, "claim", 401)],  # forgotten, so it begins anew
        [e(8, "claim", 900)],
    ]
    got, last = run(spark, tmp_path, "id long, op string, ts timestamp", batches, lambda df: timers.claimed_jobs(df, 60_000, 2, 120_000, "1 second"))
    base = 1704067200000
    by = {}
    for r in sorted(got, key=lambda r: (r["id"], r["at"])):
        by.setdefault(r["id"], []).append((r["status"], r["attempts"], (r["at"] - base) // 1000, r["why"]))
    assert by[1] == [("CLAIMED", 1, 0, "claim"), ("PENDING", 1, 60, "released"), ("CLAIMED", 2, 101, "claim"), ("FAILED", 2, 161, "released")]
    assert by[2] == [("CLAIMED", 1, 0, "claim"), ("DONE", 1, 10, "complete"), ("CLAIMED", 1, 401, "claim"), ("PENDING", 1, 461, "released")]
    assert by[3] == [("CLAIMED", 1, 1, "claim"), ("PENDING", 1, 2, "fail")]
    assert by[9] == [("CLAIMED", 1, 20, "claim"), ("DONE", 1, 21, "complete")]
    assert [x[0] for x in by[8]][:2] == ["CLAIMED", "DONE"]


def test_first_jobs_by_time_to_live(spark, tmp_path):
    k = lambda *keys: [{"dedup_key": x} for x in keys]
    got, _ = run(spark, tmp_path, "dedup_key string", [k("a", "a", "b"), k("a", "c"), k("b")], lambda df: timers.first_jobs(df, 600_000))
    assert sorted(r["dedup_key"] for r in got) == ["a", "b", "c"]
