"""The keyed sink against a dictionary, and which files a change set touches."""

from __future__ import annotations

import json
import os
import random
from pathlib import Path

from pyspark.sql import functions as F

from sparkloom.streaming.sink import KeyedTable, write_changes

SCHEMA, CHANGES = "k string, n long, v string", "k string, n long, v string, op string, at long"


def files(path):
    return {str(p): os.stat(p).st_mtime_ns for p in Path(path).glob("bucket=*/*.parquet")}


def test_change_sets_equal_a_dictionary(spark, tmp_path):
    r, want = random.Random(5), {}
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k", "n"], 8)
    assert table.read().count() == 0 and table.apply(spark.createDataFrame([], CHANGES), [F.desc("at")]) == []
    at = 0
    for round_ in range(6):
        rows = []
        for _ in range(r.choice([1, 12, 40])):
            at += 1
            k, n = r.choice(["a", "b", None, "c"]), r.choice([1, 2, 3, None])
            op = r.choice(["upsert", "upsert", "delete"]) if round_ < 5 else "delete"
            rows.append((k, n, f"v{at}", op, at))
            want.pop((k, n), None)
            if op != "delete":
                want[k, n] = f"v{at}"
        changes = spark.createDataFrame(rows, CHANGES)
        before = files(table.path)
        touched = table.apply(changes, [F.desc("at")])
        assert {(x["k"], x["n"]): x["v"] for x in table.read().collect()} == want and table.read().count() == len(want)
        #: other buckets keep their files
        after = files(table.path)
        other = lambda fs: {p: t for p, t in fs.items() if int(p.split("bucket=")[1].split("/")[0]) not in touched}
        assert other(before) == other(after)
        table.apply(changes, [F.desc("at")])
        assert {(x["k"], x["n"]): x["v"] for x in table.read().collect()} == want
    gone = spark.createDataFrame([(k, n, None, "delete", 0) for k, n in want], CHANGES) if want else spark.createDataFrame([], CHANGES)
    table.apply(gone, [F.desc("at")])
    assert table.read().count() == 0 and files(table.path) == {}


def test_stream_of_changes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batches = [[("a", 1, "x", "upsert", 1), ("b", 2, "y", "upsert", 2)], [("a", 1, "z", "upsert", 3), ("b", 2, None, "delete", 4), ("c", 3, "w", "upsert", 5)], [("a", 1, "q", "upsert", 7), ("a", 1, "old", "upsert", 6)]]
    for i, rows in enumerate(batches):
        name = tmp_path / "in" / f"{i}.json"
        name.write_text("\n".join(json.dumps(dict(zip(("k", "n", "v", "op", "at"), x, strict=True))) for x in rows))
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k", "n"], 4)
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = write_changes(stream, table, [F.desc("at")], str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and sorted(tuple(r) for r in table.read().collect()) == [("a", 1, "q"), ("c", 3, "w")]
