"""Cells of vectors: built without a shuffle, and with nothing lost that has no place among centres."""

from __future__ import annotations

import random
from pathlib import Path

from sparkloom.operators import vector as vec


def rows(n, seed=2, d=5):
    r = random.Random(seed)
    return [(i, [r.gauss(0, 1) for _ in range(d)]) for i in range(n)]


def test_there_are_as_many_files_as_tasks_not_as_cells(spark, tmp_path):
    v = spark.createDataFrame(rows(900), "id long, vector array<double>").repartition(3)
    index = vec.write_cells(v, str(tmp_path / "cells"), 30)
    assert len(list(Path(index.path).rglob("*.parquet"))) == 3 and len(index.centres) > 20
    held = vec.read_cells(spark, index.path).collect()
    assert sorted((r["key"], r["vector"]) for r in held) == rows(900)
    for r in held:
        norm = sum(x * x for x in r["vector"]) ** 0.5
        far = {c: sum((x / norm - y) ** 2 for x, y in zip(r["vector"], centre)) ** 0.5 for c, centre in index.centres.items()}
        assert abs(far[r["cell"]] - min(far.values())) < 1e-9 and abs(far[r["cell"]] - r["far"]) < 1e-9 and r["far"] <= index.radii[r["cell"]]
    #: written in runs sorted by cell, by each task
    assert all(a <= b for f in Path(index.path).rglob("*.parquet") for c in [[r["cell"] for r in spark.read.parquet(str(f)).collect()]] for a, b in zip(c, c[1:]))


def test_centres_are_fitted_on_a_bounded_sample_and_all_are_assigned(spark):
    v = spark.createDataFrame(rows(2000), "key long, vector array<double>")
    found, centres = vec.cells(v, 4, sample=100)
    assert centres.shape == (4, 5) and found.count() == 2000


def test_vectors_without_a_place_are_found_as_by_the_scan(spark, tmp_path):
    odd = [(5000, [float("nan"), 1.0, 1.0, 1.0, 1.0]), (5001, [1e200] * 5), (5002, [1.0] * 4), (5003, None), (5004, [1.0, None, 1.0, 1.0, 1.0]), (5005, [0.0] * 5), (5006, [])]
    v = spark.createDataFrame(rows(400) + odd, "id long, vector array<double>")
    index = vec.write_cells(v, str(tmp_path / "cells"), 8)
    assert index.sizes[vec.APART] == 3 and sum(index.sizes.values()) == 403
    for q in (rows(1)[0][1], [1.0] * 4):
        want = vec.vector_topk(v, q, 10).collect()
        assert [(r["id"], repr(r["score"])) for r in vec.search_cells(spark, index, q, 10)[0].collect()] == [(r["id"], repr(r["score"])) for r in want] and want
    docs = v.where("id % 50 = 0 AND id < 400 OR id = 5002").withColumnRenamed("id", "doc")
    got, want = vec.nearest_by_cells(spark, index, docs, 10)[0], vec.nearest_of_each(docs, v.withColumnRenamed("id", "chunk"), 10).where("score IS NOT NULL")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    only = vec.write_cells(v.where("id = 5000"), str(tmp_path / "only"), 8)
    assert [r["id"] for r in vec.search_cells(spark, only, rows(1)[0][1], 10)[0].collect()] == [5000]
