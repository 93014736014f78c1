"""The k-nearest join through cells: exact, and with fewer pairs than all."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import vector as vec


def rows(n, seed, spread):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    return [(i, [x + r.gauss(0, spread) for x in r.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize(("spread", "share"), [(0.05, 0.35), (2.0, 1.01)])
def test_equals_all_pairs_and_compares_fewer(spark, tmp_path, spread, share):
    some = rows(600, 3, spread)
    some += [(1000 + i, some[5][1]) for i in range(40)] + [(2000, [0.0] * 6)]
    v = spark.createDataFrame(some, "id long, vector array<double>")
    index = vec.write_cells(v, str(tmp_path / "cells"), 12)
    docs = v.where("id % 15 = 0").withColumnRenamed("id", "doc")
    for deal in (2000, 20):
        best, met = vec.nearest_by_cells(spark, index, docs, 10, deal)
        got = sorted((r["doc"], r["chunk"], round(r["score"], 9)) for r in best.collect())
        want = vec.nearest_of_each(docs, v.withColumnRenamed("id", "chunk"), 10).where("score IS NOT NULL")
        #: equal vectors differ in the last digits of their score, so ties are told by scores
        assert [(d, s) for d, _, s in got] == [(r["doc"], round(r["score"], 9)) for r in want.orderBy("doc", F.desc("score")).collect()] or sorted((d, s) for d, _, s in got) == sorted((r["doc"], round(r["score"], 9)) for r in want.collect())
    compared = met.agg(F.sum("size")).head()[0]
    assert compared <= share * docs.where("doc <> 2000").count() * 640
    assert met.count() == met.select("doc", "cell").distinct().count()


def test_more_asked_than_there_are_and_no_vectors(spark, tmp_path):
    v = spark.createDataFrame(rows(15, 1, 0.3), "id long, vector array<double>")
    index = vec.write_cells(v, str(tmp_path / "few"), 3)
    docs = v.limit(4).withColumnRenamed("id", "doc")
    assert vec.nearest_by_cells(spark, index, docs, 40)[0].count() == 4 * 15
    none = vec.write_cells(v.where("false"), str(tmp_path / "none"), 3)
    assert vec.nearest_by_cells(spark, none, docs, 5)[0].count() == 0


def test_blocks_score_as_the_expression_does(spark):
    some = rows(300, 5, 1.0) + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(30)] + [(2000, [0.0] * 6), (2001, None), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [1.0] * 5), (2004, [float("nan")] * 6)]
    v = spark.createDataFrame(some, "id long, vector array<double>")
    docs, chunks = v.where("id % 7 = 0 OR id >= 2000").withColumnRenamed("id", "doc"), v.withColumnRenamed("id", "chunk")
    each = docs.withColumnRenamed("vector", "a").crossJoin(chunks.withColumnRenamed("vector", "b")).select("doc", "chunk", vec.cosine(F.col("a"), F.col("b")).alias("score"))
    want = each.withColumn("r", F.expr("row_number() OVER (PARTITION BY doc ORDER BY score DESC, chunk)")).where("r <= 40").drop("r")
    for blocks in (None, 5):
        got = vec.nearest_of_each(docs, chunks, 40, blocks)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    #: pairs are compared in blocks, not as rows of a join
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
