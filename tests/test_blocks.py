"""Running sums by blocks and the interval join by bins, against windows and all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph
from sparkloom.plans import listings


def spans(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice(["hot", "hot", "hot", "b", None]), r.randint(0, 5), r.choice([None, 0, 1, 5, 40])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g string, p int, n long").repartition(5)


@pytest.mark.parametrize("partition", [[], ["g"]])
@pytest.mark.parametrize("blocks", [1, 7])
@pytest.mark.parametrize("before", [False, True])
def test_running_blocks_equal_the_window(spark, partition, blocks, before):
    df, order = spans(spark), [F.desc("p"), "id"]
    got = {r["id"]: r["spent"] for r in graph.running_blocks(df, F.col("n"), partition, order, before, blocks).collect()}
    want = {r["id"]: r["spent"] for r in df.withColumn("spent", graph.running(F.col("n"), partition, order, before)).collect()}
    assert got == want


@pytest.mark.parametrize("partition", [[], ["g"]])
def test_packing_by_blocks(spark, partition):
    df, order = spans(spark, 200, 2).fillna(3, ["n"]), ["p", "id"]
    for budget in (0, 50, 700, 10**9):
        for one, other in ((graph.pack_within, graph.pack_within_blocks), (graph.pack_crossing, graph.pack_crossing_blocks)):
            a = sorted((r["id"], r["spent"]) for r in one(df, budget, F.col("n"), partition, order).collect())
            assert sorted((r["id"], r["spent"]) for r in other(df, budget, F.col("n"), partition, order, blocks=6).collect()) == a
    assert graph.pack_within_blocks(df.where("false"), 5, F.col("n"), partition, order).count() == 0


def test_evidence_is_packed_without_a_single_task(spark, sf_dir):
    plan = listings.claim_evidence(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan


@pytest.mark.parametrize("width", [1, 3, 50])
def test_overlapping_equals_all_pairs(spark, width):
    r = random.Random(width)
    make = lambda n: [(i, r.choice(["f", "f", "g", None]), b, b + r.choice([-1, 0, 1, 7, 60])) for i, b in enumerate(r.randint(-40, 60) for _ in range(n))] + [(n, "f", None, 3), (n + 1, "f", 3, None)]
    left, right = make(60), make(70)
    frame = lambda rows: spark.createDataFrame(rows, "id long, k string, begin int, end int")
    got = [(x["l"]["id"], x["r"]["id"]) for x in graph.overlapping(frame(left), frame(right), ["k"], width).collect()]
    whole = lambda rows: [x for x in rows if None not in x and x[2] <= x[3]]
    want = sorted((a[0], b[0]) for a in whole(left) for b in whole(right) if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    assert sorted(got) == want and len(got) == len(set(got))
    assert graph.overlapping(frame([]), frame(right), ["k"], width).count() == 0
