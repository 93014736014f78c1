"""Steps whose rows are bounded before they meet."""

from __future__ import annotations

import random

from sparkloom.operators import graph
from sparkloom.plans import listings


def test_call_flows_equal_walks_and_expand_no_finished_entry(spark):
    r = random.Random(1)
    edges = [(a, r.randrange(40)) for a in range(30) for _ in range(r.choice((1, 2, 60)))]
    df, entries = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(n,) for n in range(30)], "node long")
    of: dict = {}
    for a, b in edges:
        of.setdefault(a, set()).add(b)
    for k in (3, 20):
        want = []
        for n in range(30):
            step, rows = {n}, []
            for depth in (1, 2, 3):
                step = set().union(*(of.get(x, set()) for x in step))
                rows += [(n, x, depth) for x in sorted(step)]
            want += rows[:k]
        got = graph.call_flows(df, entries, 3, k)
        assert sorted(map(tuple, got.select("node", "callee", "depth").collect())) == sorted(want)


def test_neighbours_are_cut_before_they_are_shuffled(spark):
    edges = spark.createDataFrame([(1, x % 9) for x in range(500)] + [(x % 9, 1) for x in range(500)], "src long, dst long")
    got = graph.neighbours_of_each(edges, spark.createDataFrame([(1,)], "node long"), 3)
    assert sorted(map(tuple, got.collect())) == sorted((1, side, x) for side in ("callee", "caller") for x in (0, 1, 2))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("WindowGroupLimit") and plan.count("Aggregate") == 1


def test_each_spelling_is_matched_once(spark, sf_dir):
    plan = listings.sequence_match(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" in plan.split("MapInPandas")[1]


def test_sections_go_out_by_parts_of_a_batch(spark, monkeypatch):
    import pandas as pd

    from sparkloom.sources import extract

    caught = []
    docs = spark.createDataFrame([(i, "x" * 600_000) for i in range(6)], "id long, content string")
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, f, schema: caught.append(f))
    extract.sections_of(docs, lambda x: [("h", 1, "text", x)])
    frame = pd.DataFrame([(i, "x" * 600_000) for i in range(6)], columns=["id", "content"])
    parts = list(caught[0](iter([frame])))
    assert [len(p) for p in parts] == [2, 2, 2] and [k for p in parts for k in p["id"]] == list(range(6))


def test_high_similarities_are_looked_for_first(spark, monkeypatch):
    from sparkloom.operators import similar

    seen, pairs = [], similar.similar_pairs
    monkeypatch.setattr(similar, "similar_pairs", lambda left, right, least, *names: seen.append((least, left.count())) or pairs(left, right, least, *names))
    asked = spark.createDataFrame([("supplier alpha",), ("supplier betax",), ("zq",)], "a string")
    known = spark.createDataFrame([("supplier alpha.",), ("supplier beta",)], "b string")
    got = {(r["a"], r["b"]) for r in similar.most_similar(asked, known, 0.3).collect()}
    assert got == {("supplier alpha", "supplier alpha."), ("supplier betax", "supplier beta")}
    assert seen[0] == (0.9, 3) and seen[-1] == (0.3, 1)
