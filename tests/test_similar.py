"""Set-similarity join against all pairs, and what it compares."""

from __future__ import annotations

import random

import pytest

from sparkloom.operators import rules, similar


def sets(n, seed, words=40, most=14):
    r = random.Random(seed)
    base = [r.sample(range(words), r.randint(1, most)) for _ in range(n // 3)]
    out = []
    for i in range(n):
        s = set(r.choice(base))
        for _ in range(r.randint(0, 3)):
            s ^= {r.randrange(words)}
        out.append((i, [f"t{x}" for x in s]))
    return out


def frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, items array<string>")


def wanted(left, right, least):
    return {(a, b, round(len(set(x) & set(y)) / len(set(x) | set(y)), 9)) for a, x in left for b, y in right if x and y and len(set(x) & set(y)) >= least * len(set(x) | set(y)) - 1e-9}


@pytest.mark.parametrize("least", [0.2, 0.5, 0.75, 1.0])
def test_equals_all_pairs(spark, least):
    left, right = sets(90, 1), sets(150, 2)
    for deal in (similar.DEAL, 3):
        rows = similar.similar_pairs(frame(spark, left, "a"), frame(spark, right, "b"), least, deal=deal).collect()
        assert len(rows) == len({(r["a"], r["b"]) for r in rows})
        assert {(r["a"], r["b"], round(r["similarity"], 9)) for r in rows} == wanted(left, right, least)


def test_edges(spark):
    left = [(1, []), (2, None), (3, ["x", "x", None, "y"]), (3, ["x", "y"]), (None, ["x"]), (4, ["zz"])]
    right = [(1, ["x", "y"]), (2, []), (3, None), (None, ["x", "y"]), (1, ["x", "y"])]
    rows = similar.similar_pairs(frame(spark, left, "a"), frame(spark, right, "b"), 0.6).collect()
    assert {(r["a"], r["b"], r["similarity"]) for r in rows} == {(3, 1, 1.0)}
    assert similar.similar_pairs(frame(spark, [], "a"), frame(spark, right, "b"), 0.6).count() == 0
    with pytest.raises(ValueError):
        similar.similar_pairs(frame(spark, left, "a"), frame(spark, right, "b"), 0)


def test_a_common_item_is_hardly_posted(spark):
    """An item of every set stands last, so no prefix of a large threshold holds it: sets that share it alone never meet."""
    right = [(i, ["common", *(f"r{i}_{j}" for j in range(9))]) for i in range(400)]
    left = [(i, ["common", *(f"r{i}_{j}" for j in range(8)), "other"]) for i in range(0, 400, 4)]
    order = spark.createDataFrame([(x, 1) for _, s in right for x in s], "item string, f int").groupBy("item").count().withColumnRenamed("count", "f")
    posted = similar._posted(similar._ordered(frame(spark, right, "b").withColumnRenamed("b", "key"), order), 0.6, "r", "nr", "ar")
    assert posted.where("item = 'common'").count() == 0 and posted.count() == 400 * 5
    rows = similar.similar_pairs(frame(spark, left, "a"), frame(spark, right, "b"), 0.6).collect()
    assert sorted((r["a"], r["b"]) for r in rows) == [(i, i) for i in range(0, 400, 4)]


def test_paths_are_suggested(spark):
    files = spark.createDataFrame([("src/auth/login.py",), ("src/auth/logout.py",), ("src/db/pool.py",), ("README.md",), ("docs/README.md",)], "path string")
    refs = spark.createDataFrame([("src/auth/logn.py",), ("src/auth/login.py",), ("auth/logout.py",), ("qqq.zz",), ("README.md",), ("readme.md",), ("src/auth/logn.py",)], "ref string")
    got = {r["ref"]: (r["how"], r["path"]) for r in rules.resolve_paths(refs, files).collect()}
    assert got == {"src/auth/logn.py": ("similar", "src/auth/login.py"), "src/auth/login.py": ("exact", "src/auth/login.py"), "auth/logout.py": ("suffix", "src/auth/logout.py"), "qqq.zz": ("missing", None), "README.md": ("exact", "README.md"), "readme.md": ("similar", "README.md")}
    strict = {r["ref"]: r["how"] for r in rules.resolve_paths(refs, files, suggest_at=0.95).collect()}
    assert strict["src/auth/logn.py"] == "missing" and strict["readme.md"] == "similar"


def test_nothing_is_broadcast_and_pairs_are_not_shuffled(spark):
    """No side of the join has a bound, and the pairs are far more than the sets."""
    rows = similar.similar_pairs(frame(spark, sets(60, 1), "a"), frame(spark, sets(60, 2), "b"), 0.2)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "BroadcastHashJoin" not in plan
    assert not any("Aggregate" in line for line in plan.split("SortMergeJoin")[0].splitlines())


def test_items_of_one_side_are_not_posted(spark):
    """What only one side has can't be shared: it shortens the prefix, as the rest must hold all that a pair shares."""
    left = [(i, [*(f"l{j}" for j in range(5)), *(f"s{(i + j) % 40}" for j in range(6))]) for i in range(40)]
    right = [(i, [*(f"r{j}" for j in range(5)), *(f"s{(i + j) % 40}" for j in range(6))]) for i in range(40)]
    placed = similar.in_order(frame(spark, left, "a"), frame(spark, right, "b"), "a", "b")
    for df, key in zip(placed, "ab", strict=True):
        assert {(r["n"], len(r["places"])) for r in df.collect()} == {(11, 6)}
        assert similar._met(df, 0.35, key, "k", "n", "rest", "all").count() == 40 * 3  # 4 of 11 at least
    rows = similar.similar_pairs(frame(spark, left, "a"), frame(spark, right, "b"), 0.35).collect()
    assert {(r["a"], r["b"], round(r["similarity"], 9)) for r in rows} == wanted(left, right, 0.35)


def test_many_items_are_met_in_a_join(spark, monkeypatch):
    left, right = sets(60, 5), sets(90, 6)
    monkeypatch.setattr(similar, "VOCABULARY", 0)
    monkeypatch.setattr(similar, "PART", 3)
    rows = similar.similar_pairs(frame(spark, left, "a"), frame(spark, right, "b"), 0.4).collect()
    assert len(rows) == len({(r["a"], r["b"]) for r in rows})
    assert {(r["a"], r["b"], round(r["similarity"], 9)) for r in rows} == wanted(left, right, 0.4)


def test_the_best_of_a_block_goes_on_alone(spark):
    """Only the best of each left set leaves a block, ties by the right key, and needless steps are left out."""
    left, right = sets(30, 7), sets(80, 8)
    pairs = similar.similar_pairs(frame(spark, left, "a"), frame(spark, right, "b"), 0.2, "a", "b", "items", similar.DEAL, False, True).collect()
    best = {}
    for r in pairs:
        best[r["a"]] = min(best.get(r["a"], (1, 0)), (-round(r["similarity"], 9), r["b"]))
    want = {}
    for a, b, s in wanted(left, right, 0.2):
        want[a] = min(want.get(a, (1, 0)), (-s, b))
    assert best == want and len(pairs) < len(wanted(left, right, 0.2))


def test_steps_that_can_find_nothing_are_left_out(spark, monkeypatch):
    seen, pairs = [], similar.similar_pairs
    monkeypatch.setattr(similar, "similar_pairs", lambda left, right, least, *names: seen.append(least) or pairs(left, right, least, *names))
    asked = spark.createDataFrame([("gone/1234.md",), ("gone/7777.md",)], "a string")
    known = spark.createDataFrame([(f"src1/en/{i}.md",) for i in (1234, 1235, 7777, 9)], "b string")
    got = {(r["a"], r["b"], round(r["similarity"], 6)) for r in similar.most_similar(asked, known, 0.3).collect()}
    assert got == {("gone/1234.md", "src1/en/1234.md", 0.380952), ("gone/7777.md", "src1/en/7777.md", 0.35)}
    assert max(seen) < 0.5
