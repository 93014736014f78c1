"""Aggregates kept by change sets against a scan after each of ten random change sets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.incremental import changes
from sparkloom.operators.kept import SIGN, KeptTable, Measure, fold, fold_distinct, signed, state_of

ROWS = "id long, g string, x long, v string"
MEASURES = (Measure("total", "sum", "x"), Measure("low", "min", "x"), Measure("high", "max", "x"), Measure("kinds", "sketch", "v"))


def shown(state):
    return sorted(map(tuple, state.withColumn("kinds", F.hll_sketch_estimate("kinds")).select("g", "n_rows", "total", "total__n", "low", "high", "kinds").collect()), key=str)


def step(r, rows, size):
    """A random change set on a dictionary of rows."""
    new = dict(rows)
    for _ in range(size):
        i = r.randrange(40)
        if r.random() < 0.35:
            new.pop(i, None)
        else:
            new[i] = (i, r.choice(["a", "b", "c", None]), r.choice([None, -3, 0, 1, 7, 7, 9]), r.choice([None, "p", "q", "r"]))
    return new


def frame(spark, rows):
    return spark.createDataFrame(list(rows.values()), ROWS)


def digests(df):
    return df.select("id", F.xxhash64("g", F.coalesce("x", F.lit(-99)), F.coalesce("v", F.lit("none")), F.isnull("g")).alias("h"))


def test_ten_change_sets_equal_a_scan(spark, tmp_path):
    r, rows = random.Random(11), {}
    table = KeptTable(spark, str(tmp_path / "t"), spark.createDataFrame([], ROWS).schema, ["g"], MEASURES, 4)
    for number in range(1, 11):
        new = step(r, rows, r.choice([1, 6, 30])) if number < 10 else {}
        old, now = frame(spark, rows), frame(spark, new)
        moves = signed(old, now, changes(digests(old), digests(now)))
        table.apply(moves, now, number)
        assert shown(table.read()) == shown(state_of(now, ["g"], MEASURES))
        table.apply(moves, now, number)  # again, as after a failure
        assert shown(table.read()) == shown(state_of(now, ["g"], MEASURES))
        rows = new
    assert table.read().count() == 0 and table.apply(moves.limit(0), now, 11) == []


def test_distinct_values_without_reading_rows_again(spark):
    r, rows = random.Random(12), {}
    state = spark.createDataFrame([], "g string, n_rows long")
    values = spark.createDataFrame([], "g string, v string, n_rows long")
    for _ in range(4):
        new = step(r, rows, 15)
        old, now = frame(spark, rows), frame(spark, new)
        state, values = fold_distinct(state, values, signed(old, now, changes(digests(old), digests(now))), ["g"], "v")
        #: as tables, so that plans don't grow
        state, values = (spark.createDataFrame(x.collect(), x.schema) for x in (state, values))
        want = {x["g"]: x["n"] for x in now.groupBy("g").agg(F.count_distinct("v").alias("n")).where("n > 0").collect()}
        assert {x["g"]: x["n_rows"] for x in state.collect()} == want
        rows = new


def test_only_groups_that_lost_their_extreme_are_read_again(spark):
    m = (Measure("high", "max", "x"),)
    old = spark.createDataFrame([(1, "a", 5, None), (2, "a", 3, None), (3, "b", 5, None), (4, "b", 4, None)], ROWS)
    moves = spark.createDataFrame([(1, "a", 5, None, -1), (4, "b", 4, None, -1)], f"{ROWS}, {SIGN} int")
    #: what stands for the rows now is wrong for b on purpose: it must not be asked
    now = spark.createDataFrame([(2, "a", 3, None), (3, "b", 99, None)], ROWS)
    assert sorted(map(tuple, fold(state_of(old, ["g"], m), moves, now, ["g"], m).collect())) == [("a", 1, 3), ("b", 1, 5)]


def test_sums_of_floating_numbers_are_refused(spark):
    with pytest.raises(ValueError, match="floating"):
        state_of(spark.createDataFrame([], "g string, x double"), ["g"], [Measure("s", "sum", "x")])
