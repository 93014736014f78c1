from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.llm.common import join_hot


def test_hot_keys_need_no_join_of_their_own(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 5000).cast("int").alias("key"), F.col("id").alias("v"))
    right = left.groupBy(F.col("key").cast("long").alias("key")).agg(F.count("*").alias("__n"), F.max("v").alias("top"))
    out = join_hot(left, right, ["key"], F.col("v"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "LeftOuter" not in plan
    want = left.join(right.drop("__n").withColumn("key", F.col("key").cast("int")), "key")
    assert sorted(map(tuple, out.select("key", "v", "top").collect())) == sorted(map(tuple, want.select("key", "v", "top").collect()))
    #: the hot key is dealt to many tasks
    rows = join_hot(left.where("key = 7"), right, ["key"], F.col("v")).rdd.glom().map(len).collect()
    assert sum(rows) == 2000


def test_join_hot_takes_one_plan_and_makes_a_row_for_each_on_the_left(spark):
    """With and without hot keys; a group of twice the size makes twice the rows, not four times."""
    plans, made = [], []
    for big in (0, 1000, 2000):
        left = spark.createDataFrame([(i % 2000, i) for i in range(4000)] + [(-1, i) for i in range(big)], "k long, v long")
        right = left.groupBy("k").agg(F.count("*").alias("__n"))
        rows = join_hot(left, right, ["k"], F.col("v"))
        made.append(rows.count())
        plans.append("__salt" in rows._jdf.queryExecution().optimizedPlan().toString().split("Join Inner, ")[1].split("\n")[0])
        assert rows.select("k", "v").exceptAll(left).isEmpty()
    assert plans == [True, True, True] and made == [4000, 5000, 6000]
