"""Aggregates by group that change sets keep up to date, in place of a new scan of all rows.

A change set is turned into signed rows (`signed`): what a row was counts -1, what it is counts +1. They are summed by group
before they meet the state, so that a state row is read and written once a change set and only for groups that were touched.
Counts and sums are retracted by subtraction. A minimum or maximum that loses its row, and a sketch that loses any, can't be:
those groups alone are read again from the rows as they are now. A distinct count is exact by a second step: counts by group
and value are one kept table, whose rows that come and go are the signed rows of the next (`appeared`).

Defined results: null groups are groups like others; nulls add nothing, a sum, minimum or maximum of nulls alone is null; a
group without rows goes; an empty change set changes nothing. Sums are of whole numbers or decimals, as sums of floating
numbers can't be retracted exactly; others are refused.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, LongType, StructType

from sparkloom.session import settle
from sparkloom.streaming.sink import BUCKETS, KeyedTable

N, SIGN, AGAIN, AT = "n_rows", "sign", "__again", "as_of"


class Measure(NamedTuple):
    name: str
    kind: str  # sum, min, max or sketch
    value: str  # SQL over a row


def signed(old: DataFrame, new: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """The rows of a change set (key and op, as `changes` gives them) with their sign."""
    gone = old.join(changed.where("op <> 'insert'").select(key), key, "left_semi").withColumn(SIGN, F.lit(-1))
    come = new.join(changed.where("op <> 'delete'").select(key), key, "left_semi").withColumn(SIGN, F.lit(1))
    return gone.unionByName(come)


def _same(a: str, b: str, by: Sequence[str]) -> Column:
    return reduce(Column.__and__, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in by))


def _checked(rows: DataFrame, measures: Sequence[Measure]) -> None:
    for m in measures:
        if m.kind not in ("sum", "min", "max", "sketch"):
            raise ValueError(f"{m.name}: no measure of kind {m.kind}")
        if m.kind == "sum" and isinstance(rows.select(F.expr(m.value)).schema[0].dataType, (DoubleType, FloatType)):
            raise ValueError(f"{m.name}: sums of floating numbers can't be retracted exactly")


def state_of(rows: DataFrame, by: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """The state by a scan: the groups, n_rows and a column a measure; sums have their number of values beside them."""
    _checked(rows, measures)
    cols = [F.count(F.lit(1)).alias(N)]
    for m in measures:
        v = F.expr(m.value)
        if m.kind == "sum":
            cols += [F.sum(v).alias(m.name), F.count(v).alias(m.name + "__n")]
        else:
            cols.append({"min": F.min, "max": F.max, "sketch": F.hll_sketch_agg}[m.kind](v).alias(m.name))
    return rows.groupBy(*by).agg(*cols)


def touched(state: DataFrame, moves: DataFrame, now: DataFrame, by: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """The state rows of the groups that signed rows touch, as they are after them; n_rows is 0 where a group goes. `now`
    are all rows after the change set; they are read only for groups that lost what can't be retracted."""
    _checked(moves, measures)
    sign, gains, losses = F.col(SIGN), F.col(SIGN) > 0, F.col(SIGN) < 0
    sums = [F.sum(sign).cast("long").alias("d")]
    for m in measures:
        v = F.expr(m.value)
        if m.kind == "sum":
            sums += [F.sum(v * sign).alias("d_" + m.name), F.sum(F.when(v.isNotNull(), sign).otherwise(0)).alias(f"d_{m.name}__n")]
        elif m.kind == "sketch":
            sums += [F.hll_sketch_agg(F.when(gains, v)).alias("g_" + m.name), F.coalesce(F.bool_or(losses & v.isNotNull()), F.lit(False)).alias("l_" + m.name)]
        else:
            best = F.min if m.kind == "min" else F.max
            sums += [best(F.when(gains, v)).alias("g_" + m.name), best(F.when(losses, v)).alias("l_" + m.name)]
    d, s = moves.groupBy(*by).agg(*sums).alias("d"), state.alias("s")
    n = F.coalesce(F.col(f"s.{N}"), F.lit(0)) + F.col("d.d")
    out, again = [F.col(f"d.{k}").alias(k) for k in by] + [n.alias(N)], F.lit(False)
    types = {f.name: f.dataType for f in state.schema.fields}
    for m in measures:
        had, got, lost = F.col(f"s.{m.name}"), F.col(f"d.g_{m.name}"), F.col(f"d.l_{m.name}")
        if m.kind == "sum":
            held = F.coalesce(F.col(f"s.{m.name}__n"), F.lit(0)) + F.col(f"d.d_{m.name}__n")
            total = F.coalesce(had, F.lit(0)) + F.coalesce(F.col(f"d.d_{m.name}"), F.lit(0))
            out += [F.when(held > 0, total).cast(types[m.name]).alias(m.name), held.cast("long").alias(m.name + "__n")]
        elif m.kind == "sketch":
            out.append(F.when(had.isNull(), got).otherwise(F.hll_union(had, got)).alias(m.name))
            again = again | lost
        else:
            best, behind = (F.least, lost <= had) if m.kind == "min" else (F.greatest, lost >= had)
            covered = got <= lost if m.kind == "min" else got >= lost
            out.append(best(had, got).alias(m.name))
            again = again | (F.coalesce(behind, F.lit(False)) & ~F.coalesce(covered, F.lit(False)))
    after = d.join(s, _same("d", "s", by), "left").select(*out, (again & (n > 0)).alias(AGAIN))
    if all(m.kind == "sum" for m in measures):
        return after.drop(AGAIN)
    after = settle(after)
    asked = now.alias("r").join(after.where(AGAIN).select(*by).alias("a"), _same("r", "a", by), "left_semi")
    fresh = state_of(asked, by, measures)
    pick = [F.when(F.col(AGAIN), F.col(f"f.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in state.columns if c not in (*by, N)]
    return after.alias("t").join(fresh.alias("f"), _same("t", "f", by), "left").select(*(F.col(f"t.{k}").alias(k) for k in (*by, N)), *pick)


def fold(state: DataFrame, moves: DataFrame, now: DataFrame, by: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """The whole state after signed rows."""
    new = touched(state, moves, now, by, measures)
    old = state.alias("s").join(new.select(*by).alias("t"), _same("s", "t", by), "left_anti")
    return old.unionByName(new.where(F.col(N) > 0).select(*state.columns))


def appeared(before: DataFrame, after: DataFrame, by: Sequence[str]) -> DataFrame:
    """Signed rows of the groups that came or went between the old rows of a state's touched groups and the new ones."""
    come = after.where(F.col(N) > 0).alias("x").join(before.select(*by).alias("y"), _same("x", "y", by), "left_anti").select(*by, F.lit(1).alias(SIGN))
    gone = before.alias("x").join(after.where(F.col(N) == 0).select(*by).alias("y"), _same("x", "y", by), "left_semi").select(*by, F.lit(-1).alias(SIGN))
    return come.unionByName(gone)


def fold_distinct(state: DataFrame, values: DataFrame, moves: DataFrame, by: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """by, n_rows (distinct values, null is none); by, value, n_rows; signed rows -> both after them. No row is read again."""
    both = [*by, value]
    new = settle(touched(values, moves.where(F.col(value).isNotNull()), moves, both, ()))
    step = appeared(values, new, both)
    kept = values.alias("s").join(new.select(*both).alias("t"), _same("s", "t", both), "left_anti").unionByName(new.where(F.col(N) > 0))
    return fold(state, step, step, by, ()), kept


class KeptTable:
    """A state in a keyed table, of which a change set rewrites the buckets of the groups that it touches.

    Change sets have growing numbers. Each state row knows the last that it has seen, so a change set which is applied again
    after a failure, as a stream does it, counts once, also where only a part of the buckets was written; for that, groups
    that went stay as rows of n_rows 0, which `read` passes over.
    """

    def __init__(self, spark: SparkSession, path: str, rows: StructType, by: Sequence[str], measures: Sequence[Measure], buckets: int = BUCKETS) -> None:
        self.by, self.measures = list(by), list(measures)
        empty = state_of(spark.createDataFrame([], rows), by, measures).withColumn(AT, F.lit(0).cast(LongType()))
        self.table = KeyedTable(spark, path, empty.schema, by, buckets)

    def read(self) -> DataFrame:
        return self.table.read().where(F.col(N) > 0).drop(AT)

    def apply(self, moves: DataFrame, now: DataFrame, number: int) -> list[int]:
        """Signed rows and all rows after them; gives the buckets that were rewritten."""
        state = self.table.read()
        seen = state.where(F.col(AT) >= number).select(*self.by)
        fresh = moves.alias("m").join(seen.alias("s"), _same("m", "s", self.by), "left_anti")
        new = touched(state.drop(AT), fresh, now, self.by, self.measures)
        return self.table.apply(new.withColumn(AT, F.lit(number).cast(LongType())).withColumn("op", F.lit("upsert")), [F.desc(AT)])
