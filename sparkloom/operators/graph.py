"""Depth-bounded traversal of an edge table, and packing of spans into a budget."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.listings import latest
from sparkloom.session import settle


def traverse(edges: DataFrame, roots: DataFrame, direction: str = "out", depth: int = 2) -> DataFrame:
    """src, dst; node -> node, depth: one row for each edge from an expanded node. A node is expanded once, at its first
    level, and may be given several times."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    frontier = roots.select(F.col("node")).distinct()
    seen, out = frontier, None
    for level in range(1, depth + 1):
        found = edges.join(frontier, edges[a] == frontier["node"]).select(edges[b].alias("node"), F.lit(level).alias("depth"))
        out = found if out is None else out.unionByName(found)
        if level < depth:
            frontier = found.select("node").distinct().join(seen, "node", "left_anti")
            seen = seen.unionByName(frontier)
    return out


def neighbours_of_each(edges: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """node -> node, side, other: at most k callers and k callees each, in order."""
    out = edges.join(nodes, edges["src"] == nodes["node"]).select("node", F.lit("callee").alias("side"), F.col("dst").alias("other"))
    into = edges.join(nodes, edges["dst"] == nodes["node"]).select("node", F.lit("caller").alias("side"), F.col("src").alias("other"))
    return _least(out.unionByName(into), ["node", "side"], "other", k)


def _least(rows: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """The k least distinct values of each key. Ranks are dense, so repeated rows needn't be made distinct before: each task
    drops what lies behind its own k least, and only the rest is shuffled."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(value))
    return rows.withColumn("r", rank).where(F.col("r") <= k).drop("r").distinct()


def running(size: Column, partition: Sequence[str], order: Sequence, before: bool) -> Column:
    """Sum of sizes through a row, or before it."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return F.coalesce(F.sum(size).over(w), F.lit(0))


def pack_crossing(spans: DataFrame, budget: int, size: Column, partition: Sequence[str] = (), order: Sequence = ("at",)) -> DataFrame:
    """Spans in order while the budget isn't spent; the one that crosses it is kept."""
    return spans.withColumn("spent", running(size, partition, order, True)).where(F.col("spent") < budget)


def pack_within(spans: DataFrame, budget: int, size: Column, partition: Sequence[str] = (), order: Sequence = ("at",)) -> DataFrame:
    """Spans in order; stop before the first that exceeds the budget."""
    return spans.withColumn("spent", running(size, partition, order, False)).where(F.col("spent") <= budget)


def running_blocks(spans: DataFrame, size: Column, partition: Sequence[str] = (), order: Sequence = ("at",), before: bool = False, blocks: int | None = None, most: int | None = None) -> DataFrame:
    """Spans with `spent`, the sum of sizes through each span in the order of its group (or before it), by blocks: no task
    sees a whole group, so one may hold all rows.

    Rows are range-partitioned by group and order; each block is summed; a block's offset is what its group has before it;
    within a block a window does the rest. With `most`, blocks that begin beyond it are left out unread. The order must be
    total for a result that is always the same; null groups are one group. Give it narrow rows: they are written once.
    """
    blocks = blocks or int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(spans.withColumn("__size", size).repartitionByRange(blocks, *partition, *order).withColumn("__block", F.spark_partition_id()))
    totals = ranged.groupBy(*partition, "__block").agg(F.coalesce(F.sum("__size"), F.lit(0)).alias("__total"))
    if partition:
        earlier = Window.partitionBy(*partition).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.withColumn("__offset", F.coalesce(F.sum("__total").over(earlier), F.lit(0))).drop("__total")
        offsets = offsets.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(partition)), F.col("__block").alias("__b"), "__offset")
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(partition)))
        ranged = ranged.join(offsets, same & (F.col("__block") == F.col("__b"))).drop("__b", *(f"__{i}" for i in range(len(partition))))
    else:
        #: one number a block
        found = {r["__block"]: r["__total"] for r in totals.collect()}
        sums = list(accumulate((found.get(i, 0) for i in range(blocks)), initial=0))
        ranged = ranged.withColumn("__offset", F.get(F.array(*map(F.lit, sums)), F.col("__block")))
    if most is not None:
        ranged = ranged.where(F.col("__offset") <= most)
    return ranged.withColumn("spent", F.col("__offset") + running(F.col("__size"), [*partition, "__block"], order, before)).drop("__size", "__block", "__offset")


def pack_within_blocks(spans: DataFrame, budget: int, size: Column, partition: Sequence[str] = (), order: Sequence = ("at",), blocks: int | None = None) -> DataFrame:
    """As `pack_within`, for groups that no task can hold."""
    return running_blocks(spans, size, partition, order, False, blocks, budget).where(F.col("spent") <= budget)


def pack_crossing_blocks(spans: DataFrame, budget: int, size: Column, partition: Sequence[str] = (), order: Sequence = ("at",), blocks: int | None = None) -> DataFrame:
    """As `pack_crossing`, for groups that no task can hold."""
    return running_blocks(spans, size, partition, order, True, blocks, budget).where(F.col("spent") < budget)


def overlapping(left: DataFrame, right: DataFrame, on: Sequence[str], width: int, begin: str = "begin", end: str = "end") -> DataFrame:
    """Pairs of rows with equal `on` whose intervals [begin, end] of whole numbers touch: on, and both rows as structs l and r.

    Intervals are dealt to bins of `width` and meet in an equi-join on the bin; a pair is given in one bin only, that of the
    later begin. Rows with a null, or with an end before the begin, meet nothing. Choose the width near the common length:
    an interval has length / width + 1 rows.
    """
    bin_ = lambda x: F.floor(F.col(x) / width)

    def dealt(df: DataFrame, name: str) -> DataFrame:
        held = df.where(F.col(begin) <= F.col(end))
        return held.select(*on, F.struct(*df.columns).alias(name), F.explode(F.sequence(bin_(begin), bin_(end))).alias("__bin"))

    met = dealt(left, "l").join(dealt(right, "r"), [*on, "__bin"])
    touch = (F.col(f"l.{begin}") <= F.col(f"r.{end}")) & (F.col(f"r.{begin}") <= F.col(f"l.{end}"))
    first = F.floor(F.greatest(F.col(f"l.{begin}"), F.col(f"r.{begin}")) / width)
    return met.where(touch & (F.col("__bin") == first)).drop("__bin")


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


#: Names of files that programs start from; fixed values.
ENTRY_FILES = ("main.", "index.", "app.", "server.")


def is_entrypoint(path: Column, name: Column) -> Column:
    """A symbol in a file that programs start from, or with main in its name."""
    return reduce(lambda a, b: a | b, (F.contains(path, F.lit(x)) for x in ENTRY_FILES)) | name.contains("main") | name.contains("Main")


def find_symbol(symbols: DataFrame, name: str | None = None, id_: int | None = None, key: str = "id", fqn: str = "fqn") -> DataFrame:
    """One symbol by its qualified name (of several the least id) or by its id."""
    found = symbols.where(F.col(key) == id_) if id_ is not None else symbols.where(F.col(fqn) == name)
    return found.orderBy(key).limit(1)


def call_flows(edges: DataFrame, entries: DataFrame, depth: int = 2, k: int = 20) -> DataFrame:
    """src, dst; node -> node, callee, depth: for each entry the distinct callees of every depth, the first k by depth and name.

    A callee is given at each depth at which a path reaches it. Depths come in order, so an entry that has its k is done, and
    one that goes on has fewer than k ends, all of them known; a step needs the k least callees of a caller only.
    """
    few = _least(edges.select("src", "dst"), ["src"], "dst", k)
    step = entries.select("node", F.col("node").alias("callee")).distinct().withColumn("had", F.lit(0).cast("long"))
    out = None
    for level in range(1, depth + 1):
        found = step.join(few, step["callee"] == few["src"]).select("node", "had", F.col("dst").alias("callee"))
        #: by sums of what came before, an entry's rows are k at most over all levels
        found = settle(_least(found, ["node", "had"], "callee", k))
        at = F.row_number().over(Window.partitionBy("node").orderBy("callee"))
        some = found.withColumn("r", F.col("had") + at).where(F.col("r") <= k).select("node", "callee", F.lit(level).alias("depth"))
        out = some if out is None else out.unionByName(some)
        n = found.groupBy("node").agg(F.count("*").alias("n"))
        step = found.join(n, "node").withColumn("had", F.col("had") + F.col("n")).where(F.col("had") < k).select("node", "callee", "had")
    return out


def first_chunk(chunks: DataFrame, owner: str, line: str = "start_line", tie: str = "id") -> DataFrame:
    """The chunk in which each symbol or file begins."""
    return latest(chunks, [owner], [line, tie])


def below(files: DataFrame, modules: DataFrame, path: str = "path", module: str = "module") -> DataFrame:
    """Files with each module (a folder) that their path lies under; all folders of a path are exploded, then joined."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.withColumn(module, F.explode(F.when(F.size(parts) > 1, folders))).join(modules, module)
