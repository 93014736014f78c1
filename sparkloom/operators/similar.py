"""Set-similarity join: pairs of sets whose intersection is a share of their union, found by prefixes and lengths.

Items that only one side has are left out, as no pair shares them; sizes stay those of the whole sets. The others are ordered
by the number of right sets that have them, rarest first. Two sets of n and m items whose similarity is `least` share at
least c = ceil((n + m) * least / (1 + least)) items, so the first that they share is followed by c - 1 more in both: only
items with enough behind them are posted and met. Items that many sets have stand last in the order, so few of them are
posted. Postings of an item and of a size of right sets are dealt by their number, left and right ones in blocks of `deal`;
a task compares two blocks at a time. Where the first item must be followed by nearly all that are left, it takes the pairs
that share a second one, else all pairs as a product of matrices. A pair counts where its first shared item is met, so pairs
are neither kept nor shuffled.

Defined results: empty and null sets are similar to nothing; items that repeat in a set count once; rows with the same key
and the same set are one; a `least` of 0 or less is refused, as it would pair sets that share nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import trigrams
from sparkloom.session import settle

#: Postings of an item and size, of either side, that one task compares at a time.
DEAL = 2000

#: Pairs that leave a task at a time.
PART = 1 << 19

#: Items that a task keeps in memory.
VOCABULARY = 1 << 17


def _prefix(size: Column, least: float) -> Column:
    return size - F.ceil(size * F.lit(least) - 1e-9).cast("int") + 1


def _ordered(sets: DataFrame, order: DataFrame) -> DataFrame:
    """key, items -> key, n, items in the given order, as structs (frequency, item); n is the size with items that have no place."""
    each = sets.select("key", F.size("items").alias("n"), F.explode("items").alias("item")).join(order.hint("merge"), "item", "left")
    return each.groupBy("key", "n").agg(F.sort_array(F.collect_list(F.when(F.col("f").isNotNull(), F.struct("f", "item")))).alias("items"))


def _posted(ordered: DataFrame, least: float, key: str, n: str, at: str) -> DataFrame:
    few = ordered.select("key", "n", F.posexplode(F.slice("items", 1, _prefix(F.col("n"), least))).alias("at", "x"))
    return few.select(F.col("key").alias(key), F.col("n").alias(n), F.col("at").alias(at), F.col("x.item").alias("item"))


def _looked_up(items: list):
    """key, items -> key, n, places, by a list of all items in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            lists = batch.column("items")
            known = pa.array(items, lists.type.value_type) if known is None else known
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            at, row = pc.index_in(lists.flatten(), value_set=known), np.repeat(np.arange(len(n)), n)
            has = at.is_valid().to_numpy(zero_copy_only=False)
            at, row = at.drop_null().to_numpy(), row[has]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))])
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[np.lexsort((at, row))], pa.int32()))
            yield pa.record_batch([batch.column("key"), pa.array(n, pa.int32()), places], ["key", "n", "places"])

    return run


def in_order(left: DataFrame, right: DataFrame, a: str, b: str, items: str = "items") -> tuple[DataFrame, DataFrame]:
    """a, items; b, items -> a, n, places and b, n, places: the size of the set, and the places in the order of those of its
    items that both sides have. Up to VOCABULARY items are looked up in each task's memory, more are met in a join."""
    clean = lambda df, key: df.select(F.col(key).alias("key"), F.array_distinct(F.array_compact(items)).alias("items")).where(F.col("key").isNotNull() & (F.size("items") > 0))
    lefts, rights = clean(left, a), clean(right, b)
    count = lambda df, f: df.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias(f))
    order = settle(count(lefts, "g").hint("merge").join(count(rights, "f"), "item").orderBy("f", "item").select("item", F.monotonically_increasing_id().alias("f")))
    if order.count() <= VOCABULARY:
        run = _looked_up([r["item"] for r in order.orderBy("f").collect()])
        placed = lambda df: df.mapInArrow(run, f"key {dict(df.dtypes)['key']}, n int, places array<int>").distinct()
    else:
        placed = lambda df: _ordered(df.distinct(), order).withColumn("places", F.col("items.f"))
    return tuple(settle(placed(df).select(F.col("key").alias(key), "n", "places")) for df, key in ((lefts, a), (rights, b)))


def _met(placed: DataFrame, least: float, key: str, to: str, n: str, rest: str, whole: str) -> DataFrame:
    """The places that a set may share first, with the number of places from there on, and all of them."""
    few = F.greatest(F.lit(0), F.size("places") - F.ceil(F.col("n") * F.lit(least) - 1e-9).cast("int") + 1)
    each = placed.select(F.col(key).alias(to), F.col("n").alias(n), F.col("places").alias(whole), F.posexplode(F.slice("places", 1, few)).alias("at", "item"))
    return each.withColumn(rest, F.size(whole) - F.col("at")).drop("at")


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists, and the row of each."""
    lists = lists.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def _dense(x: tuple, y: tuple, item: int, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sets as rows over the items that both blocks have; what is shared before `item` outweighs all that may follow."""
    (u, i), (v, j) = x, y
    some = np.intersect1d(u, v)
    at, to = np.minimum(np.searchsorted(some, u), len(some) - 1), np.minimum(np.searchsorted(some, v), len(some) - 1)
    have, held = some[at] == u, some[to] == v
    p, q = np.zeros((shape[0], len(some)), np.float32), np.zeros((shape[1], len(some)), np.float32)
    p[i[have], at[have]] = np.where(u[have] < item, -float(len(some) + 1), 1.0)
    q[j[held], to[held]] = 1.0
    return p, q


def _needed(nl: np.ndarray, nr: int, least: float) -> np.ndarray:
    """The fewest shared items that make `least`, as the similarity itself is rounded."""
    c = np.floor((nl + nr) * least / (1 + least)).astype(np.int64) - 1
    for _ in range(3):
        c = np.where(c / (nl + nr - c) >= least - 1e-9, c, c + 1)
    return np.maximum(c, 1)


def _compared(least: float, best: bool):
    """Two blocks of one item and size -> their pairs, or the best of each left set (ties by the right key)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, other = left.column("l").combine_chunks(), right.column("r").combine_chunks()
        out = pa.schema([("l", key.type), ("r", other.type), ("similarity", pa.float64())])
        if not len(left) or not len(right):
            return out.empty_table()
        item, nr = left.column("item")[0].as_py(), left.column("nr")[0].as_py()
        nl, rest, follow = (t.column(c).to_numpy().astype(np.int64) for t, c in ((left, "nl"), (left, "sl"), (right, "sr")))
        need = _needed(nl, nr, least)
        p, q = _dense(_flat(left.column("x")), _flat(right.column("y")), item, (len(left), len(right)))
        behind = np.argsort(-follow, kind="stable")
        q, follow = q[behind], follow[behind]
        found = []
        for c in np.unique(need[rest >= need]):
            i = np.flatnonzero((need == c) & (rest >= c))
            shared = p[i] @ q[: np.searchsorted(-follow, -c, side="right")].T
            x, y = np.nonzero(shared >= c)
            found.append((i[x], behind[y], shared[x, y].astype(np.int64)))
        if not found:
            return out.empty_table()
        i, j, both = (np.concatenate(z) for z in zip(*found, strict=True))
        similarity = both / (nl[i] + nr - both)
        if best:
            rank = np.empty(len(other), np.int64)
            rank[pc.sort_indices(other).to_numpy()] = np.arange(len(other))
            at = np.lexsort((rank[j], -similarity, i))
            at = at[np.diff(i[at], prepend=-1) != 0]
            i, j, similarity = i[at], j[at], similarity[at]
        cut = [slice(k, k + PART) for k in range(0, len(i), PART)]
        return pa.Table.from_batches([pa.record_batch([key.take(pa.array(i[s])), other.take(pa.array(j[s])), pa.array(similarity[s])], schema=out) for s in cut], schema=out)

    return run


def similar_pairs(left: DataFrame, right: DataFrame, least: float, a: str = "a", b: str = "b", items: str = "items", deal: int = DEAL, ordered: bool = False, best: bool = False) -> DataFrame:
    """a, items; b, items -> a, b, similarity (at least `least`). `ordered`: both are as `in_order` gives them. `best`: of
    the pairs of a left set, those are left out that another one of the same blocks excels."""
    if not 0 < least <= 1:
        raise ValueError("least must lie above 0 and not above 1")
    lefts, rights = (left, right) if ordered else in_order(left, right, a, b, items)
    p, q = _met(lefts, least, a, "l", "nl", "sl", "x"), _met(rights, least, b, "r", "nr", "sr", "y")
    need = F.ceil((F.col("nl") + F.col("nr")) * F.lit(least / (1 + least)) - 1e-9)
    fits = (F.col("nr") >= F.col("nl") * least - 1e-9) & (F.col("nl") >= F.col("nr") * least - 1e-9) & (F.least("sl", "sr") >= need)
    #: right postings are dealt by item and size, so left ones go only where sizes and places allow a pair; no side has a
    #: bound, so none is broadcast, however small it seems before it is read
    asked = p.groupBy("item", "nl", "sl").agg(F.count("*").alias("lefts"))
    held = q.groupBy("item", "nr").agg(F.count("*").alias("rights"), F.max("sr").alias("sr"))
    blocks = lambda n: F.ceil(F.col(n) / deal).cast("int")
    plan = asked.join(held.hint("merge"), "item").where(fits).groupBy("item", "nr", "sr", "rights").agg(F.sum("lefts").alias("lefts"), F.min(need).alias("least"))
    plan = plan.select("item", "nr", "sr", "least", blocks("lefts").alias("ls"), blocks("rights").alias("rs"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    p = p.join(plan.hint("merge"), "item").where(fits).select("item", F.col("nr").alias("nr"), part("l", "ls").alias("dl"), every("rs").alias("dr"), "l", "nl", "sl", "x")
    q = q.join(plan.drop("sr").hint("merge"), ["item", "nr"]).where("sr >= least").select("item", "nr", every("ls").alias("dl"), part("r", "rs").alias("dr"), "r", "sr", "y")
    group, spark = ["item", "nr", "dl", "dr"], left.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    kinds = dict(p.dtypes) | dict(q.dtypes)
    met = p.repartition(n, *group).groupBy(*group).cogroup(q.repartition(n, *group).groupBy(*group)).applyInArrow(_compared(least, best), f"l {kinds['l']}, r {kinds['r']}, similarity double")
    return met.select(F.col("l").alias(a), F.col("r").alias(b), "similarity")


#: Similarities at which `most_similar` looks, highest first.
LADDER = (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35)


def most_similar(asked: DataFrame, known: DataFrame, least: float, a: str = "a", b: str = "b") -> DataFrame:
    """Texts a; texts b -> a, b, similarity: for each a the b of the most similar trigrams (ties by b), if it is `least`.

    High similarities are looked for first, as their prefixes are short and rare; what has found its best goes on no more.
    All that is as similar is found in the same step, so the best of a step is the best of all. Sets are put in order once.
    """
    left = asked.select(a).distinct().withColumn("items", trigrams(F.col(a)))
    left, right = in_order(left, known.select(b).distinct().withColumn("items", trigrams(F.col(b))), a, b)
    least_n, out = right.agg(F.min("n")).head()[0] or 1, None
    #: no similarity exceeds what a known set without other items would give
    held = F.size("places")
    bound = held / F.when(held < least_n, F.col("n") + least_n - held).otherwise(F.col("n"))
    for at in [x for x in LADDER if x > least] + [least]:
        most = left.agg(F.max(bound)).head()[0]
        if most is None:
            break
        if most < at - 1e-9 and at > least:
            continue
        best = similar_pairs(left, right, at, a, b, "items", DEAL, True, True).groupBy(a).agg(F.min(F.struct((-F.col("similarity")).alias("d"), F.col(b).alias("b"))).alias("m"))
        best = settle(best.select(a, F.col("m.b").alias(b), (-F.col("m.d")).alias("similarity")))
        out = best if out is None else out.unionByName(best)
        left = settle(left.join(best, a, "left_anti"))
    if out is None:
        return asked.where(F.lit(False)).select(a).join(known.select(b), F.lit(False)).select(a, b, F.lit(0.0).alias("similarity"))
    return out
