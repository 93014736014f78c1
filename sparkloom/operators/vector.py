"""Exact vector search: cosine by array functions, top-k as a bounded heap in each task (TakeOrderedAndProject)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.session import settle


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def literal(q: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in q))


def vector_topk(vectors: DataFrame, q: Sequence[float], k: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """The k nearest by cosine, ties by key: key, score."""
    scored = vectors.select(F.col(key), cosine(doubles(F.col(vector)), literal(q)).alias("score"))
    return scored.where("score IS NOT NULL").orderBy(F.desc("score"), key).limit(k)


def inverse_distance(score: Column) -> Column:
    """1 / (1 + cosine distance)."""
    return 1 / (1 + (1 - score))


def above(vectors: DataFrame, q: Sequence[float], threshold: float, most: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """Semantic tagging: similarity at least the threshold, the best `most`."""
    return vector_topk(vectors, q, most, key, vector).where(F.col("score") >= threshold)


#: Vectors of a block, and of documents that meet it at a time.
BLOCK, STEP = 4096, 256


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows padded by zeros, their sizes (-1 if null or with a null in them) and their norms."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, row = column.flatten(), np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    sizes[column.is_null().to_numpy(zero_copy_only=False)] = -1
    sizes[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, sizes, np.sqrt(_dots(out, out))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows summed from the first component on, as `dot` does, so that equal rows score the same everywhere."""
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[0])
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _best(v: tuple, w: tuple, chunks: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each document its k best chunks of a block and their scores (NaN for null): candidates by a product of matrices,
    their scores as by `cosine`."""
    (a, n, x), (b, m, y) = v, w
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(z, ((0, 0), (0, width - z.shape[1]))) for z in (a, b))
    for i in range(0, len(a), STEP):
        norms = x[i : i + STEP, None] * y
        with np.errstate(all="ignore"):
            rough = a[i : i + STEP] @ b.T / norms
        rough[~np.isfinite(rough)] = np.inf  # settled by the exact score
        void = (n[i : i + STEP, None] != m) | (m < 0) | (norms == 0)
        rough[void] = -np.inf
        least = np.partition(rough, len(b) - k, axis=1)[:, len(b) - k] if len(b) > k else np.full(len(rough), -np.inf)
        for at in range(len(rough)):
            near = np.flatnonzero(rough[at] >= least[at] - 1e-9)
            with np.errstate(all="ignore"):
                score = _dots(a[i + at][None, :], b[near]) / norms[at, near]
            null = void[at, near]
            #: as ORDER BY score DESC, chunk has it: NaN before numbers, null behind them
            rank = np.where(null, 2, np.where(np.isnan(score), 0, 1))
            order = np.lexsort((chunks[near], -np.where(rank == 1, score, 0.0), rank))[:k]
            yield i + at, near[order], [None if z else x for x, z in zip(score[order].tolist(), null[order].tolist(), strict=True)]


def best_of_blocks(docs: DataFrame, chunks: DataFrame, k: int, on: Sequence[str]) -> DataFrame:
    """Rows (on, doc, v) meet rows (on, chunk, w) -> on, doc, chunk, score: each document's k best of each block that it
    meets. A task has the vectors of one block and the documents that meet it, and compares them as matrices."""
    kinds = dict(docs.dtypes) | dict(chunks.dtypes)
    out = ", ".join(f"{c} {kinds[c]}" for c in (*on, "doc", "chunk")) + ", score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return shape(left, right).empty_table()
        chunk, v, w = right.column("chunk").combine_chunks(), _matrix(left.column("v")), _matrix(right.column("w"))
        rows = list(_best(v, w, chunk.to_numpy(), k))
        doc = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])
        held = [pa.repeat(right.column(c)[0], len(doc)) for c in on]
        score = pa.array([x for r in rows for x in r[2]], pa.float64(), from_pandas=False)
        return pa.Table.from_arrays([*held, left.column("doc").combine_chunks().take(pa.array(doc)), chunk.take(pa.array(np.concatenate([r[1] for r in rows]))), score], schema=shape(left, right))

    def shape(left: pa.Table, right: pa.Table) -> pa.Schema:
        return pa.schema([*((c, right.schema.field(c).type) for c in on), ("doc", left.schema.field("doc").type), ("chunk", right.schema.field("chunk").type), ("score", pa.float64())])

    return docs.groupBy(*on).cogroup(chunks.groupBy(*on)).applyInArrow(run, out)


def nearest_of_each(docs: DataFrame, chunks: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """Lateral top-k: (doc, vector) against (chunk, vector) -> doc, chunk, score, the k best for each document.

    Chunks are cut into blocks, of BLOCK vectors by default, and documents into groups of as many; each group meets each
    block in one task. A document's best k of a block are kept before blocks meet. Every pair is compared, so the work grows
    with documents times chunks, while a task's memory stays that of two blocks.
    """
    blocks = blocks or -(-chunks.count() // BLOCK) or 1
    groups = -(-docs.count() // BLOCK) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cut = chunks.select("chunk", doubles("vector").alias("w"), F.pmod(F.xxhash64("chunk"), F.lit(blocks)).alias("block"), every(groups).alias("group"))
    each = docs.select("doc", doubles("vector").alias("v"), F.pmod(F.xxhash64("doc"), F.lit(groups)).alias("group"), every(blocks).alias("block"))
    scored = best_of_blocks(each, cut, k, ["block", "group"])
    at = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "chunk"))
    return scored.withColumn("r", at).where(F.col("r") <= k).select("doc", "chunk", "score")


def document_score(nearest: DataFrame) -> DataFrame:
    """Mean of the nearest similarities; above 0.5 stretched by 1.5 and at most 1; 0.5 without any."""
    mean = F.avg("score")
    return nearest.groupBy("doc").agg(F.when(mean.isNull(), 0.5).when(mean > 0.5, F.least(F.lit(1.0), mean * 1.5)).otherwise(mean).alias("score"))


def ann_lists(rows: Column) -> Column:
    """Cells of an inverted-file index."""
    return F.when(rows < 1000, F.greatest(F.lit(1), F.floor(rows / 100))).when(rows < 1_000_000, F.greatest(F.lit(10), F.floor(rows / 1000))).otherwise(F.greatest(F.lit(100), F.floor(F.sqrt(rows)))).cast("long")


def ann_advice(rows: Column) -> Column:
    return F.when(rows < 1000, "none").when(rows < 100_000, "ivfflat").otherwise("hnsw")


def needs_rebuild(rows: Column, before: Column, share: float = 0.2) -> Column:
    """Whether a table has changed by more than a share since its index was built."""
    return F.abs(rows - before) > before * share


def mean_pool(segments: DataFrame, key: str = "id", vector: str = "vector") -> DataFrame:
    """The mean of the vectors of each key, dimension by dimension, in their order."""
    each = segments.select(key, F.posexplode(doubles(F.col(vector))).alias("at", "x")).groupBy(key, "at").agg(F.avg("x").alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias(vector))


#: The cell of what has no place among centres: vectors of another length, or whose length is no finite number.
APART = -1

#: Bytes of a row group of cells, so that a search reads little beside the cells it asks for.
CELL_GROUP = 2 << 20


def _centres(vectors: DataFrame, k: int, seed: int, sample: int) -> np.ndarray:
    """The centres of (key, vector) at length 1, by k-means on `sample` vectors at most, drawn by a hash."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    square = dot(doubles(F.col("vector")), doubles(F.col("vector")))
    sound = (square > 0) & (square < float("inf"))
    most = vectors.where(sound).groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").head()
    if most is None:
        return np.zeros((0, 0))
    #: the hash leaves a tenth more than is wanted, whatever the table's size, and comes before what is costly on each row
    some = vectors.where(F.size("vector") == most["d"]).withColumn("h", F.xxhash64("key", "vector")).where(F.pmod("h", F.lit(most["n"])) < sample + sample // 10)
    some = some.where(sound).orderBy("h", "key").limit(sample).repartition(vectors.sparkSession.sparkContext.defaultParallelism)
    unit = Normalizer(p=2.0, inputCol="long", outputCol="features").transform(some.select(array_to_vector(doubles(F.col("vector"))).alias("long")))
    return np.array(KMeans(k=k, seed=seed, maxIter=5).fit(unit).clusterCenters())


def cells(vectors: DataFrame, k: int, seed: int = 3, sample: int = 50_000) -> tuple[DataFrame, np.ndarray]:
    """(key, vector) -> key, vector, far, cell: the nearest of k centres and the distance to it, at length 1; and the centres.

    The centres are fitted by k-means on `sample` vectors at most; every vector is assigned, in blocks compared as matrices.
    Zero vectors have no direction and are left out, as are those that are null or hold one.
    """
    centres = _centres(vectors, k, seed, sample)
    d, squares = centres.shape[1], (centres**2).sum(axis=1)
    step = max(STEP, (1 << 20) // max(1, len(centres)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), step):
                part = batch.slice(i, step)
                v, sizes, norms = _matrix(part.column("vector"))
                kept = (sizes >= 0) & (norms != 0)
                inside = kept & (sizes == d) & np.isfinite(norms)
                cell, far = np.full(len(part), APART, np.int32), np.zeros(len(part))
                if inside.any():
                    unit = v[inside][:, :d] / norms[inside, None]
                    near = np.argmin(squares - 2 * (unit @ centres.T), axis=1)
                    cell[inside], far[inside] = near, np.sqrt(((unit - centres[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("vector"), pa.array(far), pa.array(cell)], names=["key", "vector", "far", "cell"]).filter(pa.array(kept))

    rows = vectors.select("key", doubles(F.col("vector")).alias("vector"))
    return rows.mapInArrow(placed, f"key {dict(rows.dtypes)['key']}, vector array<double>, far double, cell int"), centres


class Cells(NamedTuple):
    """An index of vectors: a table in runs sorted by cell; centre, radius and size of each cell that has vectors. The cell
    APART has no centre and is always read."""

    path: str
    centres: dict[int, list[float]]
    radii: dict[int, float]
    sizes: dict[int, int]


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key long, vector array<double>, far double, cell int").parquet(path)


def write_cells(vectors: DataFrame, path: str, k: int, key: str = "id", vector: str = "vector", seed: int = 3) -> Cells:
    """Nothing is shuffled: each task writes its own vectors sorted by cell, in small row groups, so that there are as many
    files as tasks, not as cells, and a search reads the row groups of its cells."""
    found, centres = cells(vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")), k, seed)
    found.sortWithinPartitions("cell").write.mode("overwrite").option("parquet.block.size", CELL_GROUP).parquet(path)
    rows = read_cells(vectors.sparkSession, path).groupBy("cell").agg(F.max("far").alias("r"), F.count("*").alias("n")).collect()  # k rows
    radii = {r["cell"]: float("inf") if r["cell"] == APART else r["r"] for r in rows}
    return Cells(path, {c: centres[c].tolist() for c in radii if c != APART}, radii, {r["cell"]: r["n"] for r in rows})


def search_cells(spark: SparkSession, index: Cells, q: Sequence[float], k: int, key: str = "id") -> tuple[DataFrame, list[int]]:
    """The k nearest, as by `vector_topk`, and the cells that were read.

    The nearest cells that hold k vectors give a bound; of the others only those are read whose centre less their radius
    lies within it, so the result is exact. Equal scores make the bound inclusive, so ties are those of the scan.
    """
    rows = read_cells(spark, index.path)
    norm = sum(x * x for x in q) ** 0.5
    if not norm or not index.sizes:
        return rows.where(F.lit(False)).select(F.col("key").alias(key), F.lit(0.0).alias("score")), []
    unit = [x / norm for x in q]
    far = {c: sum((x - y) ** 2 for x, y in zip(unit, centre, strict=True)) ** 0.5 for c, centre in index.centres.items() if len(centre) == len(q)}
    order, first, n = sorted(far, key=far.get), [], 0
    while order and n < k:
        first.append(order.pop(0))
        n += index.sizes[first[-1]]
    within = lambda some: vector_topk(rows.where(F.col("cell").isin(some)), q, k, "key")
    bound = float("inf")
    if n >= k and order:
        worst = within(first).agg(F.min("score")).head()[0]  # of k rows
        bound = (max(0.0, 2 - 2 * worst) ** 0.5) + 1e-6
    read = first + [c for c in order if far[c] - index.radii[c] <= bound] + [APART] * (APART in index.sizes)
    return within(read).select(F.col("key").alias(key), "score"), read


def nearest_by_cells(spark: SparkSession, index: Cells, docs: DataFrame, k: int, deal: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Lateral top-k through an index: (doc, vector) -> doc, chunk, score, as by `nearest_of_each`; and the pairs of doc and
    cell that were met (doc, cell, size), for the count of what was compared.

    A row's bound comes from its nearest cells: those that hold k vectors, nearest first, are met and the k-th best distance
    there is the bound. Then the row meets only cells whose centre less their radius lies within it, so nothing is lost.
    Both steps are joins on the cell's number; a large cell is dealt to many tasks, of `deal` vectors each. The centres,
    ann_lists of them, are part of the plan.
    """
    rows = read_cells(spark, index.path)
    asked = docs.select("doc", doubles("vector").alias("v")).where(dot(F.col("v"), F.col("v")) > 0)
    if not index.sizes:
        return rows.where(F.lit(False)).select(F.lit(0).cast("long").alias("doc"), F.col("key").alias("chunk"), F.lit(0.0).alias("score")), asked.where(F.lit(False)).select("doc", F.lit(0).alias("cell"), F.lit(0).alias("size"))
    #: cells of the index, nearest first: (distance, cell, radius, size); the cell APART is behind all others
    names = np.array([*index.centres, *[APART] * (APART in index.sizes)])
    centres = np.array([*index.centres.values()]).reshape(len(index.centres), -1)
    radii, sizes = np.array([index.radii[c] for c in names]), np.array([index.sizes[c] for c in names])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), STEP):
                part = batch.slice(i, STEP)
                v, _, norms = _matrix(part.column("v"))
                with np.errstate(all="ignore"):
                    v = np.pad(v / norms[:, None], ((0, 0), (0, centres.shape[1])))[:, : centres.shape[1]]
                far = np.full((len(v), len(names)), 1e9)
                for j, c in enumerate(centres):
                    far[:, j] = np.sqrt(((v - c) ** 2).sum(axis=1))
                lists = [[{"d": d[j], "cell": names[j], "r": radii[j], "size": sizes[j]} for j in np.argsort(d, kind="stable")] for d in far]
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("v"), pa.array(lists, pa.list_(pa.struct([("d", pa.float64()), ("cell", pa.int32()), ("r", pa.float64()), ("size", pa.int64())])))], names=["doc", "v", "cells"])

    cells_ = asked.mapInArrow(placed, f"doc {dict(asked.dtypes)['doc']}, v array<double>, cells array<struct<d: double, cell: int, r: double, size: long>>")
    before = F.transform("cells", lambda _, i: F.aggregate(F.slice("cells", 1, i), F.lit(0).cast("long"), lambda s, x: s + x["size"]))
    cells_ = cells_.withColumn("before", before)
    first = F.filter("cells", lambda x, i: F.get("before", i) < k)
    deals = F.create_map(*(F.lit(x) for c, n in index.sizes.items() for x in (c, max(1, -(-n // deal)))))
    groups = -(-docs.count() // BLOCK) or 1
    held = rows.withColumn("deal", F.pmod(F.xxhash64("key"), deals[F.col("cell")]).cast("int")).select("cell", "deal", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.col("key").alias("chunk"), F.col("vector").alias("w"))

    def met(some: DataFrame) -> DataFrame:
        """doc, v, cell -> the best k of each doc in the cells it meets."""
        dealt = some.select("doc", "v", "cell", F.explode(F.sequence(F.lit(0), deals[F.col("cell")] - 1)).alias("deal"), F.pmod(F.xxhash64("doc"), F.lit(groups)).cast("int").alias("group"))
        scored = best_of_blocks(dealt, held, k, ["cell", "deal", "group"]).where("score IS NOT NULL")
        return scored.withColumn("at", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "chunk"))).where(F.col("at") <= k).select("doc", "chunk", "score")

    near = cells_.select("doc", "v", F.explode(first).alias("c")).select("doc", "v", "c.cell")
    found = settle(met(near).select("doc", "chunk", "score"))
    #: of k unit vectors the worst cosine gives the distance; rows with fewer meet all cells
    bound = found.groupBy("doc").agg(F.when(F.count("*") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("score"))) + 1e-6).alias("bound"))
    wide = cells_.join(bound, "doc", "left")
    more = F.filter("cells", lambda x, i: (F.get("before", i) >= k) & (x["d"] - x["r"] <= F.coalesce(F.col("bound"), F.lit(float("inf")))))
    rest = wide.select("doc", "v", F.explode(more).alias("c")).select("doc", "v", "c.cell", "c.size")
    both = found.unionByName(met(rest.drop("size")).select("doc", "chunk", "score"))
    best = both.withColumn("at", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "chunk"))).where(F.col("at") <= k).drop("at")
    size = F.create_map(*(F.lit(x) for c, n in index.sizes.items() for x in (c, n)))
    return best, near.select("doc", "cell", size[F.col("cell")].alias("size")).unionByName(rest.select("doc", "cell", "size"))
