"""Vector code compression: vectors cut into parts, each part coded by the nearest entry of its codebook.

Components become whole numbers, floor(SCALE * x), so every distance is exact and runs agree wherever rows lie. Codebooks
start as the vectors of the smallest ids and are moved by rounds of assignment and componentwise mean, rounded down.

Nearest entries are found by annular norm pruning: entries are sorted by norm, the entry of the nearest norm gives a first
distance, and since | |v| - |c| | <= |v - c|, only entries whose norm lies within that distance of the vector's can be
nearer or as near; binary search finds their interval, both ends included, and distances are computed for them alone, from
the first entry outwards, so that each nearer entry narrows the interval.

Each round is one pass that ends in sums by part, entry and component: entries * dimension rows from each task and as many
on the driver, whatever the number of vectors. Codes are a last pass; the error of a label that many vectors have is summed
before it is dealt back to them.

Defined results: vectors that are null or hold null or non-finite components go; vectors of fewer components than the
longest are filled up with zeros, as is the last part; null ids and labels stay (null ids come last in order, null labels
are one label); of equal ids the smaller vector comes first; with fewer kept vectors than entries, codebooks have as many
entries as there are vectors; ties go to the lower entry; an empty table gives no rows; other columns are ignored. Components
so large that a squared distance would not fit 63 bits are refused with an error.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import join_hot, settle

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors that one vectorised step works on.
STEP = 8192


def kept_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(column).isNotNull() & ~bad)


def whole_numbers(column: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of a list column, a row of `width` numbers each, filled up with zeros."""
    sizes = np.asarray(pc.list_value_length(column)).astype(np.int64)
    values = np.floor(np.asarray(pc.list_flatten(column)).astype(np.float64) * scale)
    if values.size and np.abs(values).max() > math.isqrt(2**63 // max(width, 1)) // 2 - 1:
        raise ValueError("vector components are too large for exact distances")
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values.astype(np.int64)
    return out


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of and squared distance to the nearest entry of each point, ties to the lower index, by norm annuli; and how
    many distances were computed."""
    norms = np.sqrt((entries * entries).sum(1).astype(np.float64))
    order = np.argsort(norms, kind="stable")
    ranks, by_norm = norms[order], entries[order]
    own = np.sqrt((points * points).sum(1).astype(np.float64))
    at = np.minimum(np.searchsorted(ranks, own), len(ranks) - 1)
    below = np.maximum(at - 1, 0)
    at = np.where(np.abs(ranks[below] - own) <= np.abs(ranks[at] - own), below, at)
    best, index, tried = ((points - by_norm[at]) ** 2).sum(1), order[at], len(points)
    #: norms are rounded, so the annulus is a little wider than it must be
    reach = lambda best, own: np.sqrt(best.astype(np.float64)) * (1 + 1e-9) + own * 1e-9 + 1e-6
    low, high = np.searchsorted(ranks, own - reach(best, own), side="left"), np.searchsorted(ranks, own + reach(best, own), side="right")
    #: from the first entry outwards, as the annulus narrows with each nearer one
    for step in range(1, int(np.maximum(at - low + 1, high - at).max(initial=1))):
        for e in (at - step, at + step):
            some = np.flatnonzero((low <= e) & (e < high))
            some = some[np.abs(ranks[e[some]] - own[some]) <= reach(best[some], own[some])]
            near = e[some]
            d = ((points[some] - by_norm[near]) ** 2).sum(1)
            better = (d < best[some]) | (d == best[some]) & (order[near] < index[some])
            best[some[better]], index[some[better]] = d[better], order[near[better]]
            tried += len(some)
    return index, best, tried


def fit_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """vec_id, embedding -> codebooks as whole numbers: parts x entries x numbers in a part."""
    kept = kept_vectors(vectors).select("vec_id", "embedding")
    longest = kept.agg(F.max(F.size("embedding"))).head()[0] or 0
    part = -(-longest // parts)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).toArrow().column("embedding").combine_chunks()
    books = np.ascontiguousarray(whole_numbers(first, parts * part, scale).reshape(len(first), parts, part).transpose(1, 0, 2))
    for _ in range(rounds if books.size else 0):
        sums = kept.select("embedding").mapInArrow(_sums(books, scale), "part int, entry int, at int, total long, n long")
        for r in sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
    return books


def _sums(books: np.ndarray, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, part = books.shape
        total, n = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                points = whole_numbers(batch.column("embedding").slice(i, STEP), parts * part, scale)
                points = points.reshape(len(points), parts, part)
                for p in range(parts):
                    index = nearest(points[:, p], books[p])[0]
                    np.add.at(total[p], index, points[:, p])
                    n[p] += np.bincount(index, minlength=entries)
        p, e, at = (x.ravel() for x in np.indices(books.shape))
        used = n[p, e] > 0
        p, e, at = p[used], e[used], at[used]
        yield pa.record_batch([pa.array(x.astype(np.int32)) for x in (p, e, at)] + [pa.array(total[p, e, at]), pa.array(n[p, e])], names=["part", "entry", "at", "total", "n"])

    return run


def encode(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id, label, embedding -> vec_id, label, code (two hex digits for each part's entry), error (squared distances
    summed over the parts)."""
    kept = kept_vectors(vectors).select("vec_id", "label", "embedding")
    kinds = dict(kept.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, part = books.shape
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                some = batch.slice(i, STEP)
                points = whole_numbers(some.column("embedding"), parts * part, scale)
                points = points.reshape(len(points), parts, part)
                found = [nearest(points[:, p], books[p]) for p in range(parts)]
                codes = np.stack([x[0] for x in found], 1).astype(np.uint8).tobytes().hex()
                codes = [codes[j : j + 2 * parts] for j in range(0, len(codes), 2 * parts)]
                yield pa.record_batch([some.column("vec_id"), some.column("label"), pa.array(codes, pa.string()), pa.array(sum(x[1] for x in found))], names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def digest(books: np.ndarray) -> str:
    """Of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, embedding, label -> vec_id, code, error, label_error (of all vectors with that label), codebooks_sha256."""
    if entries > 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    books = fit_codebooks(vectors, parts, entries, rounds)
    coded = settle(encode(vectors, books).withColumns({"__none": F.col("label").isNull(), "__label": F.coalesce(F.col("label").cast("string"), F.lit(""))}))
    on = ["__none", "__label"]
    sums = coded.groupBy(*on).agg(F.sum("error").alias("label_error"), F.count("*").alias("__n"))
    joined = join_hot(coded, sums, on, F.struct("vec_id", "code", "error"))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
