"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's size.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]), so pairwise interactions cost one
pass over a document's features. A word's feature is its presence, scaled by 1/sqrt(distinct words); a statistic is
one-hot by its bin. The model is fitted on the driver on at most `sample` labelled rows (chosen by a hash of their id)
and its size is fixed; everything is scored.

Defined results: null or empty texts have only the bins of an empty text and get a score all the same; labels without a
document or without a mark are left out, of several marks of one document the lowest counts, of several texts under one
doc_id the least is learned from; repeated rows score alike; labels without a doc_id teach nothing; whether a
row without a doc_id is held out is null; without any label every score is 0.5; other columns are ignored. Neither labels nor lang, source or doc_id are inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import LOWER, SPACES, bytes_of, prefix_sums, slices, span_hash, words_of

WORD_BITS, RANK, BINS = 15, 8, 12
#: Labelled rows that a fit takes, at most.
SAMPLE = 6000

_KIND = np.zeros(256, np.int64)
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 1, 2, 3
_KIND[[33, 35, 36, 37, 38, 42, 60, 62, 64, 94, 95, 96, 123, 124, 125, 126]] = 4
_KIND[[10, 13]] = 5
_KIND[[32, 9]] = 6
_KIND[128:] = 7
_EDGES = np.array([0.001, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 0.95])
#: Nine shares, the size by powers of two, the mean word's length and the longest.
N_STATS = 12
WIDTH = (1 << WORD_BITS) + N_STATS * BINS


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids, their values, and where each row's begin."""
    data, starts = bytes_of(texts)
    n = len(starts) - 1
    begin, end, first = words_of(data, starts, SPACES)
    row = np.repeat(np.arange(n), np.diff(first))
    sums = prefix_sums(LOWER[data])
    hashes = span_hash(sums, begin, end)
    word = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    pairs = np.unique(row << WORD_BITS | word)
    rows, ids = pairs >> WORD_BITS, pairs & ((1 << WORD_BITS) - 1)
    distinct = np.bincount(rows, minlength=n)
    values = 1 / np.sqrt(np.maximum(1, distinct))[rows]

    size = np.maximum(1, np.diff(starts))
    of = np.repeat(np.arange(n), np.diff(starts))
    kinds = np.bincount(of * 8 + _KIND[data], minlength=8 * n).reshape(n, 8)
    letters = np.maximum(1, kinds[:, 2] + kinds[:, 3] + kinds[:, 7])
    words = np.diff(first)
    length = end - begin
    mean = np.bincount(row, length, n) / np.maximum(1, words)
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    #: words that come again after another word as before: repeated lines and loops
    after = row[1:] == row[:-1]
    pair_hash = ((hashes[1:] * np.uint64(3) + hashes[:-1]) >> np.uint64(24)).astype(np.int64)[after]
    pair_row = row[1:][after]
    unique_pairs = np.bincount(np.unique(pair_row << 40 | pair_hash) >> 40, minlength=n)
    n_pairs = np.bincount(pair_row, minlength=n)
    shares = np.stack([kinds[:, 1] / size, kinds[:, 2] / letters, kinds[:, 4] / size, kinds[:, 0] / size, kinds[:, 5] / size, kinds[:, 6] / size, kinds[:, 7] / size, distinct / np.maximum(1, words), unique_pairs / np.maximum(1, n_pairs)], axis=1)
    bins = np.concatenate([np.searchsorted(_EDGES, shares, side="right"), np.stack([np.minimum(BINS - 1, np.log2(1 + words).astype(np.int64)), np.minimum(BINS - 1, mean.astype(np.int64)), np.minimum(BINS - 1, np.log2(1 + longest).astype(np.int64))], axis=1)], axis=1)
    stat_ids = (1 << WORD_BITS) + np.arange(N_STATS) * BINS + bins
    all_rows = np.concatenate([rows, np.repeat(np.arange(n), N_STATS)])
    order = np.argsort(all_rows, kind="stable")
    return np.concatenate([ids, stat_ids.ravel()])[order], np.concatenate([values, np.full(n * N_STATS, 1 / np.sqrt(N_STATS))])[order], np.concatenate([[0], np.cumsum(distinct + N_STATS)])


class FactorisationMachine:
    def __init__(self, seed: int = 5) -> None:
        self.bias, self.linear = 0.0, np.zeros(WIDTH, np.float32)
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (WIDTH, RANK)).astype(np.float32)

    def margins(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One per row; each has features, so that sums between starts are never empty."""
        values = values.astype(np.float32)
        s = np.add.reduceat(self.factors[ids] * values[:, None], starts[:-1], axis=0)
        squares = np.add.reduceat((self.factors * self.factors).sum(axis=1)[ids] * values * values, starts[:-1])
        return self.bias + np.add.reduceat(self.linear[ids] * values, starts[:-1]) + 0.5 * ((s * s).sum(axis=1) - squares)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], marks: np.ndarray, epochs: int = 6, rate: float = 0.1, decay: float = 1e-5, seed: int = 5) -> FactorisationMachine:
        """Logistic loss, AdaGrad, a document at a time in an order fixed by the seed."""
        if not len(marks):
            return self
        share = min(max(marks.mean(), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        g_bias, g_linear, g_factors = 1e-2, np.full(WIDTH, 1e-2, np.float32), np.full((WIDTH, RANK), 1e-2, np.float32)
        shuffle = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in shuffle.permutation(len(marks)):
                ids, x = rows[i]
                x = x.astype(np.float32)
                v = self.factors[ids]
                s = x @ v
                margin = self.bias + self.linear[ids] @ x + 0.5 * float(s @ s - ((v * v).sum(axis=1) * x * x).sum())
                error = np.float32(1 / (1 + np.exp(-margin)) - marks[i])
                g = error * x + decay * self.linear[ids]
                g_linear[ids] += g * g
                self.linear[ids] -= rate * g / np.sqrt(g_linear[ids])
                g = error * (x[:, None] * s - v * (x * x)[:, None]) + decay * v
                g_factors[ids] += g * g
                self.factors[ids] -= rate * 0.3 * g / np.sqrt(g_factors[ids])
                g_bias += float(error) ** 2
                self.bias -= 0.1 * rate * float(error) / g_bias**0.5
        return self


def is_held_out(doc_id: Column) -> Column:
    """The rows never learned from: one in five, by the checksum of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """Learn from at most `sample` labelled rows outside the held-out fifth."""
    marks = labels.where(F.col("quality").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("mark"))
    marks = marks.orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, values, starts = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), pa.array([ids[i:j].astype(np.int32).tobytes() for i, j in zip(starts[:-1], starts[1:], strict=True)], pa.binary()), pa.array([values[i:j].astype(np.float32).tobytes() for i, j in zip(starts[:-1], starts[1:], strict=True)], pa.binary())], names=["id", "mark", "ids", "x"])

    #: `sample` rows at most, as they are limited above
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "id")
    #: one row an id before anything is collected; repeated rows end in each task
    one = texts.groupBy("id", "mark").agg(F.min("text").alias("text"))
    rows = one.mapInArrow(run, "id long, mark int, ids binary, x binary").toPandas().sort_values("id")
    return FactorisationMachine().fit([(np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(x, np.float32)) for i, x in zip(rows["ids"], rows["x"], strict=True)], rows["mark"].to_numpy(np.float32))


def score_quality(docs: DataFrame, model: FactorisationMachine, keep: list[str] | None = None, text: bool = False) -> DataFrame:
    """docs with text -> the columns named by `keep` (doc_id; text only if `text` says so) and score; one pass without shuffle."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    assert text or "text" not in keep
    picked = docs.select(*keep, F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        for batch in batches:
            for part in slices(batch, "__text"):
                margins = fm.margins(*features(part.column("__text"))).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(margins, -60, 60))))], names=[*keep, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return picked.mapInArrow(run, StructType([*picked.schema.fields[:-1], StructField("score", DoubleType())]))
