"""Document fingerprints by context-triggered piecewise hashing, and their likeness.

A rolling hash over the last `WINDOW` bytes cuts a text wherever it falls on a multiple of the block size; each chunk
gives one base-64 character of its hash. The block size (a power of two times `SMALLEST`) is the smallest at which the
signature has at most `LENGTH` characters; a second signature at twice that size makes neighbouring sizes comparable.
A fingerprint reads `block:signature:signature at twice the block`. Likeness is 1 - (edit distance / longer length),
the better of the block sizes that both have, and 0 if no size or no run of `SHARED` characters is common.

Defined results: null is the empty text, whose fingerprint is `3::`; equal texts have equal fingerprints and likeness 1,
two empty ones too; rows that share a doc_id follow each other by a hash of the text, those without one come last; the only
row of a table is its own next; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bytes_of, prefix_sums, settle, slices, span_hash

WINDOW, SMALLEST, LENGTH, SHARED = 7, 3, 64, 4
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def _signature(sums: np.ndarray, cuts: np.ndarray, n: int) -> str:
    begin = np.concatenate([[0], cuts])
    end = np.append(cuts, n)
    if begin[-1] == n:
        begin, end = begin[:-1], end[:-1]
    return DIGITS[(span_hash(sums, begin, end) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(data: np.ndarray) -> str:
    """The fingerprint of a text's bytes."""
    n = len(data)
    if not n:
        return f"{SMALLEST}::"
    sums = prefix_sums(data)
    if n >= WINDOW:
        at = np.arange(n - WINDOW + 1)
        #: trailing zeros of an evenly spread value: a cut at block size SMALLEST * 2**k needs k of them, and a third
        roll = span_hash(sums, at, at + WINDOW)
        cuts = at[roll % np.uint64(SMALLEST) == 0] + WINDOW
        roll = (roll // np.uint64(SMALLEST))[cuts - WINDOW]
    else:
        cuts, roll = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    k = 0
    kept = cuts[cuts < n]
    roll = roll[cuts < n]
    while len(kept) + 1 > LENGTH:
        k += 1
        even = roll & np.uint64((1 << k) - 1) == 0
        kept, roll = kept[even], roll[even]
    twice = kept[roll & np.uint64((2 << k) - 1) == 0]
    return f"{SMALLEST << k}:{_signature(sums, kept, n)}:{_signature(sums, twice, n)}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a bit per character of `a` (Myers 1999; Hyyrö 2003)."""
    m = len(a)
    if not m or not b:
        return m + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    for c in b:
        eq = where.get(c, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if plus & last:
            distance += 1
        elif minus & last:
            distance -= 1
        plus = (plus << 1 | 1) & full
        up = ((minus << 1) & full) | (full & ~(diagonal | plus))
        down = diagonal & plus
    return distance


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    grams = {a[i : i + SHARED] for i in range(len(a) - SHARED + 1)}
    if not any(b[i : i + SHARED] in grams for i in range(len(b) - SHARED + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    (x, x1, x2), (y, y1, y2) = a.split(":"), b.split(":")
    x, y = int(x), int(y)
    pairs = [(x1, y1), (x2, y2)] if x == y else [(x1, y2)] if x == 2 * y else [(x2, y1)] if y == 2 * x else []
    return max((_alike(s, t) for s, t in pairs if s and t), default=0.0)


def add_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n_chars, fingerprint; one pass without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts = bytes_of(part.column("text"))
                prints = [fingerprint(data[i:j]) for i, j in zip(starts[:-1], starts[1:], strict=True)]
                chars = pc.utf8_length(part.column("text").fill_null("")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), chars, pa.array(prints, pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return _two(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _two(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def with_next(docs: DataFrame, run: Callable[[Iterator[tuple]], Iterator[tuple]], out: str, buckets: int | None = None) -> DataFrame:
    """Apply `run` to (doc_id, text, text of the next document) in descending doc_id; after the last comes the first.

    Texts are shuffled once, into ranges of doc_id whose bounds Spark samples; rows with one doc_id are ranged by their
    text's hash, and copies of one row, among which no order matters, by their place in the input, so no key fills a
    range. A range works by itself, but for its last document: its text, and that of its first one, come out with the
    results, two a range, and what is open is matched in a second step. The driver sees the ranges' numbers.
    """
    spark = docs.sparkSession
    n = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h").desc(), F.col("i")]
    keyed = _two(docs).withColumns({"h": F.xxhash64("text"), "i": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    names, kinds = [c.split()[0] for c in out.split(", ")], [_ARROW[c.split()[1]] for c in out.split(", ")]
    edges = "part int, edge string, whole string"

    def made(rows: list[tuple], extra: list[tuple]) -> pa.RecordBatch:
        columns = zip(*(r + e for r, e in zip(rows, extra, strict=True)), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*kinds, pa.int32(), pa.string(), pa.string()], strict=True)], names=[*names, "part", "edge", "whole"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ends = TaskContext.get().partitionId(), []

        def pairs() -> Iterator[tuple]:
            held = None
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if held:
                        yield held[0], held[1], text or ""
                    else:
                        ends.append((doc, text or "", "first"))
                    held = (doc, text or "")
            if held:
                ends.append((*held, "last"))

        rows: list[tuple] = []
        for row in run(pairs()):
            rows.append(row)
            if len(rows) == 1000:
                yield made(rows, [(part, None, None)] * len(rows))
                rows = []
        rows, extra = rows + [(doc, *[None] * (len(names) - 1)) for doc, *_ in ends], [(part, None, None)] * len(rows) + [(part, e, text) for _, text, e in ends]
        if rows:
            yield made(rows, extra)

    found = settle(ordered.mapInArrow(inside, f"{out}, {edges}"))
    open_ = found.where("edge IS NOT NULL").select("doc_id", "part", "edge", "whole")
    parts = sorted(r["part"] for r in open_.where("edge = 'first'").select("part").collect())  # a number a range
    if not parts:
        return found.select(*names)
    seats = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, following int")
    heads = open_.where("edge = 'first'").select(F.col("part").alias("following"), F.col("whole").alias("next_text"))
    last = open_.where("edge = 'last'").join(F.broadcast(seats), "part").join(heads, "following").select("doc_id", "whole", "next_text")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(run(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "whole", "next_text")), strict=True)))
            if rows:
                yield made(rows, [(None, None, None)] * len(rows))

    return found.where("edge IS NULL").select(*names).unionByName(last.mapInArrow(across, f"{out}, {edges}").select(*names))


def edited(text: str, following: str) -> str:
    """The last half of a text, rounded down, replaced by as many first characters of the following one (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        ready: tuple[str, str] | None = None  # the next document's fingerprint serves again when its turn comes
        for doc, text, following in rows:
            own = ready[1] if ready and ready[0] == text else fingerprint(np.frombuffer(text.encode(), np.uint8))
            ready = (following, fingerprint(np.frombuffer(following.encode(), np.uint8)))
            changed = edited(text, following).encode()
            other = fingerprint(np.frombuffer(changed, np.uint8))
            yield doc, len(text), hashlib.sha256(changed).hexdigest(), own, other, likeness(own, other), likeness(own, ready[1])

    return with_next(docs, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", buckets)
