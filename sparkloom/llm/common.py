"""What the training-data operators share: shared storage, byte buffers of Arrow strings, vectorised hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; longer single texts are taken whole.
STEP_BYTES = 1 << 20

#: Odd multiplier of the polynomial hash modulo 2**64 and its inverse.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A random 64-bit value for each byte.
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). Only a local session, where the
    driver is the executor, may do without the setting; a cluster without it is refused."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="sparkloom-")
        shared_dir.own = top
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/sparkloom-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows go to a Parquet table in the shared folder, so that later reads survive a lost executor.

    What the write shuffled is read no more, so Spark removes those files with the end of the write. The table goes with
    the end of the application, or by `discard` before.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _file_system(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove settled tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _file_system(df.sparkSession, path).delete(df.sparkSession._jvm.org.apache.hadoop.fs.Path(path), True)


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def join_hot(left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str = "inner", times: int = 256, share: int = 1000) -> DataFrame:
    """Join on keys of which some hold a great part of the left side. `right` has, as `__n`, the rows that each of its keys
    has on the left (it is dropped). Keys with more than a `share`-th of them, which are fewer than `share`, are dealt to
    `times` tasks by `spread`, a column of the left; only the right side's rows of these few keys are repeated."""
    counts = right.select(*on, "__n").distinct()
    total = counts.agg(F.sum("__n")).head()[0] or 0
    right_types = {c: right.schema[c].dataType for c in on}
    #: a key is hot by a hash of it, the same on both sides; fewer than `share` keys are, by their share
    hot = [r["h"] for r in counts.where(F.col("__n") * share > total).select(F.xxhash64(*on).alias("h")).distinct().collect()]
    #: with no hot key, too, the salt stays a column, so that small and large inputs take one plan
    is_hot = F.xxhash64(*(F.col(c).cast(right_types[c]) for c in on)).isin(hot or [0])
    right, own = right.drop("__n"), [c for c in right.columns if c not in (*on, "__n")]
    a = left.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(times))).otherwise(F.lit(0).cast("long")))
    salts = F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    b = right.select(*on, *own, F.explode(salts).alias("__salt"))
    return a.join(b, [*on, "__salt"], how).drop("__salt")


def slices(batch: pa.RecordBatch, column: str, step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `step` bytes in a string column, one row at least."""
    at = batch.schema.get_field_index(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + step, side="right")))
        yield batch.slice(i, j - i)
        i = j


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column back to back, and where each row begins (one more at the end); null is empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n, at least."""
    if len(_powers.get("up", ())) < n:
        size = max(n, STEP_BYTES + (1 << 16))
        for k, b in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j]-S[i] = sum of the bytes' values times base**position; one longer than the data."""
    out = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum(_BYTE[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, equal for equal bytes wherever they stand."""
    return mix((sums[end] - sums[begin]) * powers(len(sums))[1][begin])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def words_of(data: np.ndarray, starts: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every maximal run of bytes outside `is_gap` (a table of 256), never across rows; the first word of each row, one more at the end."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = is_gap[data]
    inner = ~gap
    begin_mask = inner[1:-1] & gap[:-2]
    cut = starts[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begin_mask[cut] |= inner[1:-1][cut]
    end_mask = inner[1:-1] & gap[2:]
    end_mask[cut - 1] |= inner[1:-1][cut - 1]
    begin, end = np.flatnonzero(begin_mask), np.flatnonzero(end_mask) + 1
    return begin, end, np.searchsorted(begin, starts)


#: Gaps between words: space, and tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
