"""Substring and regular-expression search through an index of trigrams.

Texts are lower-cased, and of their UTF-8 bytes every three neighbours are a gram. The index holds, by gram and key, the
places of the gram (in runs sorted by gram, one for each step of a task over its texts), the number of texts of each gram,
and the texts themselves in parts by a hash of the key.

A search first works out what a text must hold: for a pattern, sets of literals of which each set has a member in every
text that matches. Of a literal's grams the rarest are looked up; keys that have them all, at places that fit each other,
are candidates. Only the parts that hold candidates are read, and only the candidates' texts meet the pattern itself, so
that results are those of a scan. A pattern that needs no literal of three bytes is searched by a scan of all parts.

Defined results: null texts match nothing; rows without a key aren't indexed; rows of one key are searched one by one;
an empty literal is in every text; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from re import _constants as sre
from re import _parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Literals of which a text must hold one; several sets must all be met.
Needs = list[frozenset[str]]
#: Bytes of texts that one vectorised step of the build works on; grams of a literal that are looked up, at most.
STEP_BYTES, LOOKED_UP = 2 << 20, 4
#: Bytes of a row group of the postings, about a step's.
GROUP_BYTES = 16 << 20


class GramIndex(NamedTuple):
    path: str
    parts: int
    key_type: str

    def read(self, spark: SparkSession, what: str) -> DataFrame:
        columns = {"postings": "gram int, key {}, places array<int>", "grams": "gram int, n long", "texts": "key {}, text string, part int"}
        return spark.read.schema(columns[what].format(self.key_type)).parquet(f"{self.path}/{what}")


# -- building --------------------------------------------------------------------------------------------------------


def _grams_of(text: bytes) -> list[int]:
    return [text[i] << 16 | text[i + 1] << 8 | text[i + 2] for i in range(len(text) - 2)]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text -> gram, key, places: a row for each gram of each text."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP_BYTES, side="right")) - 1)
            yield _step(data[offsets[i] : offsets[j]].astype(np.int64), offsets[i : j + 1] - offsets[i], batch.column("key").slice(i, j - i))
            i = j


def _step(data: np.ndarray, starts: np.ndarray, keys: pa.Array) -> pa.RecordBatch:
    row = np.repeat(np.arange(len(keys)), np.diff(starts))
    inside = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    gram, row = data[inside] << 16 | data[inside + 1] << 8 | data[inside + 2], row[inside]
    order = np.lexsort((row, gram))  # stable, so places stay in order
    gram, row, place = gram[order], row[order], (inside - starts[row])[order]
    first = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])]) if len(gram) else np.zeros(0, np.int64)
    places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(gram)].astype(np.int32)), pa.array(place.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(gram[first].astype(np.int32)), keys.take(pa.array(row[first])), places], names=["gram", "key", "places"])


def write_grams(docs: DataFrame, path: str, key: str = "id", text: str = "content", parts: int = 64) -> GramIndex:
    """Build the index in a folder that driver and executors share. `parts` is the number of parts that texts lie in: the
    more, the less is read for a few candidates."""
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    lower = rows.select("key", F.lower("text").alias("text"))
    index = GramIndex(path, parts, dict(rows.dtypes)["key"])
    found = lower.mapInArrow(_postings, f"gram int, key {index.key_type}, places array<int>")
    #: nothing is shuffled: each task writes its own texts' grams in sorted runs, in small row groups
    found.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).option("compression", "zstd").parquet(f"{path}/postings")
    index.read(docs.sparkSession, "postings").groupBy("gram").agg(F.count("*").alias("n")).sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")
    rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).repartition("part").write.option("compression", "zstd").mode("overwrite").partitionBy("part").parquet(f"{path}/texts")
    return index


# -- what a text must hold -------------------------------------------------------------------------------------------


def words_need(words: Iterable[str]) -> Needs:
    """A text that holds one of the words, in any case."""
    return [frozenset(w.lower() for w in words)]


def like_needs(pattern: str) -> Needs:
    """A text that is LIKE the pattern: every run of it between wildcards; a backslash takes the next character as it is."""
    runs, run, i = [], "", 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            run, i = run + pattern[i + 1], i + 2
            continue
        if pattern[i] in "%_":
            runs.append(run)
            run = ""
        else:
            run += pattern[i]
        i += 1
    return [frozenset([r.lower()]) for r in [*runs, run] if r]


def regex_needs(pattern: str) -> Needs:
    """A text that a regular expression is found in. A syntax that isn't understood here needs nothing."""
    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return []
    if tree.state.flags & re.VERBOSE:
        return []
    return [frozenset(x.lower() for x in some) for some in _needs(tree)]


def _needs(tree) -> Needs:
    out: Needs = []
    run = ""

    def end() -> None:
        nonlocal run
        #: a sigma is lower-cased by what stands beside it
        out.extend(frozenset([x]) for x in run.split("Σ") if x)
        run = ""

    for kind, arg in tree:
        if kind is sre.LITERAL:
            run += chr(arg)
        elif kind is sre.AT:
            continue
        elif kind is sre.SUBPATTERN and not arg[1] and not arg[2] and all(k is sre.LITERAL for k, _ in arg[3]):
            run += "".join(chr(a) for _, a in arg[3])
        else:
            end()
            if kind is sre.SUBPATTERN and not arg[2]:
                out += _needs(arg[3])
            elif kind is sre.BRANCH:
                out += _either([_needs(x) for x in arg[1]])
            elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] >= 1:
                out += _needs(arg[2])
            elif kind is sre.ATOMIC_GROUP:
                out += _needs(arg)
            #: classes, wildcards, options and looks ahead or back need nothing
    end()
    return out


def _either(ways: list[Needs]) -> Needs:
    """Each way needs its own literals: one of the best of each, if every way has one."""
    best = [max(some, key=lambda s: min(map(len, s))) if some else None for some in ways]
    return [] if None in best else [frozenset().union(*best)]


# -- searching -------------------------------------------------------------------------------------------------------


def _sizes(spark: SparkSession, index: GramIndex, grams: set[int]) -> dict[int, int]:
    """In how many texts grams stand: as many rows as the patterns have grams."""
    found = index.read(spark, "grams").where(F.col("gram").isin(sorted(grams))).collect() if grams else []
    return {g: 0 for g in grams} | {r["gram"]: r["n"] for r in found}


def _less(places: str, n: int) -> Column:
    return F.transform(places, lambda p: p - n)


def _holders(postings: DataFrame, literal: bytes, sizes: dict[int, int]) -> DataFrame:
    """Keys whose lower-cased text has the literal's rarest grams at places that fit, from the rarest on."""
    at = sorted(((g, i) for i, g in enumerate(_grams_of(literal))), key=lambda x: (sizes[x[0]], x[1]))[:LOOKED_UP]
    out = None
    for gram, i in at:
        one = postings.where(F.col("gram") == gram).select("key", _less("places", i).alias("begins"))
        if out is None:
            out = one
        else:
            both = out.join(one.withColumnRenamed("begins", "more"), "key")
            out = both.select("key", F.array_intersect("begins", "more").alias("begins")).where(F.size("begins") > 0)
    return out.select("key")


def candidates(spark: SparkSession, index: GramIndex, needs: Needs) -> DataFrame | None:
    """Keys of the texts that may meet all needs, each once; None if nothing that is needed has three bytes.

    Of several sets, the one with the fewest texts is looked up, and another only if it is as rare: others narrow little
    and cost their postings.
    """
    usable = [sorted({x.encode() for x in some}) for some in needs]
    usable = [some for some in usable if min(map(len, some)) >= 3]
    if not usable:
        return None
    sizes = _sizes(spark, index, {g for some in usable for x in some for g in _grams_of(x)})
    cost = [sum(min(sizes[g] for g in _grams_of(x)) for x in some) for some in usable]
    order = sorted(range(len(usable)), key=lambda i: (cost[i], i))
    postings = index.read(spark, "postings")
    out = None
    for i in order[:1] + [i for i in order[1:3] if cost[i] <= 4 * cost[order[0]]]:
        one = reduce(lambda a, b: a.union(b), (_holders(postings, x, sizes) for x in usable[i])).distinct()
        out = one if out is None else out.join(one, "key", "left_semi")
    return out


def texts_of(spark: SparkSession, index: GramIndex, needs: Needs) -> DataFrame:
    """key, text of the candidates. At most `parts` numbers of parts come to the driver, so that no other part is read."""
    texts = index.read(spark, "texts")
    found = candidates(spark, index, needs)
    if found is None:
        return texts.select("key", "text")
    parts = found.select(F.pmod(F.xxhash64("key"), F.lit(index.parts)).cast("int").alias("part")).distinct().collect()
    return texts.where(F.col("part").isin([r["part"] for r in parts])).join(found, "key", "left_semi").select("key", "text")


def search_like(spark: SparkSession, index: GramIndex, pattern: str, key: str = "id") -> DataFrame:
    """Keys of texts ILIKE the pattern."""
    return texts_of(spark, index, like_needs(pattern)).where(F.col("text").ilike(pattern)).select(F.col("key").alias(key))


def search_regex(spark: SparkSession, index: GramIndex, pattern: str, key: str = "id") -> DataFrame:
    """Keys and texts of texts in which the regular expression is found."""
    return texts_of(spark, index, regex_needs(pattern)).where(F.col("text").rlike(pattern)).select(F.col("key").alias(key), F.col("text").alias("content"))


def search_words(spark: SparkSession, index: GramIndex, words: Iterable[str], key: str = "id") -> DataFrame:
    """Keys and texts of texts that hold one of the words as a part, in any case."""
    words = sorted({w.lower() for w in words})
    held = reduce(lambda a, b: a | b, (F.contains(F.lower("text"), F.lit(w)) for w in words), F.lit(False))
    return texts_of(spark, index, words_need(words) if words else []).where(held).select(F.col("key").alias(key), F.col("text").alias("content"))


def match_rules(spark: SparkSession, index: GramIndex, rules: Iterable[tuple[str, str, str]], key: str = "id") -> DataFrame:
    """Rules (name, kind, pattern), kind LIKE, ILIKE or REGEX -> rule, key: each rule meets its own candidates only; rules
    that need no literal share one scan."""
    spread: list[tuple[str, Column]] = []
    parts = []
    for name, kind, pattern in rules:
        needs = regex_needs(pattern) if kind == "REGEX" else like_needs(pattern)
        text = F.col("text")
        fits = text.rlike(pattern) if kind == "REGEX" else text.ilike(pattern) if kind == "ILIKE" else text.like(pattern)
        if any(min(len(x.encode()) for x in some) >= 3 for some in needs):
            parts.append(texts_of(spark, index, needs).where(fits).select(F.lit(name).alias("rule"), F.col("key").alias(key)))
        else:
            spread.append((name, fits))
    if spread:
        hit = F.array_compact(F.array(*(F.when(fits, F.lit(name)) for name, fits in spread)))
        parts.append(texts_of(spark, index, []).select(F.explode(hit).alias("rule"), F.col("key").alias(key)))
    return reduce(lambda a, b: a.unionByName(b), parts)
