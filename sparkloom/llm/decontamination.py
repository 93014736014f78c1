"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed, grams of K words hashed from them by doubling, and of every WINDOWS neighbouring grams the least hash
is kept: K + WINDOWS - 1 words, shared by a document and an item, always share a kept hash. An item of fewer words has one
gram, of all its words, and documents keep all their grams of that length. Documents that share a kept hash with an item
are candidates; in them, hits are extended: each run of LENGTH words (or of a short item's) is held against the items'
windows by two hashes of 64 bits.

Texts are split once to find candidates. Hashes that can't be the benchmark's, by a bitmap of 65,536 bits, go before rows
are made of them. The rest meets the benchmark's in a join; the benchmark is broadcast only up to a number of rows, else
both sides are shuffled by hash and hot hashes are dealt to many tasks. Windows with the same items are one set, and
documents with the same sets one class, so ids of items are gathered once a class, not once a document and window.

Defined results: null texts have no words; an item without words has no window, an item of fewer than LENGTH words is one
window; items with the same id count once; rows with the same doc_id are told apart by their text; an empty benchmark
hits nothing; other columns are ignored; a null item_id isn't counted among the items, though its words are hit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import join_hot, settle

LENGTH, K, WINDOWS = 10, 8, 3
#: Benchmark rows up to which it is broadcast (40 bytes each at most: 80 MB).
BROADCAST_ROWS = 2_000_000
#: Bits of the bitmap, as a power of two.
BITMAP = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII that is neither letter nor digit stands between words.
_GAPS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words_of(text: Column) -> Column:
    """One pass turns gaps to blanks and A-Z to a-z; splitting at a blank needs no regular expression."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _GAPS, _LOWER + " " * len(_GAPS))
    return F.array_remove(F.split(plain, " "), "")


def _pair(a: str, b: str, shift: int, f: Callable[[Column, Column], Column]) -> Column:
    """f of a[i] and b[i + shift], for all i that both have."""
    n = F.greatest(F.size(b) - F.lit(shift), F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, shift + 1, n), f)


def _grams(df: DataFrame, seed: int) -> DataFrame:
    """Add w1, w2, w4, w8: hashes of 1, 2, 4 and 8 words from each position on."""
    h = lambda x, y: F.xxhash64(x, y)
    df = df.withColumn("w1", F.transform("words", lambda w: F.xxhash64(F.lit(seed), w)))
    for k in (1, 2, 4):
        df = df.withColumn(f"w{2 * k}", _pair(f"w{k}", f"w{k}", k, h))
    return df


def _from_grams(df: DataFrame, lengths: list[int], name: str) -> DataFrame:
    """Add, for each length, the hashes of every run of as many words, put together from grams."""
    for n in lengths:
        have, at = None, 0
        for k in (8, 4, 2, 1):
            if n & k:
                df = df.withColumn(f"{name}{n}", F.col(f"w{k}") if have is None else _pair(f"{name}{n}", f"w{k}", at, lambda x, y: F.xxhash64(x, y)))
                have, at = k, at + k
    return df


def _runs(df: DataFrame, lengths: list[int], name: str, seed: int) -> DataFrame:
    keep = df.columns
    return _from_grams(_grams(df, seed), lengths, name).select(*keep, *(f"{name}{n}" for n in lengths))


def kept_hashes(df: DataFrame, lengths: list[int], own: Column | None = None) -> DataFrame:
    """words -> also kept: if LENGTH is asked for, the least gram hash of every window; for lower lengths, all grams; each
    once. `own` says the only length that counts in a row."""
    keep = df.columns
    df = _grams(df, 1)
    found = {}
    if LENGTH in lengths:
        df = df.withColumn("m2", _pair("w8", "w8", 1, lambda x, y: F.least(x, y))).withColumn("m3", _pair("m2", "m2", 1, lambda x, y: F.least(x, y)))
        found[LENGTH] = "m3"
    short = [n for n in lengths if n < LENGTH]
    if short:
        df = _from_grams(df, short, "r")
        found |= {n: f"r{n}" for n in short}
    some = F.concat(*found.values()) if own is None else _of_length(own, found)
    return df.select(*keep, F.array_distinct(some).alias("kept"))


def _of_length(own: Column, columns: dict[int, str]) -> Column:
    return F.coalesce(*(F.when(own == n, F.col(c)) for n, c in columns.items()))


def _bitmap(hashes: DataFrame, column: str) -> Callable[[Column], Column]:
    """Whether a hash may be one of a table's, by a bitmap of fixed size that is part of the plan."""
    bit = lambda h: h.bitwiseAND(F.lit((1 << BITMAP) - 1))
    one = F.col(column)
    rows = hashes.groupBy(F.shiftright(bit(one), 6).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(one).bitwiseAND(F.lit(63)).cast("int"))).alias("w")).collect()
    found = np.zeros(1 << (BITMAP - 6), np.int64)
    for r in rows:
        found[r["i"]] = r["w"]
    words = F.lit(found)
    return lambda h: F.getbit(F.get(words, F.shiftright(bit(h), 6).cast("int")), bit(h).bitwiseAND(F.lit(63)).cast("int")) == 1


def _meet(left: DataFrame, right: DataFrame, on: list[str], spread: str, most: int, how: str = "inner") -> DataFrame:
    """Join with rows of the benchmark, broadcast only up to `most` of them; else hot keys are dealt to many tasks."""
    if right.count() <= most:
        return left.join(F.broadcast(right), on, how)
    left = settle(left)
    return join_hot(left, right.join(left.groupBy(*on).agg(F.count("*").alias("__n")), on), on, F.col(spread), how)


def _spots(n: int) -> Column:
    """The runs of n words: where they begin, their length and their two hashes."""
    return F.transform(f"a{n}", lambda x, i: F.struct(i.alias("at"), F.lit(n).alias("n"), x.alias("a"), F.get(f"b{n}", i).alias("b")))


def _key(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))


def find_hits(docs: DataFrame, benchmark: DataFrame, most: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """doc_id, text; item_id, text -> documents (doc_id, th, n_words), hits (doc_id, th, places, sets; None if the benchmark
    has no windows) and the benchmark's windows (n, a, b, set, item_id). th is a hash of the text."""
    docs, key = _key(docs), ["doc_id", "th"]
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text").cast("string")).alias("words"))
    items = settle(items.withColumn("n", F.least(F.size("words"), F.lit(LENGTH))).where("n > 0"))
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # LENGTH rows at most
    words = words_of(F.col("text"))
    if not lengths:
        return docs.select(*key, F.size(words).cast("long").alias("n_words")), None, items.select("n", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(None).alias("set"), "item_id")
    n, hashed = F.col("n"), _runs(_runs(items, lengths, "a", 2), lengths, "b", 3)
    both = F.arrays_zip(*(_of_length(n, {k: f"{c}{k}" for k in lengths}).alias(c) for c in "ab"))
    windows = hashed.select("item_id", "n", F.inline(both))
    fingerprints = kept_hashes(items, lengths, n).select(F.explode("kept").alias("h"))
    windows, fingerprints = settle(windows.distinct()), settle(fingerprints.distinct())
    #: windows of the same items are one set, named by a hash of the ids that doesn't depend on their order
    name = F.struct(F.bit_xor(F.xxhash64("item_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "item_id")).alias("y"), F.count("*").alias("c"))
    sets = settle(windows.groupBy("n", "a", "b").agg(name.alias("set")))

    may = _bitmap(fingerprints, "h")
    first = kept_hashes(docs.select(*key, words.alias("words")), lengths)
    first = settle(first.select(*key, F.size("words").cast("long").alias("n_words"), F.filter("kept", may).alias("kept")))
    candidates = settle(_meet(first.select(*key, F.explode("kept").alias("h")), fingerprints, ["h"], "th", most, "left_semi").select(*key).distinct())
    again = docs.alias("d").join(candidates.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.th") == F.col("c.th")), "left_semi").dropDuplicates(key)
    runs = _runs(_runs(again.select(*key, words.alias("words")), lengths, "a", 2), lengths, "b", 3)
    may = _bitmap(sets, "a")
    runs = runs.select(*key, F.inline(F.concat(*(F.filter(_spots(n), lambda s: may(s["a"])) for n in lengths))))
    hits = _meet(runs, sets, ["n", "a", "b"], "at", most)
    #: sets are built in each task before the shuffle; a document's are no larger than it and the benchmark
    hits = hits.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("places"), F.array_sort(F.collect_set("set")).alias("sets"))
    return first.select(*key, "n_words"), settle(hits), windows.join(sets, ["n", "a", "b"])


def covered(places: Column) -> Column:
    """Words under at least one of the sorted (at, n)."""
    state = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    step = lambda s, p: F.struct((s["sum"] + F.greatest(F.lit(0), p["at"] + p["n"] - F.greatest(s["end"], p["at"]))).alias("sum"), F.greatest(s["end"], p["at"] + p["n"]).alias("end"))
    return F.aggregate(places, state, step, lambda s: s["sum"])


def contamination(docs: DataFrame, benchmark: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A row for each document: n_words, n_hit, n_items, items_sha256, contaminated, places."""
    base, hits, windows = find_hits(docs, benchmark, most)
    none = F.array().cast("array<string>")
    if hits is None:
        hits = base.select("doc_id", "th", F.array().cast("array<struct<at: int, n: int>>").alias("places"), none.alias("items")).where(F.lit(False))
    else:
        #: one row of a set stands for it; a class is all documents with the same sets
        of_set = windows.groupBy("set").agg(F.min(F.struct("n", "a", "b")).alias("w")).select("set", "w.*")
        of_set = windows.drop("set").join(of_set, ["n", "a", "b"]).where(F.col("item_id").isNotNull()).select("set", "item_id")
        hits = hits.withColumn("class", F.sha2(F.to_json("sets"), 256))
        classes = settle(hits.groupBy("class").agg(F.first("sets").alias("sets"), F.count("*").alias("__n")))
        items = classes.select("class", F.explode("sets").alias("set")).join(of_set, "set").groupBy("class").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        right = classes.select("class", "__n").join(items, "class", "left").withColumn("items", F.coalesce("items", none))
        hits = join_hot(hits.drop("sets"), right, ["class"], F.col("th"))
    out = base.alias("d").join(hits.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.th") == F.col("f.th")), "left")
    n_hit = F.coalesce(covered(F.col("places")), F.lit(0)).cast("long")
    items = F.coalesce(F.col("items"), none)
    return out.select(F.col("d.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "places")


def clean_of(docs: DataFrame, benchmark: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The documents, with all their columns, in which no benchmark window occurs."""
    _, hits, _ = find_hits(docs, benchmark, most)
    if hits is None:
        return docs
    d = docs.withColumn("__th", F.xxhash64("text")).alias("d")
    f = hits.select("doc_id", "th").alias("f")
    return d.join(f, F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.__th") == F.col("f.th")), "left_anti").drop("__th")
