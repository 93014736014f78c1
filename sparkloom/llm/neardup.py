"""MinHash near-dedup by an inverted join over signature coordinates.

A document is the set of its shingles; documents with equal sets are one class, found by hash, and only classes go on. A
signature has COORDINATES coordinates, each of the least of THREEFOLD independent hashes over the set, so two sets agree
in one with their similarity to the power THREEFOLD. A pair is retained if MATCHES coordinates collide. So it collides in
the first COORDINATES - MATCHES + 1 (the prefix) at least once, and classes are posted under these coordinates' values
only; values that only one class has are dropped. In a list, collisions are counted by merging the members' posting lists;
the MATCHES - 1 longest of them are skipped in the merge and looked up for its candidates only.

No list emits all its pairs. First each list, in blocks, gives a spanning forest of its pairs, at most one pair a class;
they are confirmed on full sets and joined to components. Then in lists that still hold several components, pairs between
components are looked at, each in the first list that both share (by the lists' full keys): blocks of the list's largest
component meet the blocks of the others, and never each other. The classes concerned (not the pairs) are sent to one place
with their texts, and only links that join components come out. A block is bounded in classes and in shingles.

A link at similarity 0.75 is missed with a probability of 1.6e-6: that fewer than MATCHES of 48 coordinates collide, each
of which does with 0.75 ** 3. Tests measure it.

Defined results: without words a document has no shingles, links nothing and is kept; with fewer words than a shingle,
the whole sequence is one. A row is known by doc_id and a hash of its text, so rows with one doc_id and different texts
are documents of their own, and so are rows without a doc_id. Of a component the least row is kept, by doc_id, then by
the hash, null ids last; copies of that row are all marked kept. component_id is the least doc_id, null if none has one.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import LOWER, SPACES, bytes_of, discard, join_hot, mix, prefix_sums, settle, slices, span_hash, words_of
from sparkloom.llm.components import connected_components

SHINGLE, COORDINATES, THREEFOLD, MATCHES = 5, 48, 3, 6
#: Collisions of pairs that a list's forest is made of; the likelier links, others are found between components.
LIKELY = 14
#: Classes and shingles of a block; blocks meet in one task two at a time.
BLOCK, BLOCK_SHINGLES = 2048, 500_000
#: Members of a list up to which their signatures are merged coordinate by coordinate, without posting lists.
FEW = 24
#: Partners of a class that come in one row; more come in several, of which the first has the text.
PARTNERS = 512
#: What a row is known by, never null: whether it has no doc_id, the doc_id or 0, and a hash of the text.
ROW = ["_unknown", "_id", "_hash"]
_A, _B = np.random.default_rng(7).integers(0, 1 << 64, (2, COORDINATES * THREEFOLD), dtype=np.uint64)
_A |= np.uint64(1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, starts = bytes_of(texts)
    begin, end, first = words_of(data, starts, SPACES)
    words = span_hash(prefix_sums(LOWER[data]), begin, end)
    shingles = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size if len(shingles) else 0):
        shingles = shingles * np.uint64(0xD6E8FEB86659FD93) + words[j : j + len(shingles)]
    shingles = mix(shingles)
    out = []
    for i, j in zip(first[:-1], first[1:], strict=True):
        if j - i >= size:
            out.append(np.unique(shingles[i : j - size + 1]))
        elif j > i:
            whole = np.array([j - i], np.uint64)
            for w in words[i:j]:
                whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + w)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each hash over a set that isn't empty."""
    least = None
    for i in range(0, len(shingles), 2048):
        some = ((shingles[i : i + 2048, None] ^ _B) * _A).min(axis=0)
        least = some if least is None else np.minimum(least, some)
    return mix(least)


def with_row(docs: DataFrame) -> DataFrame:
    """Adds the columns of ROW."""
    ident = F.col("doc_id").cast("long")
    return docs.withColumns(dict(zip(ROW, (ident.isNull(), F.coalesce(ident, F.lit(0)), F.xxhash64(F.col("text").cast("string"))), strict=True)))


def sketch(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text -> doc_id, the columns of ROW, n, s1, s2 (hashes of the set), keys (coordinate values)."""
    salt = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                with np.errstate(over="ignore"):
                    for s in shingle_sets(part.column("text"), size):
                        if len(s):
                            least = signature(s)
                            three = least.reshape(COORDINATES, THREEFOLD)
                            keys = salt
                            for j in range(THREEFOLD):
                                keys = mix(keys * np.uint64(31) + three[:, j])
                            rows.append((len(s), int(s.sum().view(np.int64)), int(mix(s).sum().view(np.int64)), keys.view(np.int64)))
                        else:
                            rows.append((0, 0, 0, None))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *ROW)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *ROW, "n", "s1", "s2", "keys"])

    rows = with_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(run, "doc_id long, _unknown boolean, _id long, _hash long, n long, s1 long, s2 long, keys array<long>")


class Collisions:
    """Counts, for the members of a list, the coordinates in which they collide."""

    def __init__(self, values: np.ndarray, least: int) -> None:
        """values: a row of coordinate values a member; pairs of `least` collisions are retained."""
        self.values, self.least = values, least
        n = len(values)
        if n > FEW:
            #: a posting list for each coordinate and value, its members in order; where each member stands in its lists
            order = np.argsort(values, axis=0, kind="stable")
            ordered = np.take_along_axis(values, order, axis=0)
            new = np.ones(values.shape, bool)
            new[1:] = ordered[1:] != ordered[:-1]
            begin = np.maximum.accumulate(np.where(new, np.arange(n)[:, None], 0), axis=0)
            self.begin, self.place = np.empty_like(begin), np.empty_like(begin)
            np.put_along_axis(self.begin, order, begin, axis=0)
            np.put_along_axis(self.place, order, np.broadcast_to(np.arange(n)[:, None], order.shape), axis=0)
            self.order = np.ascontiguousarray(order.T)

    def before(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The members before i that collide with it often enough, and how often."""
        if len(self.values) <= FEW:
            count = (self.values[:i] == self.values[i]).sum(axis=1)
            near = np.flatnonzero(count >= self.least)
            return near, count[near]
        begin, end = self.begin[i], self.place[i]
        by_length = np.argsort(begin - end, kind="stable")  # the longest first
        skipped, merged = by_length[: self.least - 1], by_length[self.least - 1 :]
        count = np.bincount(np.concatenate([self.order[c, begin[c] : end[c]] for c in merged]), minlength=1)
        near = np.flatnonzero(count)
        count = count[near] + (self.values[np.ix_(near, skipped)] == self.values[i, skipped]).sum(axis=1)
        enough = count >= self.least
        return near[enough], count[enough]


def _forest(values: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest over pairs of at least `least` collisions: each member hangs on every tree that it has pairs
    with, by the pair of most collisions (of ties the first)."""
    found, tree, out = Collisions(values, least), np.arange(len(values)), []
    for i in range(1, len(values)):
        near, count = found.before(i)
        if not len(near):
            continue
        by = np.lexsort((near, -count, tree[near]))
        trees, first = np.unique(tree[near][by], return_index=True)
        out += [(int(j), i) for j in near[by][first]]
        tree[np.isin(tree[:i], trees).nonzero()[0]] = i
    return out


def _blocks(n: str, shingles: str, block: int) -> Column:
    return F.greatest(F.ceil(F.col(n) / block), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _own(blocks: Column) -> Column:
    """The block of a class in a list; other lists deal it with others, so that blocks of a group are joined over lists."""
    return F.pmod(F.xxhash64("key", "rep"), blocks).cast("int")


def _in_order(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("key", "cell").sortWithinPartitions("key", "cell", "rep")


def _values(column: pa.Array) -> list:
    """A column's values; lists of numbers as arrays."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    return np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1]) if len(column) else []


def _by_list(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    held, now = [], None
    for batch in batches:
        for row in zip(*(_values(batch.column(c)) for c in columns), strict=True):
            mark = row[:2]
            if mark != now:
                if len(held) > 1:
                    yield held
                held, now = [], mark
            held.append(row)
    if len(held) > 1:
        yield held


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(rows, np.int64).T
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame, similarity: int = 75, size: int = SHINGLE) -> DataFrame:
    """Pairs (a, b) whose full sets are similar: 100 * intersection >= similarity * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "x"):
                keep = []
                for s, t in zip(shingle_sets(part.column("x"), size), shingle_sets(part.column("y"), size), strict=True):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= similarity * (len(s) + len(t) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep))

    x = texts.select(F.col("rep").alias("a"), F.col("text").alias("x"), F.col("n").alias("n_a"))
    y = texts.select(F.col("rep").alias("b"), F.col("text").alias("y"), F.col("n").alias("n_b"))
    near = 100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")
    return pairs.join(x, "a").join(y, "b").where(near).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: int = 75, size: int = SHINGLE, matches: int = MATCHES, block: int = BLOCK) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept."""
    return _judged(docs, similarity, size, matches, block).drop(*ROW)


def kept_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Some columns, doc_id and text among them, of the documents kept: one row of each group, repeated rows included."""
    kept = _judged(docs).where("kept").select(*ROW).distinct()
    rows = with_row(docs.select(*columns)).hint("merge").join(kept, ROW, "left_semi")
    #: of repeated rows the least by the other columns
    rest = [c for c in columns if c != "text"]
    return rows.groupBy(*ROW).agg(F.min(F.struct(*rest, "text")).alias("row")).select("row.*").select(*columns)


def _judged(docs: DataFrame, similarity: int = 75, size: int = SHINGLE, matches: int = MATCHES, block: int = BLOCK) -> DataFrame:
    """The columns of ROW and of near_duplicates."""
    sketches = settle(sketch(docs, size))
    sets = ["s1", "s2", "n"]
    some = sketches.where("n > 0")
    #: a class's own number stands for it until the end, as ids may be missing or repeated; it has the texts of its least row
    classes = settle(some.groupBy(*sets).agg(F.min(F.struct(*ROW)).alias("row"), F.first("keys").alias("keys"), F.count("*").alias("members")).withColumn("rep", F.monotonically_increasing_id()))
    prefix = COORDINATES - matches + 1
    posted = classes.select("rep", "n", F.posexplode(F.slice("keys", 1, prefix)).alias("at", "key"))
    lists = settle(posted.groupBy("key").agg(F.count("*").alias("df"), F.sum("n").alias("shingles")).where("df > 1").withColumn("__n", F.col("df")))
    live = settle(join_hot(posted, lists, ["key"], F.col("rep")))
    #: of every coordinate's value 31 bits are counted; the lists themselves have the full ones
    narrow = F.transform("keys", lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    ids = settle(classes.join(live.select("rep").distinct(), "rep", "left_semi").select("rep", "row.*", "n", narrow.alias("vals"), "keys"))
    rows = with_row(docs.select("doc_id", F.col("text").cast("string").alias("text"))).drop("doc_id")
    #: texts move once; always by a shuffle, as the number of ids has no bound, so that small and large inputs take one plan
    texts = settle(rows.hint("merge").join(ids.select(*ROW, "rep", "n"), ROW).dropDuplicates(ROW).drop(*ROW))

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for held in _by_list(batches, ["key", "cell", "rep", "vals"]):
            out += [(held[i][2], held[j][2]) for i, j in _forest(np.stack([r[3] for r in held]), max(matches, LIKELY))]
            if len(out) >= 5000:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    #: every posting is dealt once, to its own block
    dealt = live.join(ids.select("rep", "vals"), "rep").withColumn("cell", _own(_blocks("df", "shingles", block)))
    first = settle(_in_order(dealt.select("key", "cell", "rep", "vals")).mapInArrow(forests, "a long, b long").where("a < b").distinct())
    links = settle(confirm(first, texts, similarity, size))
    parts = settle(connected_components(links))
    discard(first, links)

    #: what the forests left: lists over several components
    labelled = live.drop("df", "shingles").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = labelled.groupBy("key", "component").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    open_ = open_.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("k", "w", "component")).alias("m"), F.sum("k").alias("__n"), F.sum("w").alias("all_w")).where("parts > 1")
    open_ = open_.select("key", "__n", F.col("m.component").alias("main"), F.col("m.k").alias("mk"), F.col("m.w").alias("mw"), (F.col("__n") - F.col("m.k")).alias("sk"), (F.col("all_w") - F.col("m.w")).alias("sw"))
    open_ = settle(open_.withColumns({"m_blocks": _blocks("mk", "mw", block), "s_blocks": _blocks("sk", "sw", block)}).select("key", "__n", "main", "m_blocks", "s_blocks"))
    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["spot", "rep", "component", "first", "partners"])

        for held in _by_list(batches, ["key", "cell", "rep", "vals", "component", "at", "own", "spot", "before"]):
            found = Collisions(np.stack([r[3] for r in held]), matches)
            reps, part, own, at, cell, spot = np.array([r[2] for r in held]), np.array([r[4] for r in held]), np.array([r[6] for r in held]), held[0][5], held[0][1], held[0][7]
            before = np.stack([r[8] for r in held])
            partners: dict[int, np.ndarray] = {}
            for i in range(1, len(held)):
                far = found.before(i)[0]
                far = far[part[far] != part[i]]
                if cell["i"] != cell["j"]:  # pairs inside a block are those of its own cell
                    far = far[own[far] != own[i]]
                if at and len(far):  # a pair comes from the first list that both share, by the lists' full keys
                    far = far[~(before[far] == before[i]).any(axis=1)]
                if len(far):
                    partners[i] = reps[far]
                    for j in far:
                        partners.setdefault(int(j), reps[:0])
            for i, them in partners.items():
                out += [(spot, held[i][2], held[i][4], n == 0, them[n : n + PARTNERS]) for n in range(0, max(1, len(them)), PARTNERS)]
                if len(out) >= 2000:
                    yield made()
                    out.clear()
        if out:
            yield made()

    def confirm_spot(held: list[tuple]) -> Iterator[tuple[int, int]]:
        """Links between components among the documents of a spot; what a link has joined isn't compared again."""
        sets_ = shingle_sets(pa.array([r[3] for r in held], pa.large_string()), size)
        sizes = np.array(list(map(len, sets_)))
        reps, group = np.array([r[0] for r in held]), np.unique([r[1] for r in held], return_inverse=True)[1]
        ids = np.unique(np.concatenate(sets_), return_inverse=True)[1]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(len(ids) + 1, np.int64)
        for i, r in enumerate(held):
            far = np.searchsorted(reps, np.concatenate(r[2]))
            far = far[group[far] != group[i]]
            if not len(far):
                continue
            mine = ids[starts[i] : starts[i + 1]]
            mark[mine] = 1
            if len(far) * 4 > len(held):
                both = np.add.reduceat(mark[ids], starts[:-1])[far]
            else:
                both = np.array([mark[ids[starts[j] : starts[j + 1]]].sum() for j in far])
            mark[mine] = 0
            for j in far[100 * both >= similarity * (sizes[far] + sizes[i] - both)]:
                if group[j] != group[i]:
                    yield r[0], held[j][0]
                    group[group == group[j]] = group[i]

    def confirm_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, out = [], None, []
        for batch in batches:
            for spot, rep, component, first_, them, text in zip(*(_values(batch.column(c)) for c in ("spot", "rep", "component", "first", "partners", "text")), strict=True):
                if spot != now:
                    out += confirm_spot(held) if held else ()
                    held, now = [], spot
                if first_:
                    held.append((rep, component, [them], text))
                else:
                    held[-1][2].append(them)
        out += confirm_spot(held) if held else ()
        if out:
            yield _pairs(out)

    final = parts.select(F.col("node").alias("rep"), "component")
    if not open_.isEmpty():
        labelled = settle(join_hot(labelled, open_, ["key"], F.col("rep")))
        #: a list that fits one block is one cell; else blocks of the main component come first and meet the others' only
        alone = F.col("m_blocks") + F.col("s_blocks") == 2
        main = F.col("component") == F.col("main")
        own = F.when(main, _own(F.col("m_blocks"))).otherwise(F.col("m_blocks") + _own(F.col("s_blocks")))
        own = F.when(alone, 0).otherwise(own)
        others = F.sequence(F.when(main, F.col("m_blocks")).otherwise(F.lit(0)), F.col("m_blocks") + F.col("s_blocks") - 1)
        pair = F.transform(others, lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
        one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
        again = labelled.withColumn("own", own).withColumn("cell", F.explode(F.when(alone, one).otherwise(pair)))
        spot = F.xxhash64("key", "cell.i", "cell.j")
        again = again.join(ids.select("rep", "vals", "keys"), "rep").withColumn("spot", spot).withColumn("before", F.expr("slice(keys, 1, at)"))
        again = _in_order(again.select("key", "cell", "rep", "vals", "component", "at", "own", "spot", "before"))
        columns = ["spot", "rep", "component", "first", "partners", "text"]
        second = settle(again.mapInArrow(between, "spot long, rep long, component long, first boolean, partners array<long>"))
        met = second.where("first").join(texts.select("rep", "text"), "rep").select(*columns)
        met = met.unionByName(second.where("NOT first").withColumn("text", F.lit(None).cast("string")).select(*columns))
        met = met.repartition("spot").sortWithinPartitions("spot", "rep", F.desc("first"))
        more = settle(met.mapInArrow(confirm_all, "a long, b long"))
        name = lambda c, as_: parts.select(F.col("node").alias(c), F.col("component").alias(as_))
        merged = more.join(name("a", "ca"), "a", "left").join(name("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        tops = connected_components(merged)
        final = parts.join(tops.withColumnRenamed("component", "top"), parts["component"] == tops["node"], "left").select(parts["node"].alias("rep"), F.coalesce("top", "component").alias("component"))
        lone = tops.join(parts.select("node"), "node", "left_anti").select(F.col("node").alias("rep"), "component")
        final = settle(final.unionByName(lone))
        discard(labelled, second, more)
    discard(live, open_, ids, texts, lists)
    joined = classes.drop("keys").join(final, "rep")
    tops = joined.groupBy("component").agg(F.min("row").alias("top"), F.count("*").alias("__n"))
    joined = join_hot(joined, tops, ["component"], F.col("rep")).select(*sets, "top")
    named = settle(classes.select(*sets, F.col("row").alias("own"), F.col("members").alias("__n")).join(joined, sets, "left").select(*sets, F.coalesce("top", "own").alias("top"), "__n"))
    out = join_hot(some.select("doc_id", *ROW, *sets), named, sets, F.struct(*ROW))
    none = sketches.where("n = 0").select("doc_id", *ROW, *sets, F.struct(*ROW).alias("top"))
    out = out.select("doc_id", *ROW, *sets, "top").unionByName(none)
    discard(classes, parts)
    component = F.when(~F.col("top._unknown"), F.col("top._id"))
    return out.select(*ROW, "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("top") == F.struct(*ROW)).alias("kept"))
