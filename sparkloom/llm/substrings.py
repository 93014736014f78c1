"""Suffix-array dedup: remove every byte under a string of `length` bytes that also starts elsewhere in the corpus.

A full suffix array has a row per byte. Here it is sparse: suffixes are taken at anchors. Of the K-byte grams in a window
of `length` bytes the one of least hash (the leftmost of ties) is its anchor, so equal windows have equal anchors, at the
same place in them. An anchor's context is the bytes under all windows that it anchors.

Anchors are found once. Grams that occur once go no further than a count. Of equal contexts (told by two hashes, a
pre-filter) two occurrences become suffixes, the first and the last, so that copies, too, are found by the bytes that they
share in the sorted order; more of them would only repeat that comparison. Suffixes are range-partitioned by
their leading bytes, of which Spark samples the splitters; equal leads share a partition, so that no run of them has a
neighbour across a boundary. In a partition each run is sorted by what follows the lead and by what stands before it, read
backwards, by multikey quicksort on eight bytes at a time, and the common bytes of neighbours are measured. A window is
under both orders: it is repeated if another suffix agrees with it as far as it reaches on either side. What is found for
the first occurrence of a context holds for all of them.

A run of more than `hot` suffixes isn't gathered: each suffix is dealt to narrower runs, led by the bytes that all windows
of a narrower range of places share, down to the window itself, whose run has nothing left to sort. No task holds a longer
run, and all suffixes take the same way.

Defined results: null is the empty text; a text shorter than `length` keeps all; rows are told apart by doc_id and a hash
of the text, and copies of a row are occurrences of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from sparkloom.llm.common import _BYTE, bytes_of, discard, join_hot, mix, powers, prefix_sums, settle, slices, span_hash

K = 48
#: Suffixes of one run that are sorted together, at most.
HOT = 1024
#: Suffixes that a task sorts at once, unless one run has more (HOT at most).
SORTED = 8192
_OTHER = mix(_BYTE)


def other_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a second, independent hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum(_OTHER[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def anchors(data: np.ndarray, starts: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor, and first and last window start of every anchor; offsets are in `data`."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    sums = prefix_sums(data)
    at = np.arange(n - k + 1)
    #: 34 bits of hash, then 30 bits of place: the least value tells where it is
    value = span_hash(sums, at, at + k) >> np.uint64(30) << np.uint64(30) | at.astype(np.uint64)
    width, have = length - k + 1, 1
    least = value
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    place = (least & np.uint64((1 << 30) - 1)).astype(np.int64)
    #: windows inside one row only
    sizes = np.diff(starts)
    inside = np.zeros(n + 1, np.int64)
    whole = sizes >= length
    np.add.at(inside, starts[:-1][whole], 1)
    np.add.at(inside, (starts[1:] - length + 1)[whole], -1)
    start = np.flatnonzero(np.cumsum(inside)[: len(place)] > 0)
    if not len(start):
        return none, none, none, none
    place = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return np.searchsorted(starts, start[first], side="right") - 1, place[first], start[first], start[last]


def suffix_order(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of equally long rows of bytes in each group, and how many bytes each in it shares with the one before
    (-1 for the first of a group). Multikey quicksort in keys of eight bytes: rows are parted by their next eight bytes,
    and only parts with several rows go on."""
    n, width = rows.shape
    keys = np.zeros((n, -(-width // 8) * 8), np.uint8)
    keys[:, :width] = rows
    keys = keys.view(">u8")
    order = np.argsort(group, kind="stable")
    #: a part is known by its first place in the order
    part = np.searchsorted(group[order], group[order])
    live = np.arange(n)
    for column in range(keys.shape[1]):
        live = live[np.bincount(part[live])[part[live]] > 1] if len(live) else live
        if not len(live):
            break
        key = keys[order[live], column]
        by = np.lexsort((key, part[live]))
        order[live], key = order[live][by], key[by]
        new = np.ones(len(live), bool)
        new[1:] = (key[1:] != key[:-1]) | (part[live][1:] != part[live][:-1])
        part[live] = live[new][np.cumsum(new) - 1]
    shared = np.full(n, -1)
    if n > 1:
        a, b = order[:-1], order[1:]
        same = np.concatenate([rows[a] == rows[b], np.zeros((n - 1, 1), bool)], axis=1)
        shared[1:] = np.where(group[a] == group[b], same.argmin(axis=1), -1)
    return order, shared


def repeated_windows(data: np.ndarray, begin: np.ndarray, at: np.ndarray, core: np.ndarray, more: np.ndarray, group: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece of data, which of its windows (0 to more) stand in another piece of its group, too. Pieces of a group
    have the same `core` bytes, `at` bytes after their beginning."""
    n = len(begin)
    out = [np.zeros(0, np.int64)] * n
    if not n:
        return out
    free = length - core  # bytes of a window beside its core
    step = np.arange(int(free.max()))
    size = more + length
    padded = np.concatenate([data, np.zeros(1, np.uint8)])

    def side(from_: np.ndarray, have: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = np.where(step < have[:, None], from_[:, None] + sign * step, len(data))
        order, shared = suffix_order(padded[place], group)
        most = np.zeros(n, np.int64)
        np.maximum.at(most, order, shared)
        np.maximum.at(most, order[:-1], shared[1:])
        return order, shared, most

    after, before = side(begin + at + core, size - at - core, 1), side(begin + at - 1, at, -1)
    #: window i has at - i bytes before the core; both sides must be shared so far with some other piece
    first, last = np.maximum(0, at - before[2]), np.minimum(more, at + after[2] - free)
    marks = np.zeros((n, int(more.max()) + 1), bool)
    for x in range(len(step) + 1):
        i = at - x
        on = np.flatnonzero((first <= i) & (i <= last) & (x <= free))
        if not len(on):
            continue
        runs = []
        for order, shared, need in ((after[0], after[1], None), (before[0], before[1], x)):
            #: where less is shared than the window needs, another run begins
            need = free[order] - x if need is None else need
            run = np.empty(n, np.int64)
            run[order] = np.cumsum(shared < need)
            runs.append(run[on])
        _, which, count = np.unique(runs[0] * n + runs[1], return_inverse=True, return_counts=True)
        same = on[count[which] > 1]
        marks[same, i[same]] = True
    return [np.flatnonzero(m) for m in marks]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.concatenate([[0], cut + 1])], starts[np.append(cut, len(starts) - 1)]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))


#: A suffix: its lead and the piece of text under its windows (`more` and one), in which the lead begins at `at` and the
#: anchor at `back`; `skip` windows of the context come before these; the context occurs n times, this is its first (copy 0)
#: or its last occurrence (copy 1).
_PIECE = "gram long, context long, lead binary, piece binary, at int, back int, skip int, more int, n long, copy int"
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
_NAMES = [c.split()[0] for c in _PIECE.split(", ")]


def repeats(docs: DataFrame, length: int = 200, k: int = K, hot: int = HOT) -> DataFrame:
    """doc_id, text -> doc_id, th (a hash of the text), runs (array of first and last start of repeated strings)."""
    rows = _rows(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts = bytes_of(part.column("text"))
                row, anchor, first, last = anchors(data, starts, length, k)
                if not len(row):
                    continue
                gram = span_hash(prefix_sums(data), anchor, anchor + k)
                #: the context's bytes, and where the anchor stands in it
                context = mix(span_hash(other_sums(data), first, last + length) ^ mix((anchor - first).astype(np.uint64)))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), part.column("doc_id").take(take), part.column("th").take(take), pa.array((anchor - starts[row]).astype(np.int32)), pa.array((anchor - first).astype(np.int16)), pa.array((last - first).astype(np.int16))], names=["gram", "context", "doc_id", "th", "anchor", "back", "more"])

    place = F.struct("doc_id", "th", "anchor")
    anchored = settle(rows.mapInArrow(find, "gram long, context long, doc_id long, th long, anchor int, back short, more short"))
    #: most grams are the only ones of their kind; of them, eight bytes are shuffled
    repeated = settle(anchored.groupBy("gram").agg(F.count("*").alias("__n")).where("__n > 1"))
    found = settle(join_hot(anchored, repeated, ["gram"], place, "left_semi"))
    discard(anchored, repeated)
    spot = F.struct("doc_id", "th", "anchor", "back", "more")
    contexts = settle(found.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(spot).alias("one"), F.max(spot).alias("other")))
    #: suffixes of a run: two of a context that occurs several times
    grams = settle(contexts.groupBy("gram").agg(F.count("*").alias("__n"), F.sum(F.least("n", F.lit(2))).alias("different")))
    known = join_hot(contexts, grams, ["gram"], F.col("context"))
    each = F.when(F.col("n") > 1, F.array("one", "other")).otherwise(F.array("one"))
    known = known.select("gram", "context", "n", "different", F.posexplode(each).alias("copy", "at"))
    spots = F.struct("gram", "context", "at.anchor", "at.back", "at.more", "n", "different", "copy")
    wanted = settle(known.groupBy("at.doc_id", "at.th").agg(F.collect_list(spots).alias("spots")))
    discard(contexts, grams)
    w = wanted.alias("w")
    near = rows.alias("d").join(w, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th"))).select("d.text", "w.spots")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes under the windows of each spot."""
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts, spots = batch.column("text").to_pylist(), batch.column("spots")
            inner, ends = spots.flatten(), np.cumsum(spots.value_lengths().to_numpy()).tolist()
            gram, context, anchor, back, more, n, different, copy = (inner.field(i).to_pylist() for i in range(8))
            lead, piece, j = [], [], 0
            for text, end in zip(texts, ends, strict=True):
                data = text.encode()
                for i in range(j, end):
                    lead.append(data[anchor[i] : anchor[i] + k])
                    piece.append(data[anchor[i] - back[i] : anchor[i] - back[i] + more[i] + length])
                j = end
            if lead:
                columns = [gram, context, lead, piece, back, back, [0] * len(lead), more, n, copy]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True)), pa.array(different, pa.int64())], names=[*_NAMES, "different"])

    pieces = settle(near.mapInArrow(cut, _PIECE + ", different long"))
    discard(wanted)

    def narrow(width: int):
        """Deal a suffix to the runs of narrower ranges: the windows that have from j * width bytes on before the anchor,
        fewer than (j + 1) * width, share the bytes of the lead. The runs are named by two hashes of it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for gram, context, _, piece, _, back, skip, more, n, copy in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
                    for j in range((back - more) // width, back // width + 1):
                        first, last = back - min(back, (j + 1) * width - 1), back - max(back - more, j * width)
                        some, own = piece[first : last + length], back - first
                        lead = some[own - j * width : own - j * width + length - width + 1]
                        name = hashlib.blake2b(lead, digest_size=16).digest()
                        out.append((gram, context, lead, some, own - j * width, own, skip + first, last - first, n, copy, int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True)))
                if out:
                    kinds = [*_KINDS, pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[*_NAMES, "core", "core2"])

        return run

    spans = "gram long, context long, n long, runs array<struct<first: int, last: int>>"
    ready, rest, whole = pieces.where(F.col("different") <= hot).select(*_NAMES), pieces.where(F.col("different") > hot).select(*_NAMES), None
    widest = length - k + 1
    for width in (-(-widest // 9), 1):
        if rest.isEmpty():
            break
        split = settle(rest.mapInArrow(narrow(width), _PIECE + ", core long, core2 long"))
        names, where = ["core", "core2"], F.struct("gram", "context", "skip")
        if width > 1:
            sizes = settle(split.groupBy(*names).agg(F.count("*").alias("__n")))
            split = settle(join_hot(split, sizes.withColumn("different", F.col("__n")), names, where))
            ready = ready.unionByName(split.where(F.col("different") <= hot).select(*_NAMES))
            rest = split.where(F.col("different") > hot).select(*_NAMES)
        else:
            #: the lead is the window: its run has only equal strings
            again = split.groupBy(*names).agg(F.count("*").alias("__n"), F.min("context").alias("lo"), F.max("context").alias("hi"), F.max("n").alias("most"))
            again = settle(again.where((F.col("lo") < F.col("hi")) | (F.col("most") > 1)).select(*names, "__n"))
            whole = join_hot(split.where("copy = 0").drop("lead", "piece"), again, names, where, "left_semi").select("gram", "context", "n", F.array(F.struct(F.col("skip").alias("first"), F.col("skip").alias("last"))).alias("runs"))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[tuple]) -> pa.RecordBatch | None:
            lead, context, skip, copy, gram, piece, at, more, n = zip(*held, strict=True)
            run = np.cumsum([0, *(a != b for a, b in zip(lead[1:], lead[:-1], strict=True))])
            several = np.flatnonzero(np.bincount(run)[run] > 1)
            data = np.frombuffer(b"".join(piece), np.uint8)
            sizes = np.array(list(map(len, piece)))
            begin = np.cumsum(sizes) - sizes
            core = np.array(list(map(len, lead)))
            windows = repeated_windows(data, begin[several], np.array(at)[several], core[several], np.array(more)[several], run[several], length)
            found = dict(zip(several.tolist(), windows, strict=True))
            out = []
            for i in range(len(held)):
                if copy[i] == 0 and i in found and len(found[i]):
                    a, b = _runs(found[i])
                    out.append((gram[i], context[i], n[i], [{"first": int(x) + skip[i], "last": int(y) + skip[i]} for x, y in zip(a, b, strict=True)]))
            if not out:
                return None
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["gram", "context", "n", "runs"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("lead", "context", "skip", "copy", "gram", "piece", "at", "more", "n")), strict=True):
                if held and row[:4] == held[-1][:4]:
                    continue  # repeated rows of one document gave the same suffix
                if len(held) >= SORTED and row[0] != held[-1][0]:
                    if (b := solve(held)) is not None:
                        yield b
                    held = []
                held.append(row)
        if held and (b := solve(held)) is not None:
            yield b

    ordered = ready.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lead").sortWithinPartitions("lead", "context", "skip", "copy")
    spans_of = settle(ordered.mapInArrow(sort, spans))
    #: a row a context, however many runs its windows were dealt to, so that the join gives a row an occurrence
    all_of = spans_of if whole is None else spans_of.unionByName(whole)
    spans_of = settle(all_of.groupBy("gram", "context", "n").agg(F.flatten(F.collect_list("runs")).alias("runs")))
    discard(pieces)
    marked = join_hot(found, spans_of.withColumnRenamed("n", "__n"), ["gram", "context"], place)
    begin = F.col("anchor") - F.col("back")
    runs = F.transform("runs", lambda r: F.struct((r["first"] + begin).alias("first"), (r["last"] + begin).alias("last")))
    #: sets, as repeated rows have the same ones
    out = settle(marked.groupBy("doc_id", "th").agg(F.flatten(F.collect_set(runs)).alias("runs")))
    discard(found, spans_of)
    return out


def _merge(runs: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal spans of bytes under the strings."""
    out: list[list[int]] = []
    for a, b in sorted((r["first"], r["last"] + length) for r in runs or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def dedup_substrings(docs: DataFrame, length: int = 200, k: int = K, hot: int = HOT, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: doc_id, text, n_bytes, n_removed, n_spans, kept_sha256, kept_text (the remaining bytes
    without those that are no whole character), spans (byte offsets), and the columns named by `keep`."""
    found = repeats(docs, length, k, hot).alias("r")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"), *keep)
    #: columns by other names than the operator's own
    extra = {f"__{i}": c for i, c in enumerate(keep)}
    rows = rows.select("doc_id", "text", "th", *(F.col(c).alias(n) for n, c in extra.items()))
    joined = rows.alias("d").join(found, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.th") == F.col("r.th")), "left").select("d.doc_id", "d.text", *extra, "r.runs")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text, runs in zip(*(part.column(c).to_pylist() for c in ("text", "runs")), strict=True):
                    data = (text or "").encode()
                    spans = _merge(runs, length)
                    pieces, at = [], 0
                    for a, b in spans:
                        pieces.append(data[at:a])
                        at = b
                    rest = b"".join([*pieces, data[at:]])
                    out.append((len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), b"".join(x.decode(errors="ignore").encode() for x in [*pieces, data[at:]]).decode(), [{"first": a, "last": b} for a, b in spans]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))]
                own = ["doc_id", "text", *extra]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=[*own, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans"])

    kinds = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, spans array<struct<first: long, last: long>>"
    made = joined.mapInArrow(remove, StructType([*joined.drop("runs").schema.fields, *_parse_datatype_string(kinds).fields]))
    return made.select("doc_id", "text", *(F.col(n).alias(c) for n, c in extra.items()), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans")
