"""Exact token counts at every prefix of a text, by dynamic programming over pieces that no token crosses.

A subword vocabulary whose pieces hold the blank mark only at their beginning never merges across the end of a word,
and no piece holds a byte-fallback character such as a line break. So count(prefix) = count(text up to the last word
boundary) + count(rest of the word): one running sum over words, and a table per word for the prefixes inside it.
The vocabulary is checked for both properties when it is loaded; where one fails, the text isn't cut there.

The table is a dynamic program over pieces. With byte-pair merges a sequence of pieces is the encoding of its text if
each two neighbours are that of theirs: a merge across a border would also happen in the two pieces alone. So a prefix
ends in the one piece that follows the last piece of the prefix before it, and each character costs a few look-ups of
pairs, whatever the length of the part. Tables of pieces after a piece, or two, are made once, and those of texts put together
from them, for all texts of a step at once. Models of another kind are encoded prefix by prefix.

Defined results: null counts as the empty text, which has no tokens; strings of special tokens are ordinary text;
repeated rows are counted again; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.common import slices

#: Words that a worker remembers; then it forgets all and starts anew, so that memory is bounded.
MEMORY = 400_000
#: Longer parts, in characters, aren't remembered.
LONG = 256
MARK = "▁"


class PrefixCounter:
    """Counts tokens of a sentencepiece model for whole texts and for every prefix of them."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size()) if not self.model.is_byte(i)]
        self.by_space = all(MARK not in x.lstrip(MARK) for x in pieces)
        self.line = self.model.encode("\n")[-1]
        self.by_line = not any("\n" in x for x in pieces) and self.model.is_byte(self.line)
        self.words: dict[str, int] = {"\n": 1} if self.by_line else {}
        self.tables: dict[str, np.ndarray] = {}
        self.pieces = {x.replace(MARK, " ") for x in pieces}
        self.widest = max(map(len, pieces))
        #: scores of merges are whole numbers, those of other kinds of model are not
        self.by_merges = self.by_space and self.by_line and all(self.model.get_score(i).is_integer() for i in range(self.model.vocab_size()))
        self.own: dict[str, list[int]] = {}
        self.follows: dict[tuple[str, str], bool] = {}
        size = self.model.vocab_size()
        self.texts = [self.model.id_to_piece(i).replace(MARK, " ") for i in range(size)]
        self.inner: dict[str, list[tuple[int, str, str]]] = {}
        self.steps: dict[int, tuple[np.ndarray, list[str], int]] = {}
        self.longer: dict[tuple[int, int, int], tuple[np.ndarray, int]] = {}
        self.latest: tuple[str, np.ndarray] = ("", np.zeros(1, np.int64))
        #: of each piece its characters (a byte that continues one has none), whether it's a byte, has a blank first, is blank
        self.odd = np.array([self.model.is_byte(i) or self.model.is_unknown(i) or self.model.is_control(i) for i in range(size)])
        self.odd[self.line] = False
        self.width = np.array([int(not 0x80 <= int(x[3:-1], 16) < 0xC0) if self.model.is_byte(i) else len(x) for i, x in enumerate(self.texts)])
        self.marked = np.array([x.startswith(" ") for x in self.texts])
        self.blank = np.array([not x.strip(" ") for x in self.texts])

    def _count(self, parts: list[str]) -> list[int]:
        """All parts are encoded in one call, a line break before each: it is a token of its own that nothing joins."""
        if not self.by_line:
            first = len(self.model.encode("\n"))
            return [len(self.model.encode("\n" + p)) - first for p in parts]
        ids = np.asarray(self.model.encode("\n" + "\n".join(parts) + "\n"))
        return (np.diff(np.flatnonzero(ids == self.line)) - 1).tolist()

    def split(self, text: str) -> list[str]:
        """Parts whose counts add up to the text's; together they are " " + text."""
        if not text:
            return []
        text = " " + text.replace(MARK, " ")  # the model takes one for the other
        if not self.by_space:
            return [text]
        #: a blank begins a part, with the blanks right before it
        parts = text[1:].split(" ")
        if "" in parts:
            joined, blanks = [], ""
            for p in parts[:-1]:
                blanks += " "
                if p:
                    joined.append(blanks + p)
                    blanks = ""
            parts = [*joined, blanks + " " + parts[-1]]
        else:
            parts = [" " + p for p in parts]
        if self.by_line and "\n" in text:
            parts = [x for p in parts for x in ([p] if "\n" not in p else self._lines(p))]
        return parts

    @staticmethod
    def _lines(part: str) -> list[str]:
        lines = part.split("\n")
        out = [lines[0]] if lines[0] else []
        for x in lines[1:]:
            out += ["\n", x] if x else ["\n"]
        return out

    def part_counts(self, parts: list[str]) -> np.ndarray:
        words = self.words
        try:
            return np.fromiter(map(words.__getitem__, parts), np.int64, len(parts))
        except KeyError:
            pass
        missing = [p for p in set(parts) if p not in words]
        if len(words) + len(missing) > MEMORY:
            words.clear()
            words.update({"\n": 1} if self.by_line else {})
            missing = list(set(parts) - {*words})
        for i in range(0, len(missing), 50_000):
            some = missing[i : i + 50_000]
            words.update(zip(some, self._count(some), strict=True))
        out = np.fromiter(map(words.__getitem__, parts), np.int64, len(parts))
        for p in missing:
            if len(p) > LONG:
                del words[p]
        return out

    def sums(self, text: str) -> tuple[list[str], np.ndarray]:
        """The parts, and the number of tokens through each of them."""
        parts = self.split(text)
        return parts, np.cumsum(self.part_counts(parts))

    def table(self, part: str, n: int | None = None) -> np.ndarray:
        """Tokens of every prefix of a part, the empty one first; n is the library's count of the whole part."""
        if part in self.tables:
            return self.tables[part]
        if part == "\n" and self.by_line:
            out = np.array([0, 1])
        elif self.by_merges:
            out = self._settled(part, None, self.part_counts([part])[0] if n is None else n)
        else:
            out = np.array([0, *(k for i in range(1, len(part) + 1) for k in self._count([part[:i]]))])
        if len(part) <= LONG:
            if len(self.tables) >= MEMORY // 2:
                self.tables.clear()
            self.tables[part] = out
        return out

    def _ids(self, text: str) -> list[int]:
        ids = self.model.encode("\n" + text)
        return ids[ids.index(self.line) + 1 :]

    def _follow(self, before: str, piece: str) -> bool:
        """Whether two pieces stay as they are beside each other."""
        pair = (before, piece)
        if pair not in self.follows:
            if len(self.follows) >= MEMORY:
                self.follows.clear()
            for x in pair:
                if x not in self.own:
                    self.own[x] = self._ids(x)
            self.follows[pair] = self._ids(before + piece) == self.own[before] + self.own[piece]
        return self.follows[pair]

    def _step(self, before: int, i: int) -> tuple[np.ndarray, list[str], int]:
        """Tokens and last piece of every prefix of a piece that follows another (or -1), 0 tokens where the two can't be taken
        apart; and 1 if they always can, 0 if not, -1 if no table can be put together from this piece."""
        if i == self.line:
            return np.ones(1, np.int64), ["\n"], 1
        if self.odd[i]:
            return np.zeros(self.width[i], np.int64), [], -1
        piece = self.texts[i]
        if piece not in self.inner:
            out, last, firsts = [0], [""], [""]
            for _ in piece:
                j = self._extend(piece, out, last)
                firsts.append(firsts[j] if j else last[-1])
            self.inner[piece] = list(zip(out[1:], last[1:], firsts[1:], strict=True))
        counts = [n if before < 0 or self._follow(self.texts[before], first) else 0 for n, _, first in self.inner[piece]]
        return np.array(counts, np.int64), [end for _, end, _ in self.inner[piece]], int(all(counts)) if counts[-1] == 1 else -1

    def _known(self, before: int, i: int) -> tuple[np.ndarray, list[str], int]:
        key = before * len(self.texts) + i
        step = self.steps.get(key)
        if step is None:
            if len(self.steps) >= MEMORY:
                self.steps.clear()
            step = self.steps[key] = self._step(before, i)
        return step

    def _longer_step(self, first: int, before: int, i: int) -> tuple[np.ndarray, int]:
        """What `_step` leaves open: prefixes that end in a piece which begins inside the piece before. A prefix has one
        encoding, so the piece found is the one, whatever stands before the three; -1 if it begins further back."""
        counts, ends, _ = self._known(before, i)
        before_counts, before_ends, _ = self._known(first, before)
        text, at, own = self.texts[before] + self.texts[i], len(self.texts[before]), self.own
        #: tokens of prefixes, less those before piece i, and their last pieces; None if that takes pieces further back
        out = [-1, *(int(n) - 1 if n else None for n in before_counts)]
        last = [self.texts[first] if first >= 0 else "", *before_ends]
        for n, end in zip(counts.tolist(), ends, strict=True):
            k = len(out)
            if not n:
                for j in range(max(0, k - self.widest), k):
                    x = text[j:k]
                    if out[j] is None or j < k - 1 and x not in self.pieces:
                        continue
                    if x not in own:
                        own[x] = self._ids(x)
                    if j < k - 1 and len(own[x]) > 1 or last[j] and not self._follow(last[j], x):
                        continue
                    n, end = out[j] + len(own[x]), x
                    break
                else:
                    return counts, -1
            out.append(n)
            last.append(end)
        return np.array(out[at + 1 :], np.int64), 1

    def _tables(self, texts: list[str]) -> list[np.ndarray]:
        """Tokens of every prefix of each text (that aren't empty), the blank before it first. The library encodes each text
        once; a prefix that ends inside a piece has the tokens before that piece, and those of the piece's own prefix after
        the piece before it, or the two before. Parts where that isn't enough have tables of their own."""
        ids = [np.asarray(self.model.encode(x), np.int64) for x in texts]
        flat, sizes = np.concatenate(ids), np.array(list(map(len, ids)))
        begins = np.cumsum(sizes) - sizes
        prev = np.concatenate([[0], flat[:-1]])
        starts = (flat == self.line) | (prev == self.line) | self.marked[flat] & ~self.blank[prev]
        starts[begins] = True
        before = np.where(starts, -1, prev)
        pairs, which = np.unique(before * len(self.texts) + flat, return_inverse=True)
        steps = [self._known(k // len(self.texts), k % len(self.texts)) for k in pairs.tolist()]
        counts, kind = [c for c, _, _ in steps], np.array([k for _, _, k in steps])
        open_ = np.flatnonzero(kind[which] == 0)
        if len(open_):
            three = (before[open_ - 1] * len(self.texts) + before[open_]) * len(self.texts) + flat[open_]
            three, first, at = np.unique(three, return_index=True, return_inverse=True)
            if len(self.longer) + len(three) > MEMORY:
                self.longer.clear()
            more = []
            for j in open_[first].tolist():
                key = (int(before[j - 1]), int(before[j]), int(flat[j]))
                if key not in self.longer:
                    self.longer[key] = self._longer_step(*key)
                more.append(self.longer[key])
            which[open_] = len(steps) + at
            counts += [c for c, _ in more]
            kind = np.concatenate([kind, [k for _, k in more]])
        #: each token takes its step's counts, after the tokens of the text before it
        lengths, widths = np.array(list(map(len, counts))), self.width[flat]
        ends = np.cumsum(widths)
        here = np.arange(len(flat)) - np.repeat(begins, sizes)
        out = np.concatenate(counts)[np.arange(ends[-1]) + np.repeat((np.cumsum(lengths) - lengths)[which] - ends + widths, widths)] + np.repeat(here, widths)
        heads = np.append(np.flatnonzero(starts), len(flat))
        chars = np.append(ends - widths, ends[-1])
        text_chars = chars[np.append(begins, len(flat))]
        for part in np.unique(np.searchsorted(heads, np.flatnonzero(kind[which] < 0), side="right") - 1).tolist():
            i, j = heads[part], heads[part + 1]
            k = int(np.searchsorted(begins, i, side="right")) - 1
            own = (" " + texts[k])[chars[i] - text_chars[k] : chars[j] - text_chars[k]]
            out[chars[i] : chars[j]] = here[i] + self.table(own, int(j - i))[1:]
        return [out[i:j] for i, j in zip(text_chars[:-1], text_chars[1:], strict=True)]

    def _settled(self, part: str, out: np.ndarray | None, n: int) -> np.ndarray:
        """A table, or if there is none that the library's count of the whole part agrees with, the next way's."""
        if out is None or out[-1] != n:
            out = self._chain(part)
        if out[-1] != n:
            out = np.array([0, *(k for i in range(1, len(part) + 1) for k in self._count([part[:i]]))])
        return out

    def _extend(self, part: str, out: list[int], last: list[str]) -> int:
        """Adds the count and the last piece of the next prefix of a part, and tells where that piece begins."""
        own, i = self.own, len(out)
        for j in range(max(0, i - self.widest), i):
            x = part[j:i]
            if j < i - 1 and x not in self.pieces:
                continue
            if x not in own:
                own[x] = self._ids(x)
            if j < i - 1 and len(own[x]) > 1:
                continue
            if j and not self._follow(last[j], x):
                continue
            last.append(x)
            out.append(out[j] + len(own[x]))
            return j
        raise ValueError(f"no piece ends {part[max(0, i - self.widest) : i]!r}")

    def _chain(self, part: str) -> np.ndarray:
        """The table of a part: the last piece of every prefix, by pieces that may follow each other."""
        out, last = [0], [""]
        for _ in part:
            self._extend(part, out, last)
        return np.array(out)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for i from 0 to its length."""
        if self.latest[0] != text:
            self.latest = text, self.all_prefix_counts([text])[0]
        return self.latest[1].copy()

    def all_prefix_counts(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text, tokens of text[:i] for i from 0 to its length."""
        full = [x.replace(MARK, " ") for x in texts if x]  # the model takes one for the other
        tables = iter(self._tables(full) if self.by_merges and full else map(self._by_parts, full))
        out = []
        for x in texts:
            table = next(tables) if x else np.zeros(1, np.int64)
            if len(table) != len(x) + 1:
                raise ValueError(f"a table of {len(table)} prefixes for {len(x)} characters")
            table[0] = 0  # the blank put before the text is no prefix of it
            out.append(table)
        return out

    def _by_parts(self, text: str) -> np.ndarray:
        """What `_tables` gives, for models of other kinds."""
        tables = [self.table(p) for p in self.split(text)]
        ends = np.cumsum([0, *(t[-1] for t in tables)])
        return np.concatenate([t[1:] + n for t, n in zip(tables, ends[:-1], strict=True)])

    def fit(self, text: str, budget: int) -> int:
        """The longest prefix, in characters, of at most `budget` tokens (as encoded by itself)."""
        return longest_fit(self.prefix_counts(text), budget)


def longest_fit(counts: np.ndarray, budget: int) -> int:
    """The longest prefix within a budget, read from the counts at every prefix; they aren't monotone inside a part."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) if len(fits) else 0


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, prefixes: bool = False) -> DataFrame:
    """doc_id, text -> doc_id, n_bytes, n_tokens, over_limit, fit_chars (the longest prefix within the limit); with
    `prefixes`, also the count at every prefix. All of them are read from that table. One pass without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(model_file)
        for part in (part for batch in batches for part in slices(batch, "text")):
            rows: dict[str, list] = {k: [] for k in ("n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_tokens")}
            texts = [x.as_py() or "" for x in part.column("text")]
            for text, counts in zip(texts, counter.all_prefix_counts(texts), strict=True):
                n = int(counts[-1])
                rows["n_bytes"].append(len(text.encode()))
                rows["n_tokens"].append(n)
                rows["over_limit"].append(n > limit)
                rows["fit_chars"].append(longest_fit(counts, limit) if n > limit else len(text))
                rows["prefix_tokens"].append(counts if prefixes else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows["n_bytes"], pa.int64()), pa.array(rows["n_tokens"], pa.int64()), pa.array(rows["over_limit"], pa.bool_()), pa.array(rows["fit_chars"], pa.int64()), pa.array(rows["prefix_tokens"], pa.list_(pa.int64()))][: 6 if prefixes else 5], names=["doc_id", *list(rows)[: 5 if prefixes else 4]])

    out = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_tokens array<long>" * prefixes
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, out)
