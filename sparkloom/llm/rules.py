"""Quality rules: a table of thresholds over length, symbol, stop-word and line ratios, compiled into one projection.

A rule says that `per` times one count lies between `least` and `most` times another. Counts and rules are column
expressions on the row's own text, so a corpus is judged in the scan that reads it: no shuffle, no user functions, and
nothing beyond the one text in memory.

Words repeated in 3-word windows: windows are hashed; only if two hashes of a text agree, windows that share a hash are
sorted by their words and neighbours compared, so hashes never decide.

Defined results: null and empty texts have no words and fail the base rules; a row is judged by its own text alone, so null
ids, repeated rows and the order of rows change nothing; lines without a word are never duplicates; an empty table gives no
rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
_GAPS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = """
a an and are as at be been but by for from had has have he her his i if in is it its not of on or she so that the their they this to was we were which will with you
als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so und uns von vor war wie wir wird zu zum zur über
au aux avec ce ces cette comme dans de des du elle en est et être eux il ils je la le les leur lui mais ne nous on ou où par pas plus pour que qui sa se ses son sont sur un une vous y à
al con como de del el ella en entre era es esta este la las lo los más muy no o para pero por que se sin sobre son su sus también un una y ya
""".split()


class Rule(NamedTuple):
    """`per` * top must lie from least * under to most * under; under None is 1. Base rules are the first to fail."""

    name: str
    top: str
    under: str | None
    per: int
    least: int | None
    most: int | None
    base: bool = False

    def fails(self) -> str:
        """As SQL that Spark and other engines read alike."""
        under = self.under or "1"
        low = [f"{self.per} * {self.top} < {self.least} * {under}"] if self.least is not None else []
        return " OR ".join(low + ([f"{self.per} * {self.top} > {self.most} * {under}"] if self.most is not None else []))


RULES = (
    Rule("few words", "n_words", None, 1, 50, None, True),
    Rule("repeated words", "n_repeat_words", "n_words", 100, None, 50, True),
    Rule("word length", "word_chars", "n_words", 10, 20, 120),
    Rule("symbols", "n_symbols", "n_words", 100, None, 10),
    Rule("stop words", "n_stop_words", "n_words", 100, 2, None),
    Rule("duplicate lines", "n_dup_lines", "n_lines", 100, None, 50),
    Rule("ellipsis lines", "n_ellipsis_lines", "n_lines", 100, None, 30),
    Rule("bullet lines", "n_bullet_lines", "n_lines", 100, None, 90),
)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it and from within what lambda."""
    return F.get(F.transform(F.array(value), f), 0)


def _windows_repeated() -> Column:
    """Words in windows of three that a text has twice or more, from columns `words` and `hashes` (one for each window)."""
    window = lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))

    def twins(sorted_: Column) -> Column:
        """Positions (second field) of structs whose first field equals a neighbour's."""
        same = lambda x, other: x["a"] == F.get(sorted_, other)["a"]
        found = F.transform(sorted_, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
        return F.filter(found, lambda i: i.isNotNull())

    alike = _let(F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("a"), i.alias("i")))), twins)
    places = _let(F.sort_array(F.transform(alike, lambda i: F.struct(window(i).alias("a"), i.alias("i")))), twins)

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))), F.lit(0), lambda n, x: n + x)

    return F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), _let(F.sort_array(places), covered)).otherwise(0)


def measure(docs: DataFrame, keep: Sequence[str] = ("doc_id",), stop_words: Sequence[str] = tuple(STOP_WORDS)) -> DataFrame:
    """text and `keep` -> `keep`, and the counts (long) that rules are about: n_words, word_chars (code points in words),
    n_symbols, n_lines (with a word), n_dup_lines, n_ellipsis_lines, n_bullet_lines, n_stop_words, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = F.struct(*(F.col(c).alias(c) for c in keep)).alias("held")
    df = docs.select(held, text.alias("text"))
    df = df.select("held", F.array_remove(F.split("text", GAP), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_GAPS)) != "").alias("lines"), (F.size(F.split("text", SYMBOLS, -1)) - 1).alias("n_symbols"))
    windows = F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0)))
    df = df.select("*", F.transform(windows, lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))).alias("hashes"))
    count = lambda column, f: F.size(F.filter(column, f))
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.col("n_symbols"),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_ellipsis_lines": count("lines", lambda x: F.btrim(x, F.lit(_GAPS)).endswith("...") | F.btrim(x, F.lit(_GAPS)).endswith("…")),
        "n_bullet_lines": count("lines", lambda x: F.substring(F.btrim(x, F.lit(_GAPS)), 1, 1).isin("-", "*", "•")),
        "n_stop_words": count("words", lambda w: F.lower(w).isin(*stop_words)),
        "n_repeat_words": _windows_repeated(),
    }
    return df.select(*(F.col("held")[c].alias(c) for c in keep), *(x.cast("long").alias(c) for c, x in counts.items()))


def apply_rules(measured: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts -> also base_failed, failed (names of the rules that a row fails, in order) and kept (none)."""
    failed = F.filter(F.array(*(F.when(F.expr(r.fails()), r.name) for r in rules)), lambda x: x.isNotNull())
    base = F.lit(False)
    for r in rules:
        base = base | F.expr(r.fails()) if r.base else base
    return measured.select("*", base.alias("base_failed"), failed.alias("failed"), (F.size(failed) == 0).alias("kept"))
