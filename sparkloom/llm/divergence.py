"""Source divergence audit: how far each source's words stand from those of the other sources of its language.

Plain relational steps: matches of a term are counted by language, source and term; terms of few documents of a language
go; groups meet the kept vocabulary of their language, so that terms which a source lacks count zero; a self-join on the
term gives every pair of sources both of its shares; summed and ranked by windows.

Matches are counted in the task that reads the texts (a dictionary of FLUSH terms at most, then rows), because a row a
match costs more than all the rest; README has the figures. Everything after that is DataFrame work on counts. A language
with most of the documents is dealt by term, a source with most of them is one row a term.

Shares are whole numbers of SCALE parts: p = 1 + floor(SCALE * (count + 1) / (N + V)), with N the group's matches of kept
terms and V the language's kept terms. A divergence is floor((p - q)^2 / q).

Defined results: null text, lang and source are ''; a group without terms is audited with zero counts; a language without
kept terms has pairs of value 0 and no terms; ties in rank go by item in UTF-8 order; repeated rows count as often as they
stand; an empty table gives no rows; other columns are ignored. Counts up to 2^63 - 1 are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import settle

#: Documents of a language that a kept term is in, at least; parts of a share; ranks of terms that are reported.
LEAST_DOCS, SCALE, TERM_RANKS = 3, 1_000_000_000, 200
#: Terms that a task counts before it gives rows.
FLUSH = 400_000
#: Tasks to which the vocabulary of a language is dealt before groups meet it.
DEAL = 64
#: ASCII letters in lower case and all bytes of other characters are a term's; the rest stands between terms.
_TERM_BYTES = bytes(b if b >= 128 else (b | 32 if chr(b).isalpha() else 32) for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uses: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in uses.items():
            terms = list(found)
            own = docs[lang, source]
            for i in range(0, len(terms), 50_000):
                some = terms[i : i + 50_000]
                n = len(some)
                yield pa.record_batch(
                    [pa.array([lang] * n), pa.array([source] * n), pa.array([t.decode() for t in some]), pa.array([found[t] for t in some], pa.int64()), pa.array([own[t] for t in some], pa.int64())],
                    names=["lang", "source", "term", "uses", "docs"],
                )

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            words = text.as_buffer().to_pybytes().translate(_TERM_BYTES).split()
            found = uses.setdefault((lang, source), Counter())
            size -= len(found)
            found.update(words)
            #: the empty term stands for the group and for the number of its documents
            found[b""] += 1
            size += len(found)
            docs.setdefault((lang, source), Counter()).update({b"", *words})
            if size > FLUSH:
                yield from rows()
                uses.clear(), docs.clear()
                size = 0
    yield from rows()


def count_terms(docs: DataFrame) -> DataFrame:
    """text, lang, source -> lang, source, term, uses, docs: matches of each term and documents that have it; the term ''
    stands once in every document. Dealt by language and term: tasks have summed already, so rows are summed behind the
    shuffle, and what follows by term needs no other one."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = plain.mapInArrow(_count, "lang string, source string, term string, uses long, docs long")
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))


def _share(uses: str, whole: str) -> Column:
    """1 + floor(SCALE * (uses + 1) / whole); counts at which a long would overflow take decimals."""
    wide = f"(CAST({uses} + 1 AS DECIMAL(19, 0)) * CAST({SCALE} AS DECIMAL(10, 0))) div CAST({whole} AS DECIMAL(19, 0))"
    return F.expr(f"1 + CASE WHEN {uses} < 9000000000 THEN ({uses} + 1) * {SCALE} div {whole} ELSE {wide} END")


def kept_vocabulary(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Counts of terms -> a settled row for each kept term of a language: tid, lang, term, all_uses, uses (by source, as many
    entries as the language has sources). The term '' is kept for every language, so that each has its groups."""
    held = F.map_from_entries(F.collect_list(F.struct("source", "uses"))).alias("uses")
    terms = counts.groupBy("lang", "term").agg(F.sum("uses").alias("all_uses"), F.sum("docs").alias("docs"), held)
    #: numbers of a settled table stay what they are
    return settle(terms.where((F.col("docs") >= least_docs) | (F.col("term") == "")).drop("docs").withColumn("tid", F.monotonically_increasing_id()))


def dense_shares(vocabulary: DataFrame) -> DataFrame:
    """For each group and each kept term of its language, zeros included: tid, lang, source, term, uses, p, q; q is the
    share in the whole language. Shares of the term '' are null."""
    word = F.col("term") != ""
    own = F.when(word, F.col("n"))
    groups = vocabulary.select("lang", "term", F.explode("uses").alias("source", "n")).groupBy("lang", "source").agg(F.coalesce(F.sum(own), F.lit(0)).alias("own"))
    langs = vocabulary.groupBy("lang").agg(F.count_if(word).alias("v"), F.coalesce(F.sum(F.when(word, F.col("all_uses"))), F.lit(0)).alias("n"))
    groups = settle(groups.join(langs, "lang").select("lang", "source", (F.col("own") + F.col("v")).alias("whole"), (F.col("n") + F.col("v")).alias("lang_whole")))
    copies = groups.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))
    dealt = vocabulary.withColumn("deal", F.pmod(F.xxhash64("tid"), F.lit(DEAL)).cast("int"))
    crossed = dealt.join(copies, ["lang", "deal"]).withColumn("uses", F.coalesce(F.col("uses")[F.col("source")], F.lit(0)))
    return crossed.select("tid", "lang", "source", "term", "uses", F.when(word, _share("uses", "whole")).alias("p"), F.when(word, _share("all_uses", "lang_whole")).alias("q"))


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """text, lang, source -> lang, source, part, item, value, rank.

    Part `pair`: the divergence of a source from each other source of its language, summed over all kept terms. Part
    `term`: the terms that a source uses more than its language does, by their divergence from the language, up to
    `term_ranks` of them.
    """
    dense = dense_shares(kept_vocabulary(count_terms(docs), least_docs))
    value = F.expr("(p - q) * (p - q) div q")
    #: a term's number is that of its language and text
    a = dense.select("tid", "lang", "source", "p")
    b = dense.select("tid", F.col("source").alias("item"), F.col("p").alias("q"))
    pairs = a.join(b, "tid").where("source <> item").groupBy("lang", "source", "item").agg(F.coalesce(F.sum(value), F.lit(0)).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    terms = dense.where("uses > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= term_ranks)
    return pairs.union(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
