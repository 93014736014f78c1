"""Mixing sources to target weights, in DataFrame functions only.

Every document has a hash of 36 bits. Sizes are summed by source and hash bucket; the bucket in which a source's budget
runs out is found from running sums, and only that bucket is summed again by finer buckets. After `LEVELS` rounds a
source has one hash threshold: documents whose hash is below it are taken once more than the others. Thresholds are
nested: a larger budget takes a superset. No document is sorted, and a hot source is pre-summed in each task.

Defined results: null text has size 0; a null source is a source of its own, last in order; rows with the same doc_id
and text have the same hash and are taken alike; an empty table gives no rows; other columns are ignored. Sources
without words have target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import settle

#: Between words: spaces and control characters from tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"
#: Hash bits refined in each round, and rounds: 3 * 12 bits part more documents of a source than any corpus has.
BITS, LEVELS = 12, 3


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), GAP), "")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> also target: the sources, by code point and null last, weigh `weights` in turn and share
    `share` times all sizes; no target is above `most` times its source, the excess goes to the others by weight.

    Sources whose cap is low for their weight are capped first, so the capped ones are a prefix in the order of
    cap / weight; running sums find it. One row per source reaches the window.
    """
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1)
    order = everything.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    df = sizes.withColumns({"weight": w.cast("double"), "cap": F.col("source_size") * F.lit(float(most)), "budget": F.sum("source_size").over(everything) * F.lit(float(share))})
    rest_weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    capped_before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    df = df.withColumn("level", (F.col("budget") - capped_before) / rest_weight)
    #: the first source in order that isn't capped sets the level for all after it
    df = df.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
    return df.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, text, source -> doc_id, size, source_size, target, taken.

    A source's target is n whole passes over it and a rest; `taken` is n times the size, and once more for documents
    below the source's threshold, chosen so that the words taken come nearest to the target.
    """
    #: the leading bits of a digest, which other engines can compute as well
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))), 1, BITS * LEVELS // 4), 16, 10).cast("long")
    #: texts are read once; what follows works on four short columns
    base = settle(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), h.alias("h")))

    def bucket(level: int) -> Column:
        return F.shiftright("h", BITS * (LEVELS - 1 - level))

    by_source = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    #: `below`: words under the bucket `edge`; the budget runs out in that bucket
    state = by_source.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    #: sizes by the finest bucket in question: level 0 over all documents, deeper levels over the edge bucket only
    #: a row a source, settled between levels, so that no level computes those before again
    edge = settle(state.withColumns({"below": F.lit(0).cast("long"), "edge": F.lit(0).cast("long")}))
    for level in range(LEVELS):
        at_edge = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", BITS * (LEVELS - level)) == F.col("edge"))
        inside = base.join(edge.select(F.col("source").alias("s"), "edge"), at_edge, "left_semi") if level else base
        sums = inside.groupBy("source", bucket(level).alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("before", F.sum("words").over(run) - F.col("words"))
        e = edge.alias("e")
        joined = e.join(sums.alias("s"), F.col("e.source").eqNullSafe(F.col("s.source")), "left")
        within = F.col("e.below") + F.col("s.before") <= F.col("e.rest")
        pick = F.max(F.when(within, F.struct(F.col("s.bucket").alias("bucket"), F.col("s.before").alias("before"), F.col("s.words").alias("words"))))
        edge = joined.groupBy(*(F.col(f"e.{c}").alias(c) for c in ("source", "source_size", "target", "passes", "rest", "below", "edge"))).agg(pick.alias("p"))
        words = F.coalesce(F.col("p.words"), F.lit(0))
        edge = edge.withColumns({"below": F.col("below") + F.coalesce(F.col("p.before"), F.lit(0)), "edge": F.coalesce(F.col("p.bucket"), F.shiftleft("edge", BITS)), "words": words})
        edge = settle(edge.drop("p"))
    #: the last bucket holds a document or copies of it: take it if that comes nearer
    take_edge = F.abs(F.col("below") + F.col("words") - F.col("rest")) < F.abs(F.col("below") - F.col("rest"))
    cut = edge.select(F.col("source").alias("s"), "source_size", "target", "passes", (F.col("edge") + take_edge.cast("long")).alias("threshold"))
    taken = F.col("size") * (F.col("passes") + (bucket(LEVELS - 1) < F.col("threshold")).cast("long"))
    return base.join(cut, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", taken.alias("taken"))
