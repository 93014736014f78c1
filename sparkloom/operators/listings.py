"""Listings over files and tables: pages, globs, line ranges, latest rows, time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.files import glob_regex


def table_page(rows: DataFrame, order: Sequence, size: int, skip: int = 0) -> DataFrame:
    """A page of a table in a given order, with the number of all rows as `total`."""
    total = rows.agg(F.count("*").alias("n"))
    return rows.orderBy(*order).offset(skip).limit(size).withColumn("total", total.scalar())


def list_files(files: DataFrame, glob: str | None = None, languages: Sequence[str] = (), most: int = 500, path: str = "path", language: str = "language") -> DataFrame:
    """Files whose path fits a glob (`*` crosses folders) and whose language is one of some, by path."""
    if glob:
        files = files.where(F.col(path).rlike(glob_regex(glob)))
    if languages:
        files = files.where(F.col(language).isin(*languages))
    return files.orderBy(path).limit(most)


def language_histogram(files: DataFrame, language: str = "language") -> DataFrame:
    return files.groupBy(language).agg(F.count("*").alias("n"))


def inside_root(path: Column) -> Column:
    """Whether a path stays below the root: neither absolute nor with a step upwards."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def read_lines(files: DataFrame, first: int, last: int, path: str = "path", text: str = "content") -> DataFrame:
    """Adds lines (first to last, from 1), n_lines; both null for paths that leave the root."""
    lines = F.split(F.col(text), "\n")
    ok = inside_root(F.col(path))
    shown = F.array_join(F.slice(lines, F.lit(max(1, first)), F.lit(max(0, last - max(1, first) + 1))), "\n")
    return files.withColumns({"lines": F.when(ok, shown), "n_lines": F.when(ok, F.size(lines)).cast("long")})


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r")


def summary_documents(summaries: DataFrame) -> DataFrame:
    """entity, kind, summary -> documents: path, type, title, content, source."""
    title = F.concat(F.initcap("kind"), F.lit(" Summary: "), F.substring(F.col("entity"), 1, 8))
    return summaries.select(F.concat_ws("/", F.lit("summaries"), "kind", "entity").alias("path"), F.lit("GENERATED_SUMMARY").alias("type"), title.alias("title"), F.col("summary").alias("content"), F.lit("GENERATED").alias("source"))


def within_last(ts: Column, as_of: Column, interval: str) -> Column:
    """Whether a time lies in the interval before (and at) another."""
    return (ts > as_of - F.expr(f"INTERVAL {interval}")) & (ts <= as_of)


def backoff_seconds(attempts: Column, first: int = 60) -> Column:
    """The pause before a retry doubles with each attempt."""
    return (F.lit(first) * F.pow(F.lit(2), attempts)).cast("long")


def dead(last_seen: Column, as_of: Column, threshold: str) -> Column:
    """Whether a heartbeat is older than the threshold."""
    return last_seen < as_of - F.expr(f"INTERVAL {threshold}")
