"""Scans of a file tree through the data source (A1, A3): the documents written as folders of text files, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.registry import query, sql
from sparkloom.session import shared_path
from sparkloom.sources.tree import tree

#: Lines of a file.
LINES = 10_000


def written(spark: SparkSession, sf_dir: str) -> str:
    """A folder a source and language, whose files have a line a document; gone with the application."""
    root = shared_path(spark, f"tree-{uuid.uuid4().hex}")
    rows = sql(spark, sf_dir, "SELECT concat('s', hex(coalesce(source, ''))) AS s, concat('l', hex(coalesce(lang, ''))) AS l, concat(doc_id, ' ', sha2(coalesce(text, ''), 256)) AS value FROM {documents}")
    rows.write.partitionBy("s", "l").option("maxRecordsPerFile", LINES).text(root)
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(where)
    return files.makeQualified(where).toString()


def _name(level: int, letter: str):
    return F.decode(F.unhex(F.regexp_extract(F.get(F.split("path", "/"), F.lit(level)), f"={letter}(.*)$", 1)), "utf-8")


def _lines(files: DataFrame) -> DataFrame:
    return files.select(_name(0, "s").alias("source"), _name(1, "l").alias("lang"), F.explode(F.split("content", "\n")).alias("line")).where("line <> ''")


@query("A3_tree_scan", "SELECT doc_id AS id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, sha256(coalesce(text, '')) AS digest FROM documents")
def tree_scan(spark, sf_dir):
    files = tree(spark, written(spark, sf_dir), exclude="_temporary").where("ending = 'txt'")
    return _lines(files).select(F.split_part("line", F.lit(" "), F.lit(1)).cast("long").alias("id"), "source", "lang", F.split_part("line", F.lit(" "), F.lit(2)).alias("digest"))


@query("A1_tree_folders", "SELECT coalesce(source, '') AS source, count(DISTINCT coalesce(lang, '')) AS folders, CAST(sum(length(doc_id::VARCHAR) + 66) AS BIGINT) AS bytes FROM documents GROUP BY coalesce(source, '')")
def tree_folders(spark, sf_dir):
    """Folders and bytes below each top folder; names and sizes only, no file is opened."""
    files = tree(spark, written(spark, sf_dir), contents=False).where("ending = 'txt'")
    return files.select(_name(0, "s").alias("source"), _name(1, "l").alias("lang"), "size").groupBy("source").agg(F.count_distinct("lang").alias("folders"), F.sum("size").alias("bytes"))
