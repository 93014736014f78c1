"""Extractors, splitters, catalogs and providers over stand-in tables (groups A, F10, I6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.registry import query
from sparkloom.session import table
from sparkloom.sources import code, extract, files


@query("A1_folder_files")
def folder_files(spark, sf_dir):
    """The parquet folder's own tables as files, by name."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(sf_dir)
    return f.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.col("length").alias("size"))


_W = "(SELECT id, w FROM (SELECT doc_id AS id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents) x WHERE len(w) >= 8)"


@query("A7_markdown_sections", f"SELECT id, 0 AS at, w[1] AS heading, 1 AS level, 'text' AS kind, '- **' || w[2] || '** see [' || w[3] || '](docs/' || w[4] || '.md) and `' || w[5] || '()`' AS content FROM {_W} a UNION ALL SELECT id, 1, w[6], 2, 'text', '`' || w[7] || '.' || w[8] || '`' FROM {_W} b")
def markdown_sections(spark, sf_dir):
    from sparkloom.plans.texts import _markdown

    return extract.sections_of(_markdown(spark, sf_dir), extract.markdown_sections)


@query("A8_html_sections")
def html_sections(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("content"))
    return extract.sections_of(pages, extract.html_sections)


@query("A9_page_sections")
def page_sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("1.2 Overview\n\n"), "text", F.lit("\f2 Code\n\n    x = 1;\n    y = 2;\n")).alias("content"))
    return extract.sections_of(docs, extract.page_sections)


@query("I6_split_text")
def split_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return code.explode_with(docs, lambda x: list(enumerate(code.split_text(x or ""))), "chunk long, content string")


@query("A13_schemas")
def schemas(spark, sf_dir):
    return files.list_schemas(spark)


@query("A18_embed")
def embed(spark, sf_dir):
    docs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    return files.embed_missing(docs, docs.where(F.lit(False)), files.hash_embedder(), 32)


@query("F10_embed_missing")
def embed_missing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    done = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return files.embed_missing(docs, done, files.hash_embedder(), 32)


