"""Repositories and documentation trees as file sources, catalogs, and embedding providers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sparkloom.functions.text import content_hash, detect_language

#: Folders that documentation scans pass by; fixed values.
EXCLUDED = (".git", ".venv", "venv", "node_modules", "__pycache__", ".pytest_cache", "dist", "build", ".tox", ".mypy_cache", ".ruff_cache")
#: Kinds of documentation by extension; fixed values.
DOC_TYPES = {"md": "markdown", "rst": "restructuredtext", "adoc": "asciidoc", "sql": "sql_schema", "psql": "sql_schema", "ddl": "sql_schema"}


def glob_regex(pattern: str) -> str:
    """A file-name pattern as a regular expression; `*` crosses `/`."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : end]
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += ".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "_/" else "\\" + c
        i += 1
    return f"^{out}$"


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), uri and mtime of all files below a folder, also of those that Spark's own file sources pass
    over (empty ones, and names that begin with a dot or an underscore). The driver lists names, as these sources do."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.makeQualified(top)
    found = jvm.org.apache.spark.deploy.SparkHadoopUtil.get().listLeafStatuses(fs, top).mkString("\n")
    base = len(top.toString().rstrip("/")) + 1
    rows = [(m[1][base:], m[1], int(m[2]) / 1000) for m in re.finditer(r"path=(.*?); isDirectory=false;.*? modification_time=(\d+);", found)]
    return spark.createDataFrame(rows, "path string, uri string, mtime double").withColumn("mtime", F.timestamp_seconds("mtime"))


def read_contents(files: DataFrame) -> DataFrame:
    """uri -> also content, as text; bytes that are no UTF-8 are replaced. Executors open the files, of any store that Arrow knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for i, uri in enumerate(batch.column("uri").to_pylist()):
                fs, path = FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
                with fs.open_input_stream(path) as f:
                    text = f.read().decode(errors="replace")
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([text])], names=[*batch.schema.names, "content"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n).mapInArrow(run, StructType([*files.schema.fields, StructField("content", StringType())]))


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """Lines of an ignore file: names match anywhere, `/x` at the top, `x/` whole folders, `!x` takes back."""
    out = F.lit(False)
    for p in (x.strip() for x in patterns):
        if not p or p.startswith("#"):
            continue
        keep, p = p.startswith("!"), p.lstrip("!")
        body = glob_regex(p.strip("/"))[1:-1].replace(".*", "[^/]*")
        hit = path.rlike(("^" if p.startswith("/") or "/" in p.strip("/") else "(^|/)") + body + ("/" if p.endswith("/") else "(/|$)"))
        out = F.when(hit, not keep).otherwise(out)
    return out


def select_sources(files: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """path -> also language, of source files: no dot files, none that are ignored, known languages only."""
    files = files.withColumn("language", detect_language(F.col("path")))
    return files.where(~F.col("path").rlike(r"(^|/)\.") & F.col("language").isNotNull() & ~ignored(F.col("path"), ignore))


def select_docs(files: DataFrame) -> DataFrame:
    """path -> also type, of documentation and SQL scripts outside the excluded folders."""
    return files.withColumn("type", doc_type(F.col("path"))).where(F.col("type").isNotNull() & ~in_excluded(F.col("path")))


def scan_repo(spark: SparkSession, root: str, ignore: Sequence[str] = ()) -> DataFrame:
    """path, language, sha, mtime, content of the source files below a folder; others aren't opened."""
    found = read_contents(select_sources(list_tree(spark, root), ignore))
    return found.select("path", "language", content_hash(F.col("content")).alias("sha"), "mtime", "content")


def scan_docs(spark: SparkSession, root: str) -> DataFrame:
    """path, type, content of the documentation below a folder."""
    return read_contents(select_docs(list_tree(spark, root))).select("path", "type", "content")


def doc_type(path: Column) -> Column:
    """What kind of documentation a file is by its extension, or null."""
    kinds = F.create_map(*(F.lit(x) for pair in DOC_TYPES.items() for x in pair))
    return kinds[F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))]


def in_excluded(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED)))


def table_names(spark: SparkSession, folder: str) -> list[str]:
    """The Parquet tables of a folder, by name; any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = (f.getPath().getName() for f in found)
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


def list_schemas(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW DATABASES").select(F.col("namespace").alias("schema"))


def describe_catalog(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """table, position, column, type, nullable of some frames; catalogs are bounded by their tables' columns."""
    rows = [(t, i, f.name, f.dataType.simpleString(), f.nullable) for t, df in sorted(frames.items()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table string, position int, column string, type string, nullable boolean")


def hash_embedder(dim: int = 32) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic provider for work without a service: signed counts of hashed words, at length 1."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dim
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1.0 if h >> 32 & 1 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return embed


def embed_missing(docs: DataFrame, done: DataFrame, embed: Callable[[list[str]], list[list[float]]], dim: int, key: str = "id", text: str = "content", max_chars: int | None = None, batch: int = 100, retries: int = 3) -> DataFrame:
    """key, vector for documents without one. Failing batches are tried again, then get zero vectors.
    `max_chars` is the provider's limit, if it has one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for i in range(0, len(df), batch):
                part = df.iloc[i : i + batch]
                vectors = None
                for _ in range(retries):
                    try:
                        vectors = embed([(x or "")[:max_chars] for x in part[text]])
                        break
                    except OSError:
                        continue
                yield pd.DataFrame({key: part[key], "vector": vectors or [[0.0] * dim] * len(part)})

    todo = docs.join(done.select(key), key, "left_anti").select(key, text)
    return todo.mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, vector array<double>")
