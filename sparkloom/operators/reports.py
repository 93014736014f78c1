"""Reports over files, documents and schemas: directories, drift, schema statistics, summaries without a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Purpose of a document by its kind; fixed values.
PURPOSES = {"epas_docs": "reference", "migration_toolkit": "migration-guide", "migration_issues": "troubleshooting", "oracle_docs": "reference", "postgres_docs": "reference", "general": "reference"}
#: Order of severities; fixed values.
SEVERITIES = ("critical", "high", "medium", "low")


def directory_notes(files: DataFrame, most: int = 3, path: str = "path", language: str = "language") -> DataFrame:
    """The folders with most files: folder, n, languages; files at the top are in `root`."""
    folder = F.when(F.contains(F.col(path), F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise("root")
    out = files.groupBy(folder.alias("folder")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(language)).alias("languages"))
    return out.orderBy(F.desc("n"), "folder").limit(most)


def drift_list(issues: DataFrame, verifications: DataFrame, claims: DataFrame, documents: DataFrame, status: str = "open", most: int = 50) -> DataFrame:
    """Open drift issues with their claim and document, by severity and id: issue (id, verification_id, severity, status),
    verification (id, claim_id), claim (id, document_id, claim), document (id, title)."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(0))
    rank = F.when(rank == 0, len(SEVERITIES) + 1).otherwise(rank)
    v = verifications.select(F.col("id").alias("verification_id"), "claim_id")
    c = claims.select(F.col("id").alias("claim_id"), "document_id", "claim")
    d = documents.select(F.col("id").alias("document_id"), "title")
    out = issues.where(F.col("status") == status).join(v, "verification_id").join(c, "claim_id").join(d, "document_id")
    return out.select("id", "severity", "claim", "title").orderBy(rank, "id").limit(most)


def review(issues: DataFrame, ids: list[int], status: str, by: str) -> DataFrame:
    """Issues with a review's status and reviewer written to some of them."""
    hit = F.col("id").isin(ids)
    return issues.withColumns({"status": F.when(hit, F.lit(status)).otherwise(F.col("status")), "reviewed_by": F.when(hit, F.lit(by))})


def schema_stats(columns: DataFrame) -> DataFrame:
    """table, column, type, nullable -> a row for each table: n_columns, n_types, n_nullable."""
    return columns.groupBy("table").agg(F.count("*").alias("n_columns"), F.countDistinct("type").alias("n_types"), F.count(F.when(F.col("nullable"), 1)).alias("n_nullable"))


def table_context(columns: DataFrame, usage: DataFrame, table: str, most: int = 20) -> DataFrame:
    """A table's columns in order, with the number of places that use each."""
    n = usage.groupBy("column").agg(F.count("*").alias("n_used"))
    return columns.where(F.col("table") == table).join(n, "column", "left").select("column", "position", "type", F.coalesce("n_used", F.lit(0)).alias("n_used")).orderBy("position").limit(most)


def simple_summary(documents: DataFrame, features: DataFrame, chunks: DataFrame, kind: str = "kind") -> DataFrame:
    """id, kind; id, name, category, type, mentions; id -> id, topics (the ten most mentioned), audience, purpose, summary."""
    of = F.struct((-F.col("mentions")).alias("m"), "name")
    topics = F.transform(F.slice(F.array_sort(F.collect_list(of)), 1, 10), lambda x: x["name"])
    n = lambda c: F.count(F.when(F.col("category") == c, 1))
    found = features.groupBy("id").agg(topics.alias("topics"), n("oracle").alias("oracle"), n("epas").alias("epas"), F.slice(F.array_sort(F.collect_set("type")), 1, 3).alias("types"))
    sections = chunks.groupBy("id").agg(F.count("*").alias("sections"))
    out = documents.select("id", F.col(kind).alias("kind")).join(found, "id", "left").join(sections, "id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"topics": F.coalesce("topics", none), "types": F.coalesce("types", none), **{c: F.coalesce(c, F.lit(0)) for c in ("oracle", "epas", "sections")}})
    about = F.contains(F.lower("kind"), F.lit("migration")) | F.exists("topics", lambda t: F.contains(F.lower(t), F.lit("migration")))
    audience = F.when(about, "developers").when(F.col("epas") > F.col("oracle"), "dbas").otherwise("developers")
    purposes = F.create_map(*(F.lit(x) for pair in PURPOSES.items() for x in pair))
    #: the words of the sentence are fixed values
    what = F.when(F.size("types") > 0, F.array_join("types", ", ")).otherwise("content")
    oracle = F.when(F.col("oracle") > 0, F.concat(F.lit("with "), F.col("oracle").cast("string"), F.lit(" Oracle-specific constructs")))
    epas = F.when(F.col("epas") > 0, F.concat(F.when(F.col("oracle") > 0, "and ").otherwise("with "), F.col("epas").cast("string"), F.lit(" EPAS features")))
    text = F.concat_ws(" ", F.concat(F.lit("Documentation covering "), what), oracle, epas, F.concat(F.lit("across "), F.col("sections").cast("string"), F.lit(" content sections.")))
    return out.select("id", "topics", audience.alias("audience"), F.coalesce(purposes[F.col("kind")], F.lit("reference")).alias("purpose"), text.alias("summary"))


def first_sentence(text: Column, most: int = 200) -> Column:
    """A stand-in for a generated summary."""
    return F.substring(F.substring_index(text, ".", 1), 1, most)
