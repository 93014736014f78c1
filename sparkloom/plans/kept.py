"""Boards that change sets keep (D19 to D21): a state of old rows is folded with the change set that leads to the given tables.

What the rows were is made of the tables: some weren't there, some had other values, some are gone by now. The oracle is the
scan of the tables as they are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators.incremental import changes
from sparkloom.operators.kept import N, SIGN, Measure, fold, fold_distinct, signed, state_of
from sparkloom.registry import query, sql

_ORDERS = "SELECT o_orderkey AS id, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM {orders}"
#: some orders come, some had another state, price or customer; those with a negative key go
_ORDERS_OLD = f"SELECT id, CASE WHEN id % 9 = 4 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, CASE WHEN id % 5 = 0 THEN 'P' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN id % 7 = 0 THEN cents + 5000 ELSE cents END AS cents FROM ({_ORDERS}) WHERE id % 11 <> 3 UNION ALL SELECT -id, o_custkey, 'O', cents * 2 FROM ({_ORDERS}) WHERE id % 13 = 6"
_HEALTH = (Measure("failed", "sum", "IF(o_orderstatus = 'P', 1, 0)"), Measure("open_", "sum", "IF(o_orderstatus = 'O', 1, 0)"), Measure("cents", "sum", "cents"), Measure("dearest", "max", "cents"), Measure("cheapest", "min", "cents"))


def _moves(old, new):
    digest = lambda df: df.select("id", F.xxhash64(*(c for c in df.columns if c != "id")).alias("h"))
    return signed(old, new, changes(digest(old), digest(new)))


@query(
    "D21_repo_health_kept",
    "SELECT o_custkey, count(*) AS n, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'red' WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 5 THEN 'yellow' ELSE 'green' END AS health, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS dearest, min(CAST(round(o_totalprice * 100) AS BIGINT)) AS cheapest FROM orders GROUP BY o_custkey",
)
def repo_health_kept(spark, sf_dir):
    old, new = sql(spark, sf_dir, _ORDERS_OLD), sql(spark, sf_dir, _ORDERS)
    state = fold(state_of(old, ["o_custkey"], _HEALTH), _moves(old, new), new, ["o_custkey"], _HEALTH)
    health = F.when(F.col("failed") > 0, "red").when(F.col("open_") > 5, "yellow").otherwise("green")
    return state.select("o_custkey", F.col(N).alias("n"), health.alias("health"), "cents", "dearest", "cheapest")


#: Documents with what is known of each: a vector, a label.
_KNOWN = "SELECT d.doc_id AS id, d.source, d.lang, CAST(e.vec_id IS NOT NULL AS INT) AS embedded, CAST(l.doc_id IS NOT NULL AS INT) AS labelled FROM {documents} d LEFT JOIN (SELECT DISTINCT vec_id FROM {embeddings}) e ON d.doc_id = e.vec_id LEFT JOIN (SELECT DISTINCT doc_id FROM {labels}) l ON d.doc_id = l.doc_id"
_KNOWN_OLD = "SELECT id, source, CASE WHEN id % 10 = 1 THEN 'xx' ELSE lang END AS lang, CASE WHEN id % 4 = 0 THEN 0 ELSE embedded END AS embedded, CASE WHEN id % 6 = 0 THEN 1 - labelled ELSE labelled END AS labelled FROM {known} WHERE id % 5 <> 2"
_COVER = (Measure("embedded", "sum", "embedded"), Measure("labelled", "sum", "labelled"))


@query(
    "D20_coverage_kept",
    f"SELECT source, what, total, covered, round(covered / total, 6) AS ratio, covered < 0.95 * total AS lagging FROM (SELECT source, 'embedding' AS what, count(*) AS total, CAST(sum(embedded) AS BIGINT) AS covered FROM ({_KNOWN}) k GROUP BY source UNION ALL SELECT source, 'label', count(*), CAST(sum(labelled) AS BIGINT) FROM ({_KNOWN}) k GROUP BY source) b".replace("{", "").replace("}", ""),
)
def coverage_kept(spark, sf_dir):
    new = sql(spark, sf_dir, _KNOWN)
    old = sql(spark, sf_dir, _KNOWN_OLD, known=new)
    state = fold(state_of(old, ["source"], _COVER), _moves(old, new), new, ["source"], _COVER)
    each = state.select("source", F.col(N).alias("total"), F.explode(F.create_map(F.lit("embedding"), F.col("embedded"), F.lit("label"), F.col("labelled"))).alias("what", "covered"))
    return each.select("source", "what", "total", "covered", F.round(F.col("covered") / F.col("total"), 6).alias("ratio"), (F.col("covered") < 0.95 * F.col("total")).alias("lagging"))


@query("D19_languages_kept", "SELECT source, count(DISTINCT lang) AS n FROM documents WHERE lang IS NOT NULL GROUP BY source")
def languages_kept(spark, sf_dir):
    """Languages of a source: a distinct count kept by counts of source and language."""
    new = sql(spark, sf_dir, _KNOWN)
    old = sql(spark, sf_dir, _KNOWN_OLD, known=new)
    values = state_of(old.where("lang IS NOT NULL"), ["source", "lang"], ())
    state, _ = fold_distinct(state_of(values, ["source"], ()), values, _moves(old, new).select("source", "lang", SIGN), ["source"], "lang")
    return state.select("source", F.col(N).alias("n"))
