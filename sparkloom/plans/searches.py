"""Searches through the index of trigrams (groups B, C10, G10, G11, I17): the rows of the scans, from candidate texts only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import stem
from sparkloom.functions import text as t
from sparkloom.operators import fulltext as ft
from sparkloom.operators import grams, graph, rules, similar
from sparkloom.plans import pipelines, relational, retrieval, texts  # noqa: F401  whose oracles hold here, too
from sparkloom.registry import ORACLES, query
from sparkloom.session import shared_path, spread, table

#: Indexes of a session, by the folder of their tables: built by the first query that needs them.
_INDEXES: dict[tuple, grams.GramIndex] = {}
_ENGLISH: dict[tuple, str] = {}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def gram_index(spark: SparkSession, sf_dir: str) -> grams.GramIndex:
    """The documents' trigrams, written to the shared folder."""
    mark = (spark.sparkContext.applicationId, sf_dir)
    if mark not in _INDEXES:
        _INDEXES[mark] = grams.write_grams(_docs(spark, sf_dir), shared_path(spark, f"grams-{uuid.uuid4().hex}"))
    return _INDEXES[mark]


def english_index(spark: SparkSession, sf_dir: str) -> str:
    """The documents' English stems and their places, written to the shared folder."""
    mark = (spark.sparkContext.applicationId, sf_dir)
    if mark not in _ENGLISH:
        path = shared_path(spark, f"english-{uuid.uuid4().hex}")
        ft.write_english(_docs(spark, sf_dir), path)
        _ENGLISH[mark] = path
    return _ENGLISH[mark]


def _with(spark: SparkSession, sf_dir: str, found: DataFrame, column: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", column).join(found.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")


@query("B1_ilike_indexed", ORACLES["B1_ilike_substring"])
def ilike_indexed(spark, sf_dir):
    either = [("", "ILIKE", "%tion_with%"), ("", "ILIKE", "%license%")]
    return _with(spark, sf_dir, grams.match_rules(spark, gram_index(spark, sf_dir), either), "source")


@query("B2_regex_indexed", ORACLES["B2_regex_ignorecase"])
def regex_indexed(spark, sf_dir):
    return _with(spark, sf_dir, grams.search_regex(spark, gram_index(spark, sf_dir), "(?i)(^|[^a-z])(license|copyright|token|login)([^a-z]|$)"), "lang")


@query("B7_text_match_indexed", "SELECT doc_id FROM documents WHERE contains(lower(text), 'erthor') OR contains(lower(text), 'eauoi')")
def text_match_indexed(spark, sf_dir):
    return grams.search_words(spark, gram_index(spark, sf_dir), ["Erthor", "EAUOI"], "doc_id").select("doc_id")


@query("G10_weighted_keywords_indexed", ORACLES["G10_weighted_keywords"])
def weighted_keywords_indexed(spark, sf_dir):
    held = grams.search_words(spark, gram_index(spark, sf_dir), ["er_or", "tion", "shall"])
    return ft.search_keywords(held, "er_or tion", 20, primary=["shall"])


@query("G11_keyword_count_indexed", ORACLES["G11_keyword_count"])
def keyword_count_indexed(spark, sf_dir):
    return ft.search_keywords(grams.search_words(spark, gram_index(spark, sf_dir), ["tion", "heit"]), "tion heit", 20, technical=1.0)


@query("I17_pattern_scan_indexed", ORACLES["I17_pattern_scan"])
def pattern_scan_indexed(spark, sf_dir):
    held = grams.search_regex(spark, gram_index(spark, sf_dir), "[Tt]ion[a-z]*")
    return t.pattern_scan(held, "[Tt]ion[a-z]*", per_file=3).select("id", "line", "match")


@query("C10_rules_indexed", ORACLES["C10_rules_by_chunks"])
def rules_indexed(spark, sf_dir):
    return grams.match_rules(spark, gram_index(spark, sf_dir), [(r.id, "REGEX", "(?i)" + r.pattern) for r in rules.MIGRATION_RULES])


# -- English: stems and covers -----------------------------------------------------------------------------------------


def _english(stems: tuple[str, ...]) -> str:
    """c(id, n, rank) of texts with a hit: the number of hits, and the rank by covers if every stem is there. The sweep is
    stated by windows."""
    near = " OR ".join(f"starts_with(w, '{x[: max(1, len(x) - 2)]}')" for x in stems)
    last = ", ".join(f"max(i) FILTER (term = {n + 1}) OVER o AS l{n}" for n in range(len(stems)))
    first = f"CASE WHEN {' AND '.join(f'l{n} IS NOT NULL' for n in range(len(stems)))} THEN least({', '.join(f'l{n}' for n in range(len(stems)))}) END"
    return f"""WITH t AS (SELECT id, pos, w FROM (SELECT doc_id AS id, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS l FROM documents) d) u WHERE {near}),
h AS (SELECT id, pos, term, row_number() OVER (PARTITION BY id ORDER BY pos) AS i FROM (SELECT id, pos, list_position([{', '.join(map(repr, stems))}], {stem.stem_sql('w', stem.DUCK)}) AS term FROM t) x WHERE term > 0),
l AS (SELECT *, {last} FROM h WINDOW o AS (PARTITION BY id ORDER BY pos)), f AS (SELECT *, {first} AS first FROM l),
v AS (SELECT id, i, pos, first FROM (SELECT *, lag(first) OVER (PARTITION BY id ORDER BY i) AS before FROM f) y WHERE first IS NOT NULL AND first IS DISTINCT FROM before),
r AS (SELECT v.id, sum(0.1 / (1 + v.pos - h.pos - (v.i - v.first))) AS rank FROM v JOIN h ON h.id = v.id AND h.i = v.first GROUP BY v.id),
c AS (SELECT id, n, rank FROM (SELECT id, count(*) AS n FROM h GROUP BY id) z LEFT JOIN r USING (id))"""


_EVERY = "SELECT id, round(rank, 6) AS score FROM c WHERE rank IS NOT NULL ORDER BY rank DESC, id LIMIT {} OFFSET {}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query("G5_english_any", _english(("ere", "oner", "thth")) + " SELECT id, round(n * 0.1, 6) AS score FROM c ORDER BY n DESC, id LIMIT 25")
def english_any(spark, sf_dir):
    return _rounded(ft.search_english(_docs(spark, sf_dir), "the ering of oners thth on", 25, every=False, least=3))


@query("G6_english_all", _english(("thing", "ere", "ther")) + _EVERY.format(20, 0))
def english_all(spark, sf_dir):
    return _rounded(ft.search_english(_docs(spark, sf_dir), "the Things ered by thers", 20))


@query("G6_english_indexed", _english(("thing", "ere", "ther")) + _EVERY.format(20, 0))
def english_all_indexed(spark, sf_dir):
    return _rounded(ft.search_english_index(spark, english_index(spark, sf_dir), "the Things ered by thers", 20))


@query("G7_english_offset", _english(("thing", "tion")) + _EVERY.format(10, 10))
def english_offset(spark, sf_dir):
    return _rounded(ft.search_english(_docs(spark, sf_dir), "things tions", 10, skip=10))


@query("G8_english_staged", _english(("thing", "ere", "ther")) + " SELECT id, 1 AS stage, round(rank, 6) AS score FROM c WHERE rank IS NOT NULL ORDER BY rank DESC, id LIMIT 12")
def english_staged(spark, sf_dir):
    return _rounded(ft.search_english_staged(_docs(spark, sf_dir), "the Things ered by thers", 12))


@query("G8_english_any_stage", _english(("thing", "zzzz")) + " SELECT id, 2 AS stage, 1.0 AS score FROM c ORDER BY id LIMIT 12")
def english_any_stage(spark, sf_dir):
    return ft.search_english_staged(_docs(spark, sf_dir), "things zzzz", 12)


# -- sets, intervals and running budgets -------------------------------------------------------------------------------
_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, CAST(length(w) + 2 AS BIGINT)), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query("I13_similar_pairs", f"SELECT a, b, round(shared_ / (len(x) + len(y) - shared_), 6) AS similarity FROM (SELECT a, b, x, y, len(list_intersect(x, y)) AS shared_ FROM (SELECT DISTINCT s_name AS a, {_TRI.format('s_name')} AS x FROM supplier) s, (SELECT DISTINCT c_name AS b, {_TRI.format('c_name')} AS y FROM customer) c) p WHERE shared_ >= 0.2 * (len(x) + len(y) - shared_)")
def similar_names(spark, sf_dir):
    """Names of suppliers and customers with similar trigrams, by the set-similarity join."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("a")).distinct().withColumn("items", t.trigrams(F.col("a")))
    b = table(spark, sf_dir, "customer").select(F.col("c_name").alias("b")).distinct().withColumn("items", t.trigrams(F.col("b")))
    return similar.similar_pairs(a, b, 0.2).withColumn("similarity", F.round("similarity", 6))


@query("C6_interval_binned", ORACLES["C6_interval_overlap"])
def interval_binned(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    a = turns.select("conv_id", "turn", F.col("turn").alias("begin"), (F.col("turn") + 1).alias("end"))
    b = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("turn").alias("begin"), (F.col("turn") + 2).alias("end"))
    return graph.overlapping(a, b, ["conv_id"], 4).select("conv_id", F.col("l.turn").alias("a_turn"), F.col("r.turn").alias("b_turn"))


@query("C6_shipping_overlap", "SELECT a.l_orderkey, a.l_linenumber AS a_line, b.l_linenumber AS b_line FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND datediff('day', DATE '1990-01-01', a.l_shipdate::DATE) <= datediff('day', DATE '1990-01-01', b.l_shipdate::DATE) + b.l_linenumber * 5 AND datediff('day', DATE '1990-01-01', b.l_shipdate::DATE) <= datediff('day', DATE '1990-01-01', a.l_shipdate::DATE) + a.l_linenumber * 5")
def shipping_overlap(spark, sf_dir):
    """Lines of an order that are under way at the same time, each for five days a line number."""
    begin = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", begin.alias("begin"), (begin + F.col("l_linenumber") * 5).alias("end"))
    met = graph.overlapping(lines, lines, ["l_orderkey"], 16).where("l.l_linenumber < r.l_linenumber")
    return met.select("l_orderkey", F.col("l.l_linenumber").alias("a_line"), F.col("r.l_linenumber").alias("b_line"))


@query("E6_running_budget_blocks", "SELECT doc_id, source, spent FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS spent FROM documents) s WHERE spent <= 100000")
def running_budget(spark, sf_dir):
    """The longest documents of each source within a budget; one source may hold any number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return graph.pack_within_blocks(docs, 100_000, F.col("n_chars"), ["source"], [F.desc("n_chars"), "doc_id"]).select("doc_id", "source", "spent")
