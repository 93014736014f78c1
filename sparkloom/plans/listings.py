"""Files, listings, tags, validation and reports over the stand-in repository (groups A, G, H, I, J, K)."""

from __future__ import annotations

import difflib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as t
from sparkloom.operators import fulltext as ft
from sparkloom.operators import claims, graph, incremental, listings, ranking, reports, rules
from sparkloom.plans.stand_ins import COMPONENTS, FILES, PATCHES, REFERENCES, SCRIPTS, SOURCES, duck, frame
from sparkloom.registry import ORACLES, query, sql
from sparkloom.session import shared_path, table
from sparkloom.sources import code, extract, files
from sparkloom.streaming import queue
from sparkloom.streaming.sink import KeyedTable

_F, _S, _SQL = duck(FILES), duck(SOURCES), duck(SCRIPTS)
_LANG = "CASE regexp_extract(path, '([.][a-z]+)$', 1) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.tsx' THEN 'typescript' WHEN '.go' THEN 'go' WHEN '.java' THEN 'java' WHEN '.h' THEN 'c' WHEN '.sql' THEN 'sql' END"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, FILES)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, SOURCES)


# -- scans -------------------------------------------------------------------------------------------------------------
@query("A1_scan_repo", f"SELECT id, path, {_LANG} AS language, substring(sha256(content), 1, 16) AS sha FROM {_F} f WHERE NOT regexp_matches(path, '(^|/)[.]') AND {_LANG} IS NOT NULL AND NOT regexp_matches(path, '^src1(/|$)|(^|/)node_modules/')")
def scan_repo(spark, sf_dir):
    return files.select_sources(_files(spark, sf_dir), ["# ours", "/src1", "node_modules/"]).select("id", "path", "language", t.content_hash(F.col("content")).alias("sha"))


@query("A2_detect_language", f"SELECT id, {_LANG} AS language FROM {_F} f")
def detect_language(spark, sf_dir):
    return _files(spark, sf_dir).select("id", t.detect_language(F.col("path")).alias("language"))


@query("A3_scan_docs", f"SELECT id, path, CASE WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.rst' THEN 'restructuredtext' ELSE 'sql_schema' END AS type FROM {_F} f WHERE regexp_matches(path, '[.](md|rst|sql)$') AND NOT contains(path, 'node_modules/')")
def scan_docs(spark, sf_dir):
    return files.select_docs(_files(spark, sf_dir)).select("id", "path", "type")


@query("A6_summary_as_document", "SELECT 'summaries/file/' || conv_id AS path, 'GENERATED_SUMMARY' AS type, 'File Summary: ' || substring(CAST(conv_id AS VARCHAR), 1, 8) AS title, arg_max(text, turn) AS content FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY conv_id UNION ALL SELECT 'summaries/file/x' || doc_id, 'GENERATED_SUMMARY', 'old', 'old' FROM documents WHERE doc_id < 20")
def summary_as_document(spark, sf_dir):
    """The last answer of a conversation is its summary; documents of summaries are there already, some of them old."""
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant' AND text IS NOT NULL")
    last = listings.latest(answers, ["conv_id"], [F.desc("turn")])
    new = listings.summary_documents(last.select(F.col("conv_id").cast("string").alias("entity"), F.lit("file").alias("kind"), F.col("text").alias("summary")))
    kept = sql(spark, sf_dir, "SELECT 'summaries/file/x' || doc_id AS path, 'GENERATED_SUMMARY' AS type, 'old' AS title, 'old' AS content, 'GENERATED' AS source FROM {documents} WHERE doc_id < 20")
    again = new.select("path", "type", F.lit("old").alias("title"), F.lit("old").alias("content"), "source")
    return incremental.upsert(kept.unionByName(again), new, ["path"]).drop("source")


@query("A14_table_page", "SELECT s_suppkey, s_name, s_acctbal, (SELECT count(*) FROM supplier) AS total FROM supplier ORDER BY s_name, s_suppkey LIMIT 10 OFFSET 5")
def table_page(spark, sf_dir):
    return listings.table_page(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), ["s_name", "s_suppkey"], 10, 5)


@query("A15_list_files", f"SELECT id, path FROM {_F} f WHERE regexp_matches(path, '^src1.*/.*[.]..*$') AND {_LANG} IN ('java', 'c') ORDER BY path LIMIT 500")
def list_files(spark, sf_dir):
    named = _files(spark, sf_dir).withColumn("language", t.detect_language(F.col("path")))
    return listings.list_files(named, "src1*/*.?*", ["java", "c"]).select("id", "path")


@query("A15_language_histogram", f"SELECT language, count(*) AS n FROM (SELECT {_LANG} AS language FROM {_F} f) l GROUP BY language")
def language_histogram(spark, sf_dir):
    return listings.language_histogram(_files(spark, sf_dir).withColumn("language", t.detect_language(F.col("path"))))


@query("A16_read_lines", f"SELECT id, CASE WHEN NOT contains(path, '../') THEN array_to_string(list_slice(string_split(content, chr(10)), 2, 4), chr(10)) END AS lines, CASE WHEN NOT contains(path, '../') THEN len(string_split(content, chr(10))) END AS n_lines FROM {_F} f")
def read_lines(spark, sf_dir):
    return listings.read_lines(_files(spark, sf_dir), 2, 4).select("id", "lines", "n_lines")


@query("A17_catalog", "SELECT table_name AS \"table\", ordinal_position - 1 AS position, column_name AS \"column\" FROM information_schema.columns WHERE table_schema = 'main'")
def catalog(spark, sf_dir):
    """Schemas of all the folder's tables; only their footers are read."""
    frames = {n: table(spark, sf_dir, n) for n in files.table_names(spark, sf_dir)}
    return files.describe_catalog(spark, frames).select("table", "position", "column")


_PAIR = "PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC"


@query("A19_upsert_last_wins", f"SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER ({_PAIR.replace('ORDER BY', 'ORDER BY event_id % 3 = 0 DESC,')}) AS rn FROM events WHERE event_id % 3 = 0 OR event_id % 3 = 1) t WHERE rn = 1")
def upsert(spark, sf_dir):
    """Of old rows the last of each key is there; new ones replace them."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    order, keys = [F.desc("ts"), F.desc("event_id")], ["user_id", "event_type"]
    old = listings.latest(events.where("event_id % 3 = 1"), keys, order)
    return incremental.upsert(old, events.where("event_id % 3 = 0"), keys, order).select("user_id", "event_type", "value")


@query("A19_do_nothing", f"SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER ({_PAIR.replace('ORDER BY', 'ORDER BY event_id % 3 = 1 DESC,')}) AS rn FROM events WHERE event_id % 3 = 0 OR event_id % 3 = 1) t WHERE rn = 1")
def insert_new(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    order, keys = [F.desc("ts"), F.desc("event_id")], ["user_id", "event_type"]
    old = listings.latest(events.where("event_id % 3 = 1"), keys, order)
    return incremental.insert_new(old, events.where("event_id % 3 = 0"), keys, order).select("user_id", "event_type", "value")


# -- parsers -----------------------------------------------------------------------------------------------------------
@query("A11_template_scripts", f"SELECT id, 'export default ' || id AS script, 'typescript' AS language, [id % 4 + 4] AS lines FROM {duck(COMPONENTS)} c")
def template_scripts(spark, sf_dir):
    return code.explode_with(frame(spark, sf_dir, COMPONENTS), lambda x: [extract.scripts_of(x, ".vue")], "script string, language string, lines array<long>")


@query("A12_parse_files", f"SELECT id, language, len(string_split(content, chr(10))) AS n_lines, CASE language WHEN 'python' THEN 3 ELSE 2 END AS n_symbols FROM {_S} s")
def parse_files(spark, sf_dir):
    parse = lambda x, lang: [(lang, len(x.split("\n")), len(code.symbols_of(x, lang)))]
    return code.explode_with(_sources(spark, sf_dir), parse, "language string, n_lines long, n_symbols long", inputs=("content", "language"))


@query("I28_symbols", f"SELECT id, unnest(CASE language WHEN 'python' THEN [{{'fqn': 'C' || id, 'kind': 'class', 'start_line': 4}}, {{'fqn': 'C' || id || '.run', 'kind': 'method', 'start_line': 5}}, {{'fqn': 'helper' || id, 'kind': 'function', 'start_line': 8}}] ELSE [{{'fqn': 'add' || id, 'kind': 'function', 'start_line': 5}}, {{'fqn': 'Put' || id, 'kind': 'method', 'start_line': 9}}] END, recursive := true) FROM {_S} s")
def symbols(spark, sf_dir):
    return code.explode_with(_sources(spark, sf_dir), lambda x, lang: [(s[0], s[2], s[3]) for s in code.symbols_of(x, lang)], "fqn string, kind string, start_line long", inputs=("content", "language"))


@query("I29_edges", f"SELECT id, unnest(CASE language WHEN 'python' THEN [{{'src': '', 'dst': 'os', 'type': 'IMPORTS', 'confidence': 1.0}}, {{'src': '', 'dst': 'm' || (id % 5), 'type': 'IMPORTS', 'confidence': 1.0}}, {{'src': 'C' || id, 'dst': 'Base' || (id % 3), 'type': 'INHERITS', 'confidence': 0.8}}, {{'src': 'C' || id || '.run', 'dst': 'helper' || id, 'type': 'CALLS', 'confidence': 0.5}}, {{'src': 'helper' || id, 'dst': 'len', 'type': 'CALLS', 'confidence': 0.5}}] ELSE [{{'src': '', 'dst': 'fmt', 'type': 'IMPORTS', 'confidence': 1.0}}, {{'src': 'Put' || id, 'dst': 'add' || id, 'type': 'CALLS', 'confidence': 0.5}}] END, recursive := true) FROM {_S} s")
def edges(spark, sf_dir):
    return code.explode_with(_sources(spark, sf_dir), lambda x, lang: [e[:4] for e in code.edges_of(x, lang)], "src string, dst string, type string, confidence double", inputs=("content", "language"))


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, SCRIPTS)


@query("I3_sql_statements", f"SELECT id, 'CREATE_TABLE' AS kind, 2 AS first, 6 AS last, false AS data FROM {_SQL} s UNION ALL SELECT id, 'INSERT', i + 6, i + 6, true FROM (SELECT id, unnest(range(1, id % 4 + 1)) AS i FROM {_SQL} s) u UNION ALL SELECT id, 'CREATE_FUNCTION', id % 4 + 7, id % 4 + 13, false FROM {_SQL} s")
def sql_statements(spark, sf_dir):
    return code.explode_with(_scripts(spark, sf_dir), lambda x: [(k, a, b, d) for k, _, a, b, d in code.statements_of(x)], "kind string, first long, last long, data boolean")


@query("I4_sql_groups", f"SELECT id, 0 AS grp, CASE WHEN id % 4 = 0 THEN 2 ELSE 1 END AS n FROM {_SQL} s UNION ALL SELECT id, 1, id % 4 FROM {_SQL} s WHERE id % 4 > 0 UNION ALL SELECT id, 2, 1 FROM {_SQL} s WHERE id % 4 > 0")
def sql_groups(spark, sf_dir):
    return code.explode_with(_scripts(spark, sf_dir), lambda x: [(i, len(g)) for i, g in enumerate(code.group_statements(code.statements_of(x)))], "grp long, n long")


@query("I27_ddl_columns", f"SELECT id, unnest([{{'kind': 'table', 'name': 't' || id, 'item': 'id', 'type': 'BIGINT', 'nullable': false, 'fk': NULL}}, {{'kind': 'table', 'name': 't' || id, 'item': 'name', 'type': 'TEXT', 'nullable': false, 'fk': NULL}}, {{'kind': 'table', 'name': 't' || id, 'item': 'ref', 'type': 'BIGINT', 'nullable': true, 'fk': 't' || (id % 7) || '.id'}}, {{'kind': 'function', 'name': 'f' || id, 'item': 'a', 'type': 'INT', 'nullable': true, 'fk': NULL}}], recursive := true) FROM {_SQL} s")
def ddl_columns(spark, sf_dir):
    def parse(x):
        for _, s, *_ in code.statements_of(x):
            if d := code.parse_ddl(s):
                yield from ((d[0], d[1], c["name"], c["type"], c["nullable"], c["fk"]) for c in d[2])

    return code.explode_with(_scripts(spark, sf_dir), parse, "kind string, name string, item string, type string, nullable boolean, fk string")


@query("J25_database_report", f"SELECT 'CREATE_TABLE' AS kind, count(*) AS n, 0 AS dynamic, 0 AS complex FROM {_SQL} s UNION ALL SELECT 'INSERT', sum(id % 4), 0, 0 FROM {_SQL} s UNION ALL SELECT 'CREATE_FUNCTION', count(*), count(*), 0 FROM {_SQL} s")
def database_report(spark, sf_dir):
    """An inventory of all scripts with its risks: routines with dynamic SQL, and those over a complexity of 10."""
    statements = code.explode_with(_scripts(spark, sf_dir), lambda x: [(k, s) for k, s, *_ in code.statements_of(x)], "kind string, text string")
    m = t.routine_metrics(F.col("text"))
    routine = F.col("kind").isin("CREATE_FUNCTION", "CREATE_PROCEDURE")
    return statements.groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(routine & m["dynamic_sql"], 1)).alias("dynamic"), F.count(F.when(routine & (m["complexity"] > 10), 1)).alias("complex"))


@query("I7_breadcrumbs", "SELECT id, unnest([{'at': 0, 'path': a}, {'at': 1, 'path': a || ' > ' || b}, {'at': 2, 'path': a || ' > ' || c}], recursive := true) FROM (SELECT doc_id AS id, w[1] AS a, w[2] AS b, w[3] AS c FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents) x WHERE len(w) >= 3) y")
def breadcrumbs(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0).alias("w")).where(F.size("w") >= 3)
    text = F.concat(F.lit("# "), F.col("w")[0], F.lit("\nx\n## "), F.col("w")[1], F.lit("\ny\n## "), F.col("w")[2], F.lit("\nz"))
    paths = lambda x: [(i, " > ".join(b)) for i, b in enumerate(extract.breadcrumbs(extract.markdown_sections(x)))]
    return code.explode_with(w.select("id", text.alias("content")), paths, "at long, path string")


@query("I8_chunk_sizes", "SELECT DISTINCT p_size * 128 AS tokens, p_size * 512 * 7 // 10 AS target, p_size * 512 AS most, p_size * 512 // 10 AS least, p_size * 512 // 10 AS overlap FROM part")
def chunk_sizes(spark, sf_dir):
    tokens = F.col("p_size") * 128
    return table(spark, sf_dir, "part").select(tokens.alias("tokens"), *(c.alias(k) for k, c in t.chunk_sizes(tokens).items())).distinct()


@query("I14_sequence_match", "SELECT c_custkey AS id, 'X' || substring(n_name, 2) AS asked, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def sequence_match(spark, sf_dir):
    """The likeliest name for each misspelt one; the names are few."""
    names = [r["n_name"] for r in table(spark, sf_dir, "nation").orderBy("n_name").collect()]  # 25 rows

    def best(asked: str) -> list[tuple[str, str]]:
        scored = sorted(((difflib.SequenceMatcher(None, asked.lower(), n.lower()).ratio(), n) for n in names), reverse=True)
        return [(asked, n) for r, n in scored[:3] if r >= 0.6][:1]

    df = sql(spark, sf_dir, "SELECT c_custkey AS id, 'X' || substring(n_name, 2) AS asked FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey")
    #: each spelling is compared once, not once for each row that has it
    found = code.explode_with(df.select(F.col("asked").alias("content")).distinct().withColumn("id", F.lit(0)), best, "asked string, name string").drop("id")
    return df.join(found, "asked").select("id", "asked", "name")


_KIND = """CASE WHEN ref LIKE '%/%' AND regexp_matches(ref, '[.](py|js|md|go)$') THEN 'file' WHEN starts_with(ref, 'from ') OR starts_with(ref, 'import ') THEN 'import' WHEN starts_with(ref, '@') THEN 'symbol' WHEN regexp_matches(ref, '^[A-Za-z_][A-Za-z0-9_]*([.][A-Za-z_][A-Za-z0-9_]*)*[(].*[)]$') THEN 'symbol'
WHEN regexp_matches(ref, '^[A-Z][a-z0-9]+([A-Z][A-Za-z0-9]*)+$') THEN 'symbol' WHEN regexp_matches(ref, '^[A-Za-z_][A-Za-z0-9_]*([.][A-Za-z_][A-Za-z0-9_]*)+$') THEN 'module' WHEN regexp_matches(ref, '^[A-Za-z_][A-Za-z0-9_]*$') THEN 'symbol' END"""


@query("I16_reference_kind", f"SELECT id, ref, {_KIND} AS type, [0.9, 0.9, 0.85, 0.85, 0.85, 0.8, 0.7, 0.7, 0.75, 0.6, 0.0][id % 11 + 1]::DOUBLE AS confidence FROM {duck(REFERENCES)} r")
def reference_kind(spark, sf_dir):
    kind = t.reference_kind(F.col("ref"))
    return frame(spark, sf_dir, REFERENCES).select("id", "ref", kind["type"].alias("type"), kind["confidence"].alias("confidence"))


@query("I11_estimate_tokens", "SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def estimate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", graph.estimate_tokens(F.col("text")).alias("tokens"))


@query("I21_interval_window", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-01 00:00:00' - INTERVAL '90' DAY AND o_orderdate <= TIMESTAMP '1996-06-01 00:00:00'")
def interval_window(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(listings.within_last(F.col("o_orderdate"), F.expr("TIMESTAMP_NTZ '1996-06-01 00:00:00'"), "90 DAYS")).select("o_orderkey")


@query("I22_backoff", "SELECT o_orderkey, CAST(60 * power(2, o_orderkey % 6) AS BIGINT) AS retry_after_s FROM orders")
def backoff(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", listings.backoff_seconds(F.col("o_orderkey") % 6).alias("retry_after_s"))


@query("I24_diff_changes", "SELECT id, unnest([{'op': 'UPSERT', 'path': 'a' || id}, {'op': 'DELETE', 'path': 'c' || id}, {'op': 'DELETE', 'path': 'd' || id}, {'op': 'UPSERT', 'path': 'e' || id}], recursive := true) FROM (SELECT p_partkey AS id FROM part) p")
def diff_changes(spark, sf_dir):
    patch = "SELECT p_partkey AS id, 'M' || chr(9) || 'a' || p_partkey || chr(10) || 'D' || chr(9) || 'c' || p_partkey || chr(10) || 'R100' || chr(9) || 'd' || p_partkey || chr(9) || 'e' || p_partkey || chr(10) || 'A' || chr(9) || 'a' || p_partkey AS patch FROM {part}"
    return t.diff_changes(frame(spark, sf_dir, patch))


@query("K12_patch_sync", "SELECT p_partkey AS id, unnest(CASE p_partkey % 4 WHEN 1 THEN [{'op': 'DELETE', 'path': 'src/f' || p_partkey || '.py'}] WHEN 3 THEN [{'op': 'DELETE', 'path': 'src/f' || p_partkey || '.py'}, {'op': 'UPSERT', 'path': 'new/f' || p_partkey || '.py'}] ELSE [{'op': 'UPSERT', 'path': 'src/f' || p_partkey || '.py'}] END, recursive := true) FROM part")
def patch_sync(spark, sf_dir):
    return t.patch_changes(frame(spark, sf_dir, PATCHES))


#: Statements of each dialect, two marks and more in each, with a tie and single marks among them.
@query("A19_keyed_table", ORACLES["A19_upsert_last_wins"])
def keyed_table(spark, sf_dir):
    """The same two change sets, written to a keyed table one after the other and read back."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id", F.lit("upsert").alias("op"))
    kinds = dict(events.dtypes)
    kept = KeyedTable(spark, shared_path(spark, f"keyed-{uuid.uuid4().hex}"), ", ".join(f"{c} {kinds[c]}" for c in ("user_id", "event_type", "value")), ["user_id", "event_type"], 8)
    for rest in (1, 0):
        kept.apply(events.where(F.col("event_id") % 3 == rest), [F.desc("ts"), F.desc("event_id")])
    return kept.read()


_DIALECTS = """CASE o_orderkey % 8 WHEN 0 THEN 'SELECT NVL(a, 0), NVL2(b, 1, 2) FROM t' WHEN 1 THEN 'SELECT TOP 5 * FROM t WITH (NOLOCK)' || chr(10) || 'GO' WHEN 2 THEN 'CREATE TABLE `t` (id TINYINT AUTO_INCREMENT) ENGINE=InnoDB' WHEN 3 THEN 'SELECT seq.CURRVAL, SYSTIMESTAMP FROM x'
WHEN 4 THEN 'DECLARE [@a] NVARCHAR' WHEN 5 THEN 'f RETURN x IS' || chr(10) || '/' WHEN 6 THEN 'SELECT TOP 5 x FROM t WITH (NOLOCK) WHERE ROWNUM < 3 AND NVL(a, 1) = 1' ELSE 'SELECT SYSDATE' END"""


@query("I26_sql_dialect", "SELECT o_orderkey AS id, ['oracle', 'sqlserver', 'mysql', 'oracle', 'sqlserver', 'oracle', 'oracle', 'postgres'][o_orderkey % 8 + 1] AS dialect FROM orders")
def sql_dialect(spark, sf_dir):
    return frame(spark, sf_dir, f"SELECT o_orderkey AS id, {_DIALECTS} AS body FROM {{orders}}").select("id", t.sql_dialect(F.col("body")).alias("dialect"))


# -- search and ranking ------------------------------------------------------------------------------------------------
_CLEAN = r"""trim(regexp_replace(regexp_replace(lower(text), '[|&!():*<>$@#%^=+\[\]{}\\"'',;]', ' ', 'g'), '\s+', ' ', 'g'))"""


@query("G2_or_query", f"SELECT conv_id, turn, array_to_string(list_transform(list_filter(w, lambda x, i: len(x) >= 2 AND list_position(w, x) = i), lambda x: x || ':*'), ' | ') AS query FROM (SELECT conv_id, turn, string_split({_CLEAN}, ' ') AS w FROM conversations WHERE role = 'user') c")
def or_query(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", ft.or_query_column(F.col("text")).alias("query"))


_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(ft.STOP_WORDS)) + "]"


@query("G9_keywords", rf"""WITH c AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text || ' DBMS_OUTPUT XMLParser maxValue2 Dbms_Output A1 x', '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[a-zA-Z_][a-zA-Z0-9_]+$') AND NOT list_contains({_STOP}, lower(x))) AS w FROM conversations WHERE role = 'user'),
u AS (SELECT conv_id, turn, lower(w[i]) AS word, i, contains(w[i], '_') OR upper(w[i]) = w[i] OR regexp_matches(substring(w[i], 2), '[A-Z]') AS technical FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM c) x)
SELECT conv_id, turn, word, arg_min(technical, i) AS technical FROM u GROUP BY conv_id, turn, word""")
def keywords(spark, sf_dir):
    asked = F.concat("text", F.lit(" DBMS_OUTPUT XMLParser maxValue2 Dbms_Output A1 x"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.explode(ft.keywords_column(asked)).alias("k")).select("conv_id", "turn", "k.word", "k.technical")


_BASE = "(doc_id % 10) / 10.0::DOUBLE"
_TEXT = "text || CASE doc_id % 5 WHEN 0 THEN ' if (n >= 3) throw new Error' WHEN 1 THEN ' Math.min(2, n) limit reached' WHEN 2 THEN ' maximum of 3 items' ELSE '' END"


def _signals(x: str) -> str:
    any_ = " OR ".join(f"regexp_matches({x}, '(?i){p}')" for p in ranking.LIMIT_MESSAGES)
    expected = " OR ".join(f"regexp_matches({x}, '(?i){p.replace('{n}', '3')}')" for p in ranking.EXPECTED)
    return " + ".join([*(f"CAST(regexp_matches({x}, '(?i){p}') AS INT)" for p in ranking.ENFORCING), f"CAST({any_} AS INT)", f"2 * CAST({expected} AS INT)"])


@query("G18_enforcement_rerank", f"SELECT id, round(base * CASE WHEN contains(path, '/tests/') THEN 0.5 WHEN contains(path, 'service') THEN 1.1 ELSE 1.0 END * (1 + ({_signals('x')}) * 0.15) + (CAST(contains(lower(x), 'items') AS INT) + CAST(contains(lower(x), 'tion') AS INT)) * 0.02, 6) AS score FROM (SELECT f.id, f.path, {_BASE} AS base, {_TEXT} AS x FROM {_F} f JOIN documents d ON d.doc_id = f.id) r")
def enforcement_rerank(spark, sf_dir):
    spark_text = "content || CASE id % 5 WHEN 0 THEN ' if (n >= 3) throw new Error' WHEN 1 THEN ' Math.min(2, n) limit reached' WHEN 2 THEN ' maximum of 3 items' ELSE '' END"
    found = _files(spark, sf_dir).select("id", "path", F.expr(spark_text).alias("x"), (F.col("id") % 10 / 10).alias("base"))
    return found.select("id", F.round(ranking.enforcement_score(F.col("base"), F.col("path"), F.col("x"), ["Items tion"], "3 items"), 6).alias("score"))


@query("G19_key_files", f"WITH f AS (SELECT id, path, n_chars % 10 / 10.0::DOUBLE AS score FROM {_F} f), a AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS i FROM f WHERE id % 2 = 0 ORDER BY score DESC, id LIMIT 30), b AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS i FROM f WHERE id % 3 = 0 ORDER BY score DESC, id LIMIT 20), c AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS i FROM f WHERE id % 5 = 0 ORDER BY score DESC, id LIMIT 10) SELECT path, round(sum(s), 6) AS score FROM (SELECT path, score * ((SELECT count(*) FROM a) - i) * 3.0 AS s FROM a UNION ALL SELECT path, score * ((SELECT count(*) FROM b) - i) * 2.0 FROM b UNION ALL SELECT path, score * ((SELECT count(*) FROM c) - i) * 1.5 FROM c) u GROUP BY path")
def key_files(spark, sf_dir):
    scored = _files(spark, sf_dir).select("id", "path", (F.col("n_chars") % 10 / 10).alias("score"))
    top = lambda m, k: scored.where(F.col("id") % m == 0).orderBy(F.desc("score"), "id").limit(k)
    return ranking.key_files([(top(2, 30), 3.0), (top(3, 20), 2.0), (top(5, 10), 1.5)]).withColumn("score", F.round("score", 6))


@query("G20_citation", "SELECT doc_id, coalesce(CASE WHEN doc_id % 9 > 0 THEN source END, 'Unknown') || CASE WHEN doc_id % 4 > 0 THEN ', ' || lang || ' > ' || source ELSE '' END || CASE WHEN doc_id % 30 > 0 THEN ', Page ' || (doc_id % 30) ELSE '' END AS citation FROM documents")
def citation(spark, sf_dir):
    id_ = F.col("doc_id")
    made = ranking.citation(F.when(id_ % 9 > 0, F.col("source")), F.when(id_ % 4 > 0, F.array("lang", "source")), id_ % 30)
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("citation"))


_HITS = "len(list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '[\\p{L}\\p{N}_]+'), lambda x: starts_with(x, 'wid') OR starts_with(x, 'prom')))"


@query("G21_symbol_search", f"SELECT p_partkey AS id, {_HITS} * 0.1 AS score FROM part WHERE {_HITS} > 0 ORDER BY {_HITS} DESC, id LIMIT 25")
def symbol_search(spark, sf_dir):
    """Names and signatures as one text."""
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("content"))
    return ft.search_any(known, "wid prom", 25)


# -- symbols -----------------------------------------------------------------------------------------------------------
@query("H3_symbol_by_name", "SELECT * FROM (SELECT 'name' AS how, p_partkey AS id, p_name AS fqn FROM part WHERE p_name = (SELECT p_name FROM part WHERE p_partkey = 11) ORDER BY p_partkey LIMIT 1) a UNION ALL SELECT 'id', p_partkey, p_name FROM part WHERE p_partkey = 7")
def symbol_by_name(spark, sf_dir):
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("fqn"))
    name = known.where("id = 11").head()["fqn"]
    return graph.find_symbol(known, name).select(F.lit("name").alias("how"), "id", "fqn").unionByName(graph.find_symbol(known, id_=7).select(F.lit("id").alias("how"), "id", "fqn"))


_CALLS = "SELECT DISTINCT l_suppkey AS src, l_partkey % 100 + 1 AS dst FROM {lineitem}"


@query("H4_recursive_calls", f"WITH RECURSIVE e AS ({_CALLS.replace('{', '').replace('}', '')}), w(node, callee, depth) AS (SELECT src, dst, 1 FROM e UNION SELECT w.node, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.callee WHERE w.depth < 2) SELECT node, callee, depth FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, callee) AS r FROM w) t WHERE r <= 20")
def recursive_calls(spark, sf_dir):
    entries = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    return graph.call_flows(frame(spark, sf_dir, _CALLS.replace("DISTINCT ", "")), entries)


@query("H7_first_chunk", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role <> 'system') t WHERE r = 1")
def first_chunk(spark, sf_dir):
    return graph.first_chunk(table(spark, sf_dir, "conversations").where("role <> 'system'"), "conv_id", "turn", "text").select("conv_id", "turn", "role")


@query("H10_entrypoints", "SELECT id FROM (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'src/main.py' WHEN 1 THEN 'web/index.ts' WHEN 2 THEN 'server.go' ELSE 'lib/x.c' END AS path, p_name || CASE WHEN p_partkey % 5 = 0 THEN 'Main' ELSE '' END AS name FROM part) s WHERE contains(path, 'main.') OR contains(path, 'index.') OR contains(path, 'app.') OR contains(path, 'server.') OR contains(name, 'main') OR contains(name, 'Main')")
def entrypoints(spark, sf_dir):
    df = frame(spark, sf_dir, "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'src/main.py' WHEN 1 THEN 'web/index.ts' WHEN 2 THEN 'server.go' ELSE 'lib/x.c' END AS path, p_name || CASE WHEN p_partkey % 5 = 0 THEN 'Main' ELSE '' END AS name FROM {part}")
    return df.where(graph.is_entrypoint(F.col("path"), F.col("name"))).select("id")


@query("C9_prefix_join", "SELECT m.module, count(*) AS n FROM (SELECT DISTINCT regexp_extract(url, '^[^/]+//[^/]+', 0) AS module FROM pages) m JOIN pages p ON starts_with(p.url, m.module || '/') GROUP BY m.module")
def prefix_join(spark, sf_dir):
    """Modules and the files below them: every folder of a path is exploded, so that it is an equi-join."""
    p = table(spark, sf_dir, "pages").select("url").where("url IS NOT NULL")
    modules = p.select(F.regexp_extract("url", "^[^/]+//[^/]+", 0).alias("module")).distinct()
    return graph.below(p, modules, "url", "module").groupBy("module").agg(F.count("*").alias("n"))


# -- tags, validation, reports -----------------------------------------------------------------------------------------
@query("J1_starter_tags", "SELECT tag, origin FROM (SELECT DISTINCT CASE WHEN source = 'src1' THEN 'auth' ELSE source END AS tag, 'there' AS origin FROM documents) d UNION ALL SELECT tag, 'starter' FROM (VALUES " + ", ".join(f"('{x}')" for x in rules.STARTER_TAGS) + ") v(tag) WHERE tag <> 'auth' OR NOT EXISTS (SELECT 1 FROM documents WHERE source = 'src1')")
def starter_tags(spark, sf_dir):
    """Starter tags are added to those that a repository has."""
    there = sql(spark, sf_dir, "SELECT DISTINCT CASE WHEN source = 'src1' THEN 'auth' ELSE source END AS tag, 'there' AS origin FROM {documents}")
    seeds = spark.createDataFrame([(x, "starter") for x in rules.STARTER_TAGS], "tag string, origin string")
    return incremental.insert_new(there, seeds, ["tag"])


@query("J3_auto_tags", f"SELECT id, unnest(list_filter([CASE WHEN contains(path, '/node_modules/') THEN 'vendor' END, CASE WHEN contains(path, '/tests/') THEN 'test' END], lambda x: x IS NOT NULL)) AS tag FROM {_F} f")
def auto_tags(spark, sf_dir):
    return rules.auto_tags(_files(spark, sf_dir))


@query("J4_file_and_chunk_tags", "SELECT 'file' AS entity, doc_id AS id, 'manual' AS source, 1.0::DOUBLE AS confidence FROM documents WHERE source = 'src1' UNION ALL SELECT 'chunk', conv_id * 100 + turn, 'manual', 1.0::DOUBLE FROM conversations JOIN documents ON doc_id = conv_id WHERE source = 'src1' UNION ALL SELECT 'file', doc_id, 'rule', 0.5::DOUBLE FROM documents WHERE source <> 'src1' AND doc_id % 10 = 0")
def file_and_chunk_tags(spark, sf_dir):
    """Some files have the tag by a rule; those of a source get it by hand, with their chunks."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    chunks = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("file_id"))
    there = rules.tag_entities(spark.createDataFrame([], "entity string, id long, tag string, source string, confidence double"), docs.where("id % 10 = 0"), "x", "file", "rule", 0.5)
    return rules.tag_files_with_chunks(there, docs.where("source = 'src1'").select("id"), chunks, "x").drop("tag")


@query("J4_entity_tags", "SELECT tag, source, confidence FROM (VALUES ('src' , 'rule', 0.5::DOUBLE), ('long', 'manual', 1.0::DOUBLE)) v(tag, source, confidence) WHERE tag = 'src' OR (SELECT max(n_chars) FROM documents WHERE doc_id = 10) > 100")
def entity_tags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    there = rules.tag_entities(spark.createDataFrame([], "entity string, id long, tag string, source string, confidence double"), docs.where("id % 10 = 0"), "src", "file", "rule", 0.5)
    return rules.entity_tags(rules.tag_entities(there, docs.where("n_chars > 100"), "long", "file"), "file", 10)


@query("J6_list_features", "SELECT DISTINCT source AS name FROM documents WHERE source LIKE 'src1%' ORDER BY name LIMIT 20")
def list_features(spark, sf_dir):
    return rules.list_features(table(spark, sf_dir, "documents").select(F.col("source").alias("name")), "SRC1")


@query("J8_directory_notes", f"SELECT folder, count(*) AS n, list(DISTINCT lang ORDER BY lang) AS languages FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, lang FROM {_F} f) t GROUP BY folder ORDER BY n DESC, folder LIMIT 3")
def directory_notes(spark, sf_dir):
    return reports.directory_notes(_files(spark, sf_dir), language="lang")


_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, CAST(length(w) + 2 AS BIGINT)), lambda i: substring('  ' || w || ' ', i, 3)))))"
_ASKED = "SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN 'db.' || s_name || '()' WHEN 1 THEN s_name || 'x' ELSE 'zq' || (s_suppkey % 5) END AS ref, CASE WHEN s_suppkey % 2 = 0 THEN 0.9 ELSE 0.7 END AS confidence FROM {supplier}"


@query("J16_symbol_validation", f"""WITH r AS (SELECT ref, confidence, regexp_extract(string_split(ref, '(')[1], '([^.]*)$', 1) AS asked FROM {duck(_ASKED)} a), k AS (SELECT DISTINCT s_name AS name, {_TRI.format('s_name')} AS y FROM supplier),
c AS (SELECT asked, name, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS sim FROM (SELECT DISTINCT asked, {_TRI.format('asked')} AS x FROM r WHERE asked NOT IN (SELECT name FROM k)) q, k),
b AS (SELECT asked, name, sim FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY sim DESC, name) AS i FROM c WHERE sim >= 0.3) t WHERE i = 1)
SELECT ref, CASE WHEN k.name IS NOT NULL THEN 'valid' WHEN sim > 0.7 THEN 'STALE_API' ELSE 'MISSING_SYMBOL' END AS status, CASE WHEN k.name IS NOT NULL THEN NULL WHEN sim > 0.7 THEN 'info' WHEN confidence > 0.8 THEN 'error' ELSE 'warning' END AS severity, coalesce(k.name, b.name) AS match
FROM r LEFT JOIN k ON k.name = r.asked LEFT JOIN b ON b.asked = r.asked""")
def symbol_validation(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    return rules.validate_symbols(frame(spark, sf_dir, _ASKED).withColumn("confidence", F.col("confidence").cast("double")), known)


_IMPORTS = "SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'pkg.m' || (p_partkey % 40) WHEN 1 THEN 'part' || p_partkey WHEN 2 THEN 'os.path' ELSE 'gone' || (p_partkey % 9) || '.x' END AS ref FROM {part}"
_MODULES = "SELECT DISTINCT 'pkg/m' || (p_partkey % 20) || CASE p_partkey % 2 WHEN 0 THEN '.py' ELSE '/__init__.py' END AS path FROM {part}"
_KNOWN = "SELECT DISTINCT 'part' || (p_partkey - p_partkey % 8 + 1) AS name FROM {part}"


@query("J17_import_validation", f"SELECT ref, CASE WHEN EXISTS (SELECT 1 FROM {duck(_MODULES)} m WHERE path IN (replace(ref, '.', '/') || '.py', replace(ref, '.', '/') || '/__init__.py', replace(ref, '.', '/'))) OR ref IN (SELECT name FROM {duck(_KNOWN)} k) THEN 'valid' WHEN EXISTS (SELECT 1 FROM {_S} s WHERE list_contains(regexp_extract_all(regexp_extract(lower(content), 'import(.*)', 1, 's'), '[a-z0-9_]+'), lower(string_split(ref, '.')[1]))) THEN 'external' ELSE 'INVALID_IMPORT' END AS status FROM {duck(_IMPORTS)} i")
def import_validation(spark, sf_dir):
    return rules.validate_imports(frame(spark, sf_dir, _IMPORTS), frame(spark, sf_dir, _MODULES), frame(spark, sf_dir, _KNOWN), _sources(spark, sf_dir).select("content"))


_SEVERITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'unknown' END"


@query("J19_drift_list", f"SELECT o_orderkey AS id, {_SEVERITY} AS severity, c_name AS claim, n_name AS title FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (1, 2, 3) ORDER BY CASE {_SEVERITY} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, o_orderkey LIMIT 30")
def drift_list(spark, sf_dir):
    """Orders stand for issues, customers for verifications with their claims, nations for documents; three are reviewed."""
    issues = sql(spark, sf_dir, f"SELECT o_orderkey AS id, o_custkey AS verification_id, {_SEVERITY} AS severity, CASE o_orderstatus WHEN 'P' THEN 'open' ELSE 'closed' END AS status FROM {{orders}}")
    checked = sql(spark, sf_dir, "SELECT c_custkey AS id, c_custkey AS claim_id FROM {customer}")
    claims = sql(spark, sf_dir, "SELECT c_custkey AS id, c_nationkey AS document_id, c_name AS claim FROM {customer}")
    docs = sql(spark, sf_dir, "SELECT n_nationkey AS id, n_name AS title FROM {nation}")
    return reports.drift_list(reports.review(issues, [1, 2, 3], "resolved", "me").drop("reviewed_by"), checked, claims, docs, most=30)


@query("J22_schema_stats", f"SELECT 't' || id AS \"table\", 3 AS n_columns, 2 AS n_types, 1 AS n_nullable FROM {_SQL} s")
def schema_stats(spark, sf_dir):
    columns = ddl_columns(spark, sf_dir).where("kind = 'table'").select(F.col("name").alias("table"), F.col("item").alias("column"), "type", "nullable")
    return reports.schema_stats(columns)


@query("J22_table_context", "SELECT 'id' AS \"column\", 0 AS position, 'BIGINT' AS type, 0 AS n_used UNION ALL SELECT 'name', 1, 'TEXT', (SELECT count(*) FROM part WHERE p_partkey % 2 = 0) UNION ALL SELECT 'ref', 2, 'BIGINT', (SELECT count(*) FROM part WHERE p_partkey % 2 = 1)")
def table_context(spark, sf_dir):
    parse = lambda x: [(c["name"], i, c["type"], d[1]) for _, s, *_ in code.statements_of(x) if (d := code.parse_ddl(s)) and d[0] == "table" for i, c in enumerate(d[2])]
    columns = code.explode_with(_scripts(spark, sf_dir), parse, "column string, position long, type string, table string")
    usage = sql(spark, sf_dir, "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'name' ELSE 'ref' END AS column FROM {part}")
    return reports.table_context(columns, usage, "t3")


_FEATURES = "SELECT doc_id AS id, w AS name, CASE WHEN length(w) % 3 = 0 THEN 'oracle' WHEN length(w) % 3 = 1 THEN 'epas' ELSE 'other' END AS category, CASE WHEN length(w) > 5 THEN 'package' ELSE 'function' END AS type, CAST(count(*) AS BIGINT) AS mentions FROM ({0}) d WHERE length(w) > 3 GROUP BY doc_id, w"
_KINDS = "SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'migration_issues' WHEN 1 THEN 'general' WHEN 2 THEN 'migration_toolkit' ELSE 'other' END AS kind FROM {documents}"


@query("J24_simple_summary", f"""WITH f AS ({_FEATURES.format("SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM documents")}), g AS (SELECT id, list(name ORDER BY mentions DESC, name)[1:10] AS topics, count(*) FILTER (category = 'oracle') AS o, count(*) FILTER (category = 'epas') AS e, list(DISTINCT type ORDER BY type)[1:3] AS types FROM f GROUP BY id),
s AS (SELECT conv_id AS id, count(*) AS sections FROM conversations GROUP BY conv_id), j AS (SELECT d.id, kind, coalesce(topics, []) AS topics, coalesce(o, 0) AS o, coalesce(e, 0) AS e, coalesce(types, []) AS types, coalesce(sections, 0) AS n FROM {duck(_KINDS)} d LEFT JOIN g ON g.id = d.id LEFT JOIN s ON s.id = d.id)
SELECT id, topics, CASE WHEN contains(kind, 'migration') OR len(list_filter(topics, lambda x: contains(x, 'migration'))) > 0 THEN 'developers' WHEN e > o THEN 'dbas' ELSE 'developers' END AS audience, CASE kind WHEN 'migration_issues' THEN 'troubleshooting' WHEN 'migration_toolkit' THEN 'migration-guide' ELSE 'reference' END AS purpose,
'Documentation covering ' || CASE WHEN len(types) > 0 THEN array_to_string(types, ', ') ELSE 'content' END || CASE WHEN o > 0 THEN ' with ' || o || ' Oracle-specific constructs' ELSE '' END || CASE WHEN e > 0 THEN CASE WHEN o > 0 THEN ' and ' ELSE ' with ' END || e || ' EPAS features' ELSE '' END || ' across ' || n || ' content sections.' AS summary FROM j""")
def simple_summary(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), 0)).alias("w"))
    features = spark.sql(_FEATURES.format("{words}").replace("({words})", "{words}"), words=words)
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"))
    return reports.simple_summary(frame(spark, sf_dir, _KINDS), features, chunks)


_TOOLS = (rules.Tool("hybrid_search", ("find code", "search for", "where is", "locate", "show me")), rules.Tool("doc_search", ("documentation", "readme", "how to", "setup", "guide", "instructions")), rules.Tool("migration_assess", ("migration", "upgrade", "port to", "convert to")))
_ASK = "CASE c_custkey % 6 WHEN 0 THEN 'Where is the setup guide' WHEN 1 THEN 'Search for ' || c_name WHEN 2 THEN 'how to upgrade and convert to ' || c_name WHEN 3 THEN 'documentation: show me ' || c_name WHEN 4 THEN 'what is ' || c_name ELSE 'readme' END"


@query("J26_suggest_tool", f"SELECT query, tool, score, CASE WHEN score >= 20 THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT query, unnest([" + ", ".join(f"{{'tool': '{x.name}', 'score': 10 * ({' + '.join(f'CAST(contains(lower(query), $${k}$$) AS INT)' for k in x.keywords)})}}" for x in _TOOLS) + f"], recursive := true) FROM (SELECT DISTINCT {_ASK} AS query FROM customer) c) s WHERE score > 0")
def suggest_tool(spark, sf_dir):
    return rules.suggest_tools(sql(spark, sf_dir, f"SELECT DISTINCT {_ASK} AS query FROM {{customer}}"), _TOOLS)


@query("J20_claim_evidence", f"""WITH f AS (SELECT id, path, content, {_BASE.replace('doc_id', 'id')} AS score FROM {_F} f WHERE id % 3 = 0), r AS (SELECT *, CASE WHEN contains(path, '/tests/') THEN 10 WHEN contains(path, '/services/') THEN 0 ELSE 3 END AS priority FROM f),
s AS (SELECT id, priority, sum(length(content)) OVER (ORDER BY priority, score DESC, id) AS spent FROM r) SELECT id, priority, spent FROM s WHERE spent <= 60000""")
def claim_evidence(spark, sf_dir):
    """Evidence for a claim: found files by the place that their path has, whole texts within a budget of characters. One
    claim may have any number of files, so they are packed by blocks."""
    found = _files(spark, sf_dir).where("id % 3 = 0").select("id", (F.col("id") % 10 / 10).alias("score"), ranking.evidence_priority(F.col("path")).alias("priority"), F.length("content").alias("n"))
    return graph.pack_within_blocks(found, 60_000, F.col("n"), [], ["priority", F.desc("score"), "id"]).select("id", "priority", "spent")


@query("J28_summaries", "SELECT 'document' AS level, CAST(doc_id AS VARCHAR) AS entity, substring(string_split(text, '.')[1], 1, 200) AS summary FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'module', source, count(*) || ' files: ' || array_to_string(list(DISTINCT lang ORDER BY lang), ', ') FROM documents GROUP BY source UNION ALL SELECT 'symbol', CAST(p_partkey AS VARCHAR), p_name || ': ' || p_type FROM part WHERE p_partkey % 4 > 0")
def summaries(spark, sf_dir):
    """Documents, modules and symbols without a summary get one by an injected function; here, by their own words."""
    docs = table(spark, sf_dir, "documents")
    todo = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    of_docs = todo.select(F.lit("document").alias("level"), F.col("doc_id").cast("string").alias("entity"), reports.first_sentence(F.col("text")).alias("summary"))
    modules = docs.groupBy("source").agg(F.concat(F.count("*").cast("string"), F.lit(" files: "), F.array_join(F.array_sort(F.collect_set("lang")), ", ")).alias("summary"))
    symbols_ = table(spark, sf_dir, "part").where("p_partkey % 4 > 0").select(F.lit("symbol").alias("level"), F.col("p_partkey").cast("string").alias("entity"), F.concat("p_name", F.lit(": "), "p_type").alias("summary"))
    return of_docs.unionByName(modules.select(F.lit("module").alias("level"), F.col("source").alias("entity"), "summary")).unionByName(symbols_)


_CLAIMS = "SELECT doc_id AS id, 'About it. The limit is ' || (doc_id % 40) || ' items' || CASE WHEN doc_id % 6 = 0 THEN '.' ELSE ' each.' END || ' Nothing else' AS content FROM {documents} WHERE doc_id % 7 <> 3"
_CODE = "SELECT doc_id AS id, 'if (n > ' || (doc_id % 40 + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) || ')' || CASE WHEN doc_id % 2 = 0 THEN ' throw new Error' ELSE '' END AS code FROM {documents} WHERE doc_id % 11 > 0"


@query("J20_claims", f"SELECT id, 'The limit is ' || (id % 40) || ' items' || CASE WHEN id % 6 = 0 THEN '' ELSE ' each' END AS claim, CASE WHEN id % 11 = 0 THEN 'no_code_found' WHEN id % 5 = 0 THEN 'mismatch' ELSE 'match' END AS verdict, CASE WHEN id % 11 = 0 OR id % 5 > 0 THEN NULL WHEN id % 2 = 0 THEN 'high' ELSE 'medium' END AS severity FROM {duck(_CLAIMS)} c")
def claims_and_verdicts(spark, sf_dir):
    """Claims about limits, held against code, by the offline stand-ins for a model."""
    found = claims.claims_of(frame(spark, sf_dir, _CLAIMS), claims.limits_of)
    judged = claims.verify(found, frame(spark, sf_dir, _CODE), claims.compare_numbers)
    issues = claims.drift_issues(judged).select("id", "severity")
    return judged.select("id", "claim", "verdict").join(issues, "id", "left")


@query("I19_json_repair", "SELECT doc_id AS id, doc_id % 4 AS n FROM documents WHERE doc_id % 5 < 4")
def json_repair(spark, sf_dir):
    """Replies around JSON: bare, fenced, within other words, an object, and none at all."""
    array = "'[' || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '1, 2' ELSE '1, 2, 3' END || ']'"
    text = f"SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN {array} WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || {array} || chr(10) || '```' WHEN 2 THEN 'It is ' || {array} || ', so.' WHEN 3 THEN ' ' || {array} || ' ' ELSE 'no [json' END AS content FROM {{documents}}"
    return code.explode_with(frame(spark, sf_dir, text), lambda x: [(len(v),)] if (v := claims.parse_json(x)) is not None else [], "n long")


_NOW = f"SELECT id, CASE WHEN id % 3 = 0 THEN 'go' ELSE language END AS language, CASE WHEN id % 3 = 0 THEN 'func renamed' || id || '()' || chr(10) ELSE content END AS content FROM ({SOURCES}) s WHERE id % 5 > 0"


@query("K11_reindex", f"SELECT id, 'renamed' || id AS fqn FROM {_S} s WHERE id % 5 > 0 AND id % 3 = 0 UNION ALL SELECT id, unnest(CASE language WHEN 'python' THEN ['C' || id, 'C' || id || '.run', 'helper' || id] ELSE ['add' || id, 'Put' || id] END) FROM {_S} s WHERE id % 5 > 0 AND id % 3 > 0")
def reindex(spark, sf_dir):
    """Symbols after a third of the files changed and a fifth went; only what changed is parsed again."""
    symbols_of = lambda df: code.explode_with(df, lambda x, lang: [(s[0],) for s in code.symbols_of(x, lang)], "fqn string", inputs=("content", "language"))
    old, new = _sources(spark, sf_dir), frame(spark, sf_dir, _NOW)
    digest = lambda df: df.select("id", t.content_hash(F.col("content")).alias("h"))
    changed = incremental.changes(digest(old), digest(new))
    todo = new.join(changed.where("op <> 'delete'").select("id"), "id", "left_semi")
    return incremental.reindex(symbols_of(old), changed, symbols_of(todo))


# -- change feed -------------------------------------------------------------------------------------------------------
_EVENTS = "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN event_id % 9 = 0 THEN '.git/' WHEN event_id % 11 = 0 THEN 'node_modules/' ELSE 'src/' END || 'u' || user_id || CASE WHEN event_id % 5 = 0 THEN '.bin' ELSE '.py' END AS path, 'src/v' || user_id || '.py' AS target, CASE event_id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'modify' WHEN 2 THEN 'delete' ELSE 'move' END AS op FROM {events}"


@query("K1_file_events", f"SELECT path, op, count(*) AS n FROM (SELECT path, CASE WHEN op IN ('delete', 'move') THEN 'DELETE' ELSE 'UPSERT' END AS op FROM {duck(_EVENTS)} e UNION ALL SELECT target, 'UPSERT' FROM {duck(_EVENTS)} e WHERE op = 'move') x WHERE path LIKE '%.py' AND NOT regexp_matches(path, '^([.]git|node_modules)/') GROUP BY path, op")
def file_events(spark, sf_dir):
    return queue.relevant(queue.expand_moves(frame(spark, sf_dir, _EVENTS))).groupBy("path", "op").agg(F.count("*").alias("n"))


@query("K8_regenerate", "SELECT source, count(*) FILTER (WHERE doc_id % 13 = 0) AS changed, count(*) AS total, CASE WHEN count(*) FILTER (WHERE doc_id % 13 = 0) / count(*) > 0.05 THEN 'REGENERATE_SUMMARY' ELSE 'skip' END AS action FROM documents GROUP BY source")
def regenerate(spark, sf_dir):
    return incremental.regenerate(table(spark, sf_dir, "documents"), F.col("doc_id") % 13 == 0, "source")


@query("K14_heartbeat", "SELECT user_id, max(ts) < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL '2' MINUTE AS dead FROM events GROUP BY user_id")
def heartbeat(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("seen"))
    return last.select("user_id", listings.dead(F.col("seen"), F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"), "2 MINUTES").alias("dead"))
