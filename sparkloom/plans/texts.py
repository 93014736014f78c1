"""Text transforms, chunking, references, dialects and metrics (groups A4 to A10 and I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as t
from sparkloom.operators.fulltext import lexemes
from sparkloom.registry import query, shared
from sparkloom.session import spread, table


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def _values(spark, rows: list[tuple], schema: str):
    return spark.createDataFrame(rows, schema)


#: Markdown made of a document's words, the same in both engines.
_MD_DUCK = "'# ' || w[1] || chr(10) || '- **' || w[2] || '** see [' || w[3] || '](docs/' || w[4] || '.md) and `' || w[5] || '()`' || chr(10) || '## ' || w[6] || chr(10) || '`' || w[7] || '.' || w[8] || '`'"
_MD_FROM = f"(SELECT id, {_MD_DUCK} AS md FROM (SELECT doc_id AS id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents) x WHERE len(w) >= 8)"


def _markdown(spark, sf_dir):
    w = _docs(spark, sf_dir).select("id", F.regexp_extract_all("content", F.lit("[A-Za-z]+"), 0).alias("w")).where(F.size("w") >= 8)
    p = [F.col("w")[i] for i in range(8)]
    md = F.concat(F.lit("# "), p[0], F.lit("\n- **"), p[1], F.lit("** see ["), p[2], F.lit("](docs/"), p[3], F.lit(".md) and `"), p[4], F.lit("()`\n## "), p[5], F.lit("\n`"), p[6], F.lit("."), p[7], F.lit("`"))
    return w.select("id", md.alias("content"))


@query("A4_parse_markdown", f"SELECT id, regexp_extract(md, '^# (.+?)' || chr(10), 1) AS title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '(?m)^#{{1,6}}\\s+', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '`([^`]*)`', '\\1', 'g'), '\\*\\*(.*?)\\*\\*', '\\1', 'g'), '(?m)^\\s*[-*+]\\s+', '', 'g')) AS plain FROM {_MD_FROM} m")
def parse_markdown(spark, sf_dir):
    return _markdown(spark, sf_dir).select("id", F.regexp_extract("content", r"^# (.+?)\n", 1).alias("title"), t.plain_of_markdown(F.col("content")).alias("plain"))


@query("I18_headings", f"SELECT id, regexp_extract_all(md, '(?m)^#{{1,6}}\\s+(.+)$', 1) AS headings FROM {_MD_FROM} m")
def headings(spark, sf_dir):
    return _markdown(spark, sf_dir).select("id", t.headings(F.col("content")).alias("headings"))


@query("I15_references", f"SELECT DISTINCT id, kind, ref FROM (SELECT id, 'code' AS kind, unnest(regexp_extract_all(md, '`([^`\\n]{{1,120}})`', 1)) AS ref FROM {_MD_FROM} m UNION ALL SELECT id, 'link' AS kind, unnest(regexp_extract_all(md, '\\]\\(([^)\\s]+)\\)', 1)) AS ref FROM {_MD_FROM} m UNION ALL SELECT id, 'path' AS kind, unnest(regexp_extract_all(md, '(?:^|[\\s(])((?:[\\w.-]+/)+[\\w.-]+\\.\\w+)', 1)) AS ref FROM {_MD_FROM} m) u")
def references(spark, sf_dir):
    return t.references(_markdown(spark, sf_dir))


@query("I1_sliding_chunks", "SELECT doc_id AS id, i AS chunk, i * 1500 AS start, substring(text, i * 1500 + 1, 2000) AS content, len(substring(text, 1, i * 1500)) - len(replace(substring(text, 1, i * 1500), chr(10), '')) + 1 AS start_line FROM documents, LATERAL (SELECT unnest(range(CAST(greatest(1, ceil((length(text) - 500) / 1500.0)) AS BIGINT))) AS i) r")
def sliding_chunks(spark, sf_dir):
    return t.sliding_windows(_docs(spark, sf_dir), 2000, 500).drop("end_line")


@query("I2_line_chunks", "SELECT doc_id AS id, i AS chunk, i * 10 + 1 AS start_line, least(i * 10 + 10, len(l)) AS end_line, array_to_string(list_slice(l, i * 10 + 1, i * 10 + 10), chr(10)) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d, LATERAL (SELECT unnest(range(CAST(ceil(len(l) / 10.0) AS BIGINT))) AS i) r")
def line_chunks(spark, sf_dir):
    return t.line_chunks(_docs(spark, sf_dir), 10)


@query("I9_normalize_whitespace", r"SELECT doc_id AS id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || chr(9) || ' x' || chr(10) || chr(10) || chr(10) || 'y ', '[^\S\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents")
def normalize_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", F.md5(t.normalize_whitespace(F.concat("content", F.lit("\t x\n\n\ny ")))).alias("h"))


_TOPICS = {"articles": ("the ", "der ", "les "), "endings": ("tion", "heit", "ción"), "legal": ("license", "copyright")}


@query("I10_dictionary_tags", "SELECT doc_id AS id, list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{k}' END" for k, ws in sorted(_TOPICS.items())) + "], lambda x: x IS NOT NULL) AS topics FROM documents")
def dictionary_tags(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", t.dictionary_tags(F.col("content"), _TOPICS).alias("topics"))


@query("I12_content_hash", "SELECT doc_id AS id, substring(sha256(text), 1, 16) AS h FROM documents")
def content_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", t.content_hash(F.col("content")).alias("h"))


_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, CAST(length(w) + 2 AS BIGINT)), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query("I13_trigram_similarity", f"SELECT p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS sim FROM (SELECT p_partkey, {_TRI.format('p_name')} AS x, {_TRI.format('p_type')} AS y FROM part) s")
def trigram_similarity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(t.similarity(F.col("p_name"), F.col("p_type")), 6).alias("sim"))


@query("I17_pattern_scan", "SELECT id, line, match FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS r FROM (SELECT doc_id AS id, i AS line, regexp_extract(l[i], '[Tt]ion[a-z]*', 0) AS match FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) r WHERE regexp_matches(l[i], '[Tt]ion[a-z]*')) h) t WHERE r <= 3 ORDER BY id, line LIMIT 200")
def pattern_scan(spark, sf_dir):
    return t.pattern_scan(_docs(spark, sf_dir), "[Tt]ion[a-z]*", per_file=3).select("id", "line", "match")


shared(
    "I19_json_fields",
    "SELECT event_id, length(props) AS n, get_json_object(props, '$.k') IS NULL AS without FROM {events}",
    "SELECT event_id, length(props) AS n, json_extract(props, '$.k') IS NULL AS without FROM events",
)


@query("I20_step_decay", "SELECT o_orderkey, CASE WHEN d <= 0 THEN 1.0 WHEN d <= 7 THEN 0.9 WHEN d <= 30 THEN 0.7 WHEN d <= 90 THEN 0.4 WHEN d <= 180 THEN 0.2 ELSE 0.1 END AS freshness FROM (SELECT o_orderkey, epoch(TIMESTAMP '1996-06-01' - o_orderdate) / 86400.0 AS d FROM orders) t")
def step_decay(spark, sf_dir):
    days = (F.lit(833587200) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))) / 86400
    return table(spark, sf_dir, "orders").select("o_orderkey", t.step_decay(days).alias("freshness"))


@query("I23_filename_tag", "SELECT page_id, CASE WHEN p LIKE '%test%' THEN 'testing' WHEN p LIKE '%auth%' OR p LIKE '%login%' THEN 'auth' WHEN p LIKE '%db%' OR p LIKE '%model%' OR p LIKE '%.sql%' THEN 'database' WHEN p LIKE '%api%' OR p LIKE '%route%' THEN 'api' WHEN p LIKE '%config%' OR p LIKE '%setting%' THEN 'config' END AS tag FROM (SELECT page_id, lower(CASE page_id % 4 WHEN 0 THEN 'x/test_' WHEN 1 THEN 'API/' WHEN 2 THEN 'models/' ELSE 'z/' END || page_id) AS p FROM pages) t")
def filename_tag(spark, sf_dir):
    id_ = F.col("page_id")
    path = F.concat(F.when(id_ % 4 == 0, "x/test_").when(id_ % 4 == 1, "API/").when(id_ % 4 == 2, "models/").otherwise("z/"), id_.cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", t.filename_tag(path).alias("tag"))


_BODY = "BEGIN\n IF a AND b THEN\n  x := 1;\n ELSIF c OR d THEN\n  FOR i IN 1..2 LOOP\n   CASE z WHEN 1 THEN y := 2; END CASE;\n  END LOOP;\n END IF;\n EXECUTE format('SELECT %s', n);\nEXCEPTION WHEN others THEN SET ROLE admin;\nEND"


@query("I25_routine_metrics", "SELECT 'f' AS name, 11 AS loc, 13 AS complexity, true AS dynamic_sql, true AS role_change")
def routine_metrics(spark, sf_dir):
    m = t.routine_metrics(F.col("body"))
    return _values(spark, [("f", _BODY)], "name string, body string").select("name", *(c.alias(k) for k, c in m.items()))


_CALLS = (("select", "the"), ("insert", "with"), ("connect", "der"))


@query("I30_db_calls", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id AS id, '{k}' AS kind, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x = '{w}')) AS n FROM documents" for k, w in _CALLS) + ") u WHERE n > 0")
def db_calls(spark, sf_dir):
    #: one pass over the texts, a count for each pattern
    tokens = _docs(spark, sf_dir).select("id", lexemes(F.col("content")).alias("w"))
    each = tokens.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.size(F.filter("w", _is(w))).alias("n")) for k, w in _CALLS))).alias("c"))
    return each.select("id", "c.kind", "c.n").where("n > 0")


def _is(word: str):
    return lambda x: x == word


@query("I5_sql_stats", "SELECT kind, count(*) AS n FROM (VALUES ('schema'), ('schema'), ('data'), ('data'), ('data'), ('other')) v(kind) GROUP BY kind")
def sql_stats(spark, sf_dir):
    script = "CREATE TABLE a (x INT); ALTER TABLE a ADD y INT; INSERT INTO a VALUES (1); UPDATE a SET x = 2; DELETE FROM a; VACUUM"
    s = _values(spark, [(script,)], "body string").select(F.explode(F.split("body", r";\s*")).alias("s"))
    kind = F.when(F.col("s").rlike("(?i)^(create|alter|drop)"), "schema").when(F.col("s").rlike("(?i)^(insert|update|delete|copy)"), "data").otherwise("other")
    return s.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("A10_plain_headings", "SELECT * FROM (VALUES (1, 'underlined'), (2, 'text'), (3, 'capitals'), (4, 'numbered'), (5, 'text')) v(line, kind)")
def plain_headings(spark, sf_dir):
    lines = ["Title", "=====", "OVERVIEW OF PARTS", "1.2 Setup", "Plain words here."]
    rows = _values(spark, [(i + 1, x, lines[i + 1] if i + 1 < len(lines) else "") for i, x in enumerate(lines)], "line int, s string, next string")
    return rows.select("line", t.line_kind(F.col("s"), F.col("next")).alias("kind"))


_FIRST = "SELECT doc_id AS id, substring(sha256(text), 1, 16) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"
_NOW = "SELECT doc_id AS id, substring(sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END), 1, 16) AS h FROM documents"


@query("A5_ingest_changes", f"SELECT n.id, CASE WHEN f.id IS NULL THEN 'insert' ELSE 'update' END AS op FROM ({_NOW}) n LEFT JOIN ({_FIRST}) f ON f.id = n.id WHERE f.id IS NULL OR f.h <> n.h")
def ingest_changes(spark, sf_dir):
    from sparkloom.operators.incremental import changes

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("text").alias("content"))
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    old = docs.join(known, "id", "left_semi").select("id", t.content_hash(F.col("content")).alias("h"))
    new = docs.select("id", t.content_hash(F.when(F.col("lang") == "de", F.concat("content", F.lit("!"))).otherwise(F.col("content"))).alias("h"))
    return changes(old, new).where("op <> 'delete'")
