"""Rule, scoring and reporting pipelines (group J), and incremental maintenance as tables (group K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import fulltext as ft
from sparkloom.operators import fusion, incremental, rules
from sparkloom.plans.retrieval import _hybrid_oracle, _lists, _tags
from sparkloom.registry import query, sql
from sparkloom.session import spread, table


_RULES = (
    rules.TagRule("source one", "PATH", "src1/", 0.9), rules.TagRule("syllables", "REGEX", "(^|[^a-z])(tion|heit)", 0.8), rules.TagRule("syllables", "PATH", "src2/", 0.5),
    rules.TagRule("imports", "IMPORT", "tion", 0.9), rules.TagRule("english", "SYMBOL", "^en_[0-9]*7$", 0.6),
)


def _entities(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), F.concat_ws("_", "lang", F.col("doc_id").cast("string")).alias("symbol"))


_ENT = "(SELECT doc_id AS id, source || '/' || lang || '/' || doc_id AS path, text AS content, lang || '_' || doc_id AS symbol FROM documents)"


@query("J2_apply_tag_rules", f"""WITH e AS {_ENT}, h AS (
SELECT id, 0 AS at_, 'source one' AS tag, 0.9 AS c FROM e WHERE contains(path, 'src1/') UNION ALL SELECT id, 1, 'syllables', 0.8 FROM e WHERE regexp_matches(content, '(?i)(^|[^a-z])(tion|heit)') UNION ALL SELECT id, 2, 'syllables', 0.5 FROM e WHERE contains(path, 'src2/')
UNION ALL SELECT id, 3, 'imports', 0.9 FROM e WHERE content ILIKE '%import%tion%' OR content ILIKE '%from%tion%' UNION ALL SELECT id, 4, 'english', 0.6 FROM e WHERE regexp_matches(symbol, '^en_[0-9]*7$'))
SELECT id, tag, CAST(arg_min(c, at_) AS DOUBLE) AS confidence FROM h GROUP BY id, tag""")
def apply_tag_rules(spark, sf_dir):
    return rules.apply_tag_rules(_entities(spark, sf_dir), _RULES)


@query("J5_feature_index", """WITH u AS (SELECT lower(lang) AS name, lang || ' documents' AS description, 'tag' AS origin FROM documents GROUP BY lang UNION ALL SELECT lower(source), 'module ' || source || ' in ' || count(*) || ' files', 'module' FROM documents GROUP BY source UNION ALL SELECT lower(role), role || ' turns', 'heading' FROM conversations GROUP BY role)
SELECT name, arg_max(description, (length(description), description)) AS description, list(DISTINCT origin ORDER BY origin) AS evidence FROM u GROUP BY name""")
def feature_index(spark, sf_dir):
    tags = sql(spark, sf_dir, "SELECT lower(lang) AS name, lang || ' documents' AS description, 'tag' AS origin FROM {documents} GROUP BY lang")
    modules = sql(spark, sf_dir, "SELECT lower(source) AS name, 'module ' || source || ' in ' || count(*) || ' files' AS description, 'module' AS origin FROM {documents} GROUP BY source")
    heads = sql(spark, sf_dir, "SELECT lower(role) AS name, role || ' turns' AS description, 'heading' AS origin FROM {conversations} GROUP BY role")
    all_ = tags.unionByName(modules).unionByName(heads)
    return all_.groupBy("name").agg(F.max_by("description", F.struct(F.length("description"), "description")).alias("description"), F.array_sort(F.collect_set("origin")).alias("evidence"))


@query("J7_feature_context", f"SELECT d.source, round(avg(h.score), 6) AS score, list(h.id ORDER BY h.score DESC, h.id)[1:5] AS top, count(*) AS n FROM ({_hybrid_oracle('true', (0.55, 0.35, 0.10), 36)}) h JOIN documents d ON d.doc_id = h.id GROUP BY d.source")
def feature_context(spark, sf_dir):
    v, f = _lists(spark, sf_dir)
    best = fusion.hybrid(v, f, 36, tags=_tags(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, 5), lambda x: x["id"])
    return docs.join(F.broadcast(best), "id").groupBy("source").agg(F.round(F.avg("score"), 6).alias("score"), top.alias("top"), F.count("*").alias("n"))


@query("J9_review_sections", "SELECT 'languages' AS section, count(DISTINCT lang) AS value FROM documents UNION ALL SELECT 'files', count(*) FROM documents UNION ALL SELECT 'modules', count(DISTINCT source) FROM documents UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'largest', max(length(text)) FROM documents")
def review_sections(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT stack(4, 'languages', count(DISTINCT lang), 'files', count(*), 'modules', count(DISTINCT source), 'largest', CAST(max(length(text)) AS BIGINT)) AS (section, value) FROM {documents} UNION ALL SELECT 'unlabelled', count(*) FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id")


#: Points of the marks of a database, by kind; a score of 50 is certain.
_DB = (("oracle", "driver", 10, "(^|[^a-z])con"), ("oracle", "dialect", 8, "ing the"), ("oracle", "config", 5, "ver[a-z]*, "), ("mongodb", "driver", 10, "tion"), ("mongodb", "dialect", 8, "der die"))


@query("J10_detect_database", "WITH m AS (" + " UNION ALL ".join(f"SELECT source, '{d}' AS db, {p} AS points FROM documents WHERE regexp_matches(text, '(?i){x}') GROUP BY source" for d, _, p, x in _DB) + ") SELECT source, db, sum(points) AS score, least(1.0, sum(points) / 50.0) AS confidence FROM m GROUP BY source, db")
def detect_database(spark, sf_dir):
    hit = F.array_compact(F.array(*(F.when(F.col("text").rlike("(?i)" + x), F.struct(F.lit(d).alias("db"), F.lit(k).alias("kind"), F.lit(p).alias("points"))) for d, k, p, x in _DB)))
    marks = spread(table(spark, sf_dir, "documents")).select("source", F.explode(hit).alias("m")).select("source", "m.*").distinct()
    return marks.groupBy("source", "db").agg(F.sum("points").alias("score")).withColumn("confidence", F.least(F.lit(1.0), F.col("score") / 50))


_RULE_UNION = " UNION ALL ".join(f"SELECT source AS repo, doc_id AS id, '{r.id}' AS rule, '{r.category}' AS category, '{r.severity}' AS severity FROM documents WHERE regexp_matches(text, '(?i){r.pattern}')" for r in rules.MIGRATION_RULES)
_FOUND = f"SELECT repo, rule, category, severity, count(*) AS n, list(id ORDER BY id) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY repo, rule ORDER BY id) AS r FROM ({_RULE_UNION}) u) t WHERE r <= 20 GROUP BY repo, rule, category, severity"
_SEV = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.SEVERITY.items()) + " ELSE 0 END"
_CAT = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.CATEGORY.items()) + " ELSE 1 END"


def _found(spark, sf_dir):
    return rules.findings(spread(table(spark, sf_dir, "documents")).select(F.col("source").alias("repo"), F.col("doc_id").alias("id"), F.col("text").alias("content")), rules.MIGRATION_RULES)


@query("J12_findings", _FOUND)
def findings(spark, sf_dir):
    return _found(spark, sf_dir)


_SCORE = f"SELECT repo, CAST(least(100, floor(sum({_SEV} * {_CAT} * least(n / 10.0, 2.0)))) AS INT) AS score FROM ({_FOUND}) f GROUP BY repo"
_TIER = "CASE WHEN score <= 25 THEN 'low' WHEN score <= 50 THEN 'medium' WHEN score <= 75 THEN 'high' ELSE 'extreme' END"


@query("J13_migration_score", f"SELECT repo, score, {_TIER} AS tier FROM ({_SCORE}) s")
def migration_score(spark, sf_dir):
    return rules.migration_score(_found(spark, sf_dir))


@query("J14_plan_outline", f"SELECT repo, CASE WHEN score < 30 THEN 'Big Bang' ELSE 'Phased' END AS approach, score > 50 AS strangler, CASE WHEN score <= 25 THEN '2-3' WHEN score <= 50 THEN '3-6' WHEN score <= 75 THEN '6-12' ELSE '12+' END AS months FROM ({_SCORE}) s")
def plan_outline(spark, sf_dir):
    s = rules.migration_score(_found(spark, sf_dir))
    months = F.create_map(*map(F.lit, ("low", "2-3", "medium", "3-6", "high", "6-12", "extreme", "12+")))
    return s.select("repo", F.when(F.col("score") < 30, "Big Bang").otherwise("Phased").alias("approach"), (F.col("score") > 50).alias("strangler"), months[F.col("tier")].alias("months"))


@query("J14_by_severity", f"SELECT severity, count(*) AS findings, sum(n) AS evidence FROM ({_FOUND}) f GROUP BY severity")
def by_severity(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("findings"), F.sum("n").alias("evidence"))


_FILES = "SELECT source || '/' || lang || '/' || doc_id || '.md' AS path FROM documents"
_REFS = "SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN source || '/' || lang || '/' || doc_id || '.md' WHEN 1 THEN lang || '/' || doc_id || '.md' ELSE 'gone/' || doc_id || '.md' END AS ref FROM documents"


_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, CAST(length(w) + 2 AS BIGINT)), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query("J15_resolve_paths", f"""WITH f AS ({_FILES}), t AS (SELECT ref, path, how FROM (SELECT r.ref, f.path, CASE WHEN f.path = r.ref THEN 'exact' WHEN f.path IS NULL THEN 'missing' ELSE 'suffix' END AS how, row_number() OVER (PARTITION BY r.ref ORDER BY f.path <> r.ref, length(f.path), f.path) AS rn FROM ({_REFS}) r LEFT JOIN f ON f.path = r.ref OR f.path LIKE '%/' || r.ref) t WHERE rn = 1),
x AS (SELECT DISTINCT ref, {_TRI.format('ref')} AS x FROM t WHERE how = 'missing'), y AS (SELECT DISTINCT path, {_TRI.format('path')} AS y FROM f),
s AS (SELECT ref, path, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS sim FROM x, y), b AS (SELECT ref, path, sim FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY sim DESC, path) AS i FROM s WHERE sim >= 0.3) z WHERE i = 1)
SELECT t.ref, CASE WHEN b.ref IS NOT NULL THEN 'similar' ELSE how END AS how, coalesce(t.path, b.path) AS path, round(sim, 6) AS similarity FROM t LEFT JOIN b ON b.ref = t.ref""")
def resolve_paths(spark, sf_dir):
    files = sql(spark, sf_dir, _FILES.replace("documents", "{documents}"))
    return rules.resolve_paths(sql(spark, sf_dir, _REFS.replace("documents", "{documents}")), files).withColumn("similarity", F.round("similarity", 6))


_PARTS = "SELECT doc_id, (doc_id % 11) / 1e1 AS r, (doc_id % 7) / 6e0 AS e, (doc_id % 5) / 4e0 AS f, (doc_id % 3) / 2e0 AS s FROM {documents}"


def _clamp(x: str) -> str:
    return f"CAST(greatest(0, least(100, round_even(({x}) * 100, 0))) AS INT)"


@query("J18_validity_score", f"SELECT doc_id, {_clamp('0.55::DOUBLE * r + 0.30::DOUBLE * e + 0.15::DOUBLE * f')} AS plain, {_clamp('0.35::DOUBLE * r + 0.25::DOUBLE * e + 0.15::DOUBLE * f + 0.25::DOUBLE * s')} AS semantic FROM (SELECT doc_id, CAST(r AS DOUBLE) AS r, CAST(e AS DOUBLE) AS e, CAST(f AS DOUBLE) AS f, CAST(s AS DOUBLE) AS s FROM ({_PARTS.replace('{', '').replace('}', '')}) p) q")
def validity_score(spark, sf_dir):
    p = sql(spark, sf_dir, _PARTS)
    cols = {"reference": F.col("r").cast("double"), "embedding": F.col("e").cast("double"), "freshness": F.col("f").cast("double")}
    return p.select("doc_id", rules.validity_score(cols).alias("plain"), rules.validity_score(cols | {"semantic": F.col("s").cast("double")}).alias("semantic"))


@query("J21_column_usage", "WITH l AS (SELECT doc_id AS id, i AS line, lower(x[i]) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents) d, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) r), c AS (SELECT unnest(['the', 'tion', 'und']) AS \"column\") SELECT DISTINCT c.\"column\", l.id, l.line, 'read' AS usage FROM l JOIN c ON list_contains(regexp_extract_all(l.s, '[a-z_][a-z0-9_]*'), c.\"column\") WHERE NOT regexp_matches(s, '\\b(where|join|insert|update|set)\\b')")
def column_usage(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    columns = spark.createDataFrame([("the",), ("tion",), ("und",)], "column string")
    return rules.usage_of_columns(columns, docs).where("usage = 'read'")


_WORDS = ("tion", "heit", "the", "und")


@query("J23_feature_mentions", "SELECT name, count(*) AS mentions, list(DISTINCT id ORDER BY id)[1:20] AS chunks, min(id) AS first FROM (SELECT doc_id AS id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: x IN ('tion', 'heit', 'the', 'und'))) AS name FROM documents) t GROUP BY name")
def feature_mentions(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), F.filter(ft.lexemes(F.col("text")), lambda x: x.isin(*_WORDS)).alias("names"))
    per_doc = docs.select("id", F.explode("names").alias("name")).groupBy("name", "id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("name").agg(F.sum("n").alias("mentions"), F.slice(F.array_sort(F.collect_set("id")), 1, 20).alias("chunks"), F.min("id").alias("first"))


# -- incremental -------------------------------------------------------------------------------------------------------
_JOBS = "SELECT o_orderkey AS id, o_custkey AS repo, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'CLAIMED' ELSE 'DONE' END AS status, CAST(10 - CAST(substring(o_orderpriority, 1, 1) AS INT) AS INT) AS priority, o_orderdate AS created_at, o_orderdate AS run_after, o_orderdate AS claimed_at, o_orderdate AS completed_at, CAST(o_custkey AS VARCHAR(9)) || '/' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'click' ELSE 'purchase' END AS dedup_key FROM {orders}"
_JOBS_DUCK = _JOBS.replace("{", "").replace("}", "")


def _jobs(spark, sf_dir):
    return sql(spark, sf_dir, _JOBS)


_AT = "TIMESTAMP '1996-06-01 00:00:00'"


@query("K3_batch_jobs", "SELECT user_id % 20 AS repo, CASE WHEN event_type IN ('click', 'view') THEN 'code' ELSE 'doc' END AS kind, count(DISTINCT user_id) AS n_paths, CASE WHEN CASE WHEN event_type IN ('click', 'view') THEN 'code' ELSE 'doc' END = 'doc' THEN 'DOCS_SCAN' WHEN count(DISTINCT user_id) <= 1 THEN 'REINDEX_FILE' ELSE 'REINDEX_MANY' END AS job FROM events GROUP BY 1, 2")
def batch_jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("repo"), F.when(F.col("event_type").isin("click", "view"), "code").otherwise("doc").alias("kind"), F.col("user_id").alias("path"))
    return incremental.batch_jobs(e)


@query("K2_debounce", "SELECT user_id, min(ts) AS start, arg_max(event_type, ts) AS op, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '600' SECOND THEN 0 ELSE 1 END AS new FROM events) a) b GROUP BY user_id, g")
def debounce(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("op"))
    return incremental.debounce(e, "600 seconds", ["user_id"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("K4_enqueue", f"WITH q AS ({_JOBS_DUCK}) SELECT DISTINCT k AS dedup_key FROM (SELECT CAST(user_id AS VARCHAR) || '/' || event_type AS k FROM events) e WHERE k NOT IN (SELECT dedup_key FROM q WHERE status IN ('PENDING', 'CLAIMED'))")
def enqueue(spark, sf_dir):
    queue = _jobs(spark, sf_dir)
    jobs = table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("dedup_key"))
    return incremental.enqueue(queue, jobs)


@query("K5_claim", f"WITH q AS ({_JOBS_DUCK}) SELECT id, priority FROM q WHERE status = 'PENDING' AND run_after <= {_AT} ORDER BY priority DESC, run_after, created_at, id LIMIT 25")
def claim(spark, sf_dir):
    return incremental.claimable(_jobs(spark, sf_dir), 25, F.expr(_AT.replace("TIMESTAMP", "TIMESTAMP_NTZ"))).select("id", "priority")


@query("K6_latest_state", "WITH t AS (SELECT user_id AS id, event_id AS at_, CASE event_id % 4 WHEN 0 THEN 'claim' WHEN 1 THEN 'fail' WHEN 2 THEN 'claim' ELSE 'complete' END AS op FROM events), s AS (SELECT id, arg_max(op, at_) AS op, sum(CASE WHEN op = 'claim' THEN 1 ELSE 0 END) AS attempts FROM t GROUP BY id) SELECT id, CASE WHEN op = 'claim' THEN 'CLAIMED' WHEN op = 'complete' THEN 'DONE' WHEN op = 'fail' AND attempts < 3 THEN 'PENDING' ELSE 'FAILED' END AS status, attempts FROM s")
def latest_state(spark, sf_dir):
    op = F.when(F.col("event_id") % 4 == 1, "fail").when(F.col("event_id") % 4 == 3, "complete").otherwise("claim")
    return incremental.latest_state(table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), op.alias("op")))


_DAG = ", ".join(f"('{a}', '{b}', {p}, {repr(c) if c else 'NULL'})" for a, b, p, c in incremental.FOLLOW_UPS)


@query("K7_follow_ups", f"SELECT d.repo, f.follow_up, max(f.priority) AS priority FROM (SELECT DISTINCT o_custkey % 30 AS repo, CASE o_custkey % 3 WHEN 0 THEN 'FULL_INDEX' WHEN 1 THEN 'DOCS_SCAN' ELSE 'REINDEX_FILE' END AS job FROM orders) d JOIN (VALUES {_DAG}) f(job, follow_up, priority, cond) ON f.job = d.job WHERE f.cond IS NULL OR f.cond = 'auto_embed' GROUP BY d.repo, f.follow_up")
def follow_ups(spark, sf_dir):
    done = sql(spark, sf_dir, "SELECT DISTINCT o_custkey % 30 AS repo, CASE o_custkey % 3 WHEN 0 THEN 'FULL_INDEX' WHEN 1 THEN 'DOCS_SCAN' ELSE 'REINDEX_FILE' END AS job FROM {orders}")
    return incremental.follow_ups(done, ["auto_embed"])


@query("K9_stale_jobs", f"WITH q AS ({_JOBS_DUCK}) SELECT id FROM q WHERE status = 'CLAIMED' AND claimed_at < {_AT} - INTERVAL '30' MINUTE")
def stale_jobs(spark, sf_dir):
    return incremental.stale(_jobs(spark, sf_dir), F.expr(_AT.replace("TIMESTAMP", "TIMESTAMP_NTZ"))).select("id")


@query("K10_retention", f"WITH q AS ({_JOBS_DUCK}) SELECT id, status FROM q WHERE NOT (status IN ('DONE', 'FAILED') AND completed_at < {_AT} - INTERVAL '30' DAY)")
def retention(spark, sf_dir):
    return incremental.retain(_jobs(spark, sf_dir), F.expr(_AT.replace("TIMESTAMP", "TIMESTAMP_NTZ")), 30).select("id", "status")


_OLD = "SELECT doc_id AS id, min(CAST(quality AS VARCHAR(9))) AS h FROM {labels} GROUP BY doc_id"
_NEW = "SELECT doc_id AS id, CASE WHEN lang = 'en' THEN '1' ELSE '0' END AS h FROM {documents} WHERE source <> 'src3'"


@query("K11_change_set", f"SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS op FROM ({_NEW}) n FULL OUTER JOIN ({_OLD}) o ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.h <> n.h".replace("{", "").replace("}", ""))
def change_set(spark, sf_dir):
    return incremental.changes(sql(spark, sf_dir, _OLD), sql(spark, sf_dir, _NEW))


@query("C10_rules_by_chunks", f"SELECT id, rule FROM ({_RULE_UNION}) u")
def rules_by_chunks(spark, sf_dir):
    """Every rule against every chunk in one pass: rules are literals, so each pattern is compiled once."""
    hit = F.array_compact(F.array(*(F.when(F.col("text").rlike("(?i)" + r.pattern), F.lit(r.id)) for r in rules.MIGRATION_RULES)))
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), F.explode(hit).alias("rule"))


@query("J11_ruleset", "SELECT * FROM (VALUES " + ", ".join(f"('{r.id}', '{r.category}', '{r.severity}', {rules.SEVERITY[r.severity]} * {rules.CATEGORY[r.category]})" for r in rules.MIGRATION_RULES) + ") v(id, category, severity, weight)")
def ruleset(spark, sf_dir):
    df = spark.createDataFrame([tuple(r) for r in rules.MIGRATION_RULES], "id string, category string, severity string, pattern string").drop("pattern")
    return df.withColumn("weight", rules.weight_of(rules.SEVERITY, F.col("severity"), 0.0) * rules.weight_of(rules.CATEGORY, F.col("category"), 1.0))
