"""Moving to another database, by the whole rule set (C10, J10 to J14): stand-in code is the documents with a line of one dialect."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import migration as m
from sparkloom.plans.stand_ins import duck
from sparkloom.registry import query, sql
from sparkloom.session import spread

_OPEN, _CLOSE = "' || chr(123) || '", "' || chr(125) || '"
#: Lines of code by family of repositories.
_LINES = (
    ("import cx_Oracle", "SELECT * FROM t WHERE ROWNUM < 10", "SELECT NVL(a, 0), DECODE(b, 1, 2) FROM dual", "START WITH a CONNECT  BY PRIOR a = b", "CREATE OR REPLACE PACKAGE BODY p AS", "DBMS_OUTPUT.PUT_LINE(SYSDATE)", "PRAGMA AUTONOMOUS_TRANSACTION; COMMIT", "MERGE INTO t USING s", "SELECT /*+ FULL(t) */ seq.NEXTVAL", "jdbc:oracle:thin:@//db:1521/x", "EXECUTE IMMEDIATE q"),
    ("using pyodbc", "SELECT TOP 5 [a] FROM t WITH (NOLOCK)", "CREATE PROC p @x INT OUTPUT", "BEGIN TRY EXEC sp_executesql @q END TRY", "CREATE TABLE #t (a INT IDENTITY(1,1))", "Server=db;Database=x", "BEGIN TRAN ROLLBACK", "SELECT a, rownumber FROM t"),
    ('const x = require("mongoose")', f"db.t.aggregate([{_OPEN}$match: 1{_CLOSE}])", f"db.t.insertOne({_OPEN}a: {_OPEN}b: 1{_CLOSE}{_CLOSE})", f"{_OPEN}$push: 1{_CLOSE}", f"{_OPEN}$text: 1{_CLOSE}", f"{_OPEN}$near: 1{_CLOSE}", "mongodb://db/x"),
    ("import pymysql", "SELECT a FROM t LIMIT 5, 10", "a INT AUTO_INCREMENT, b TINYINT", "SELECT `a` FROM `t`", "mysql://db/x", "SELECT a FROM t LIMIT 5 OFFSET 10"),
)
_FAMILY = "ascii(right(coalesce(source, 'a'), 1)) % 4"
_LINE = f"CASE {_FAMILY} " + " ".join(f"WHEN {i} THEN CASE doc_id % {len(ls) + 3} " + " ".join(f"WHEN {j} THEN '{x}'" for j, x in enumerate(ls)) + " ELSE '' END" for i, ls in enumerate(_LINES)) + " END"
_END = f"CASE WHEN {_FAMILY} = 0 AND doc_id % 9 = 0 THEN '.pkb' WHEN {_FAMILY} = 1 AND doc_id % 10 = 0 THEN '.tsql' ELSE '.sql' END"
CODE = f"SELECT doc_id AS id, source AS repo, source || '/f' || doc_id || {_END} AS path, text || chr(10) || {_LINE} AS content FROM {{documents}}"

_C = duck(CODE)


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _code(spark, sf_dir):
    return spread(sql(spark, sf_dir, CODE))


_MARKED = ", ".join(f"CASE WHEN regexp_matches(content, {_q(m.mark_pattern(k, w))}) THEN {{'db': {_q(d)}, 'kind': {_q(k)}, 'at': {i}, 'what': {_q(w)}}} END" for d, k, i, w in m.marks())
_ENDED = ", ".join(f"CASE WHEN path LIKE '%{e}' THEN {{'db': {_q(d)}, 'kind': 'file_extensions', 'at': {i}, 'what': path}} END" for d, ks in m.DETECTION.items() for i, e in enumerate(ks.get("file_extensions", ())))
_FILTER = "list_filter([{}], lambda x: x IS NOT NULL)"
_SPOTS = f"""SELECT DISTINCT repo, h.db AS db, h.kind AS kind, h.at AS at_, h.what AS what FROM (SELECT repo, unnest({_FILTER.format(_MARKED)}) AS h FROM {_C} c) a
UNION ALL SELECT repo, db, kind, at_, what FROM (SELECT *, row_number() OVER (PARTITION BY repo, db, at_ ORDER BY what) AS n FROM (SELECT DISTINCT repo, h.db AS db, h.kind AS kind, h.at AS at_, h.what AS what FROM (SELECT repo, unnest({_FILTER.format(_ENDED)}) AS h FROM {_C} c) b) d) e WHERE n <= {m.FILES}"""
_POINTS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {p}" for k, (p, _, _) in m.POINTS.items()) + " END"
_SHOWN = " || ".join(f"coalesce(list({_q(label)} || what ORDER BY at_, what) FILTER (WHERE kind = '{k}'), [])[1:{n}]" for k, (_, label, n) in m.POINTS.items())
_DETECTED = f"SELECT repo, db, CAST(sum({_POINTS}) AS DOUBLE) AS score, CAST(least(1.0, sum({_POINTS}) / 50.0) AS DOUBLE) AS confidence, {_SHOWN} AS evidence FROM ({_SPOTS}) s GROUP BY repo, db"
_USED = f"SELECT repo, db FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY confidence DESC, db) AS n FROM ({_DETECTED}) d) u WHERE n = 1"
_RULED = ", ".join(f"CASE WHEN regexp_matches(content, {_q(m.ported(r.pattern))}) THEN {i} END" for i, r in enumerate(m.RULE_SET))
_TABLE = "(VALUES " + ", ".join("(" + ", ".join([str(i), *map(_q, r[:5])]) + ")" for i, r in enumerate(m.RULE_SET)) + ") v(at_, rule, source_db, category, severity, title)"
_FOUND = f"""SELECT repo, rule, CASE WHEN source_db = '' THEN coalesce(db, 'unknown') ELSE source_db END AS source_db, category, severity, title, count(*) AS n, list(id || ' ' || path ORDER BY id) AS evidence FROM (SELECT h.*, v.*, u.db, row_number() OVER (PARTITION BY h.repo, v.at_ ORDER BY id, path) AS place
FROM (SELECT repo, id, path, unnest({_FILTER.format(_RULED)}) AS hit FROM {_C} c) h JOIN {_TABLE} ON v.at_ = h.hit LEFT JOIN ({_USED}) u ON u.repo IS NOT DISTINCT FROM h.repo WHERE v.source_db = '' OR v.source_db = u.db) t WHERE place <= 50 GROUP BY ALL"""
_FOUND = _FOUND.replace("GROUP BY ALL", "GROUP BY repo, rule, source_db, db, category, severity, title")
_WEIGHT = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.SEVERITY.items()) + " END * CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.CATEGORY.items()) + " ELSE 1.0 END"
_SCORE = f"SELECT repo, CAST(least(100, floor(round(sum({_WEIGHT} * least(n / 10.0, 2.0)), 6))) AS INT) AS score, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high FROM ({_FOUND}) f GROUP BY repo"
_TIERED = f"SELECT *, CASE WHEN score <= 25 THEN 'low' WHEN score <= 50 THEN 'medium' WHEN score <= 75 THEN 'high' ELSE 'extreme' END AS tier FROM ({_SCORE}) s"


def _found(spark, sf_dir):
    code = _code(spark, sf_dir)
    return m.assess(code, code)[1]


@query("J10_source_databases", _DETECTED)
def source_databases(spark, sf_dir):
    code = _code(spark, sf_dir)
    return m.detect(code, code)


@query("C10_rule_set_by_chunks", f"SELECT h.id, v.rule FROM (SELECT id, unnest({_FILTER.format(_RULED)}) AS hit FROM {_C} c) h JOIN {_TABLE} ON v.at_ = h.hit")
def rule_set_by_chunks(spark, sf_dir):
    low = _code(spark, sf_dir).select("id", "content", F.lower("content").alias("low"))
    hit = F.array_compact(F.array(*(F.when(m.found_in(F.col("content"), F.col("low"), m.ported(r.pattern)), r.id) for r in m.RULE_SET)))
    return low.select("id", F.explode(hit).alias("rule"))


@query("J12_rule_set_findings", _FOUND)
def rule_set_findings(spark, sf_dir):
    return _found(spark, sf_dir).withColumn("evidence", F.transform("evidence", lambda e: F.concat_ws(" ", e["id"].cast("string"), e["path"])))


@query("J13_rule_set_score", f"SELECT repo, score, tier FROM ({_TIERED}) t")
def rule_set_score(spark, sf_dir):
    return m.score(_found(spark, sf_dir))


@query("J14_top_blockers", "SELECT repo, place, rule, title, severity, category, n FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CASE severity " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(m.ORDER)) + f" END, n DESC, rule) AS place FROM ({_FOUND}) f) b WHERE place <= 10")
def top_blockers(spark, sf_dir):
    return m.blockers(_found(spark, sf_dir))


@query("J14_summary", f"SELECT repo, score, tier, 'Migration complexity: ' || upper(tier) || ' (score: ' || score || '/100). Found ' || n || ' issues: ' || critical || ' critical, ' || high || ' high severity. ' || CASE tier " + " ".join(f"WHEN '{k}' THEN {_q(v)}" for k, v in m.CLOSING.items()) + f" END AS summary FROM ({_TIERED}) t")
def migration_summary(spark, sf_dir):
    return m.summary(_found(spark, sf_dir))
