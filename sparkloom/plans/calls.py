"""Database calls in stand-in sources (I30, D16): the documents with two lines that call a database, in five languages and one without a table."""

from __future__ import annotations

from sparkloom.operators import calls as c
from sparkloom.plans.stand_ins import duck
from sparkloom.registry import query, sql
from sparkloom.session import spread

_Q, _B, _N = "' || chr(39) || '", "' || chr(92) || '", "' || chr(10) || '"
_LINES = {
    "javascript": ('client.query("SELECT a FROM t")', "pool.connect()", f"knex.raw(`UPDATE t SET a = {_B}`1{_B}`{_N}WHERE b = 2`)", "prisma.user.findMany()", f"Sequelize.Query( {_N} {_Q}insert into t{_Q})", "getRepository(User)"),
    "typescript": ("pool.query(`  COMMIT  `)", "x.sync()", "knex.schema.alter", f"client.query({_Q}open"),
    "python": ('cursor.execute("DELETE FROM t")', f'await conn.execute("BEGIN;{_N}{_N}ROLLBACK")', 'session.execute(text("SELECT 1 FOR UPDATE"))', 'op.create_table("t")', f"op.execute({_Q}alter table t{_Q})", "create_engine(url)"),
    "go": ('db.Exec("CREATE ROLE x")', "tx.Exec(`COMMIT`)", 'conn.Query(ctx, "FETCH 1")', 'DB.raw ("grant a")'),
    "java": ('s.executeUpdate("DROP TABLE t")', '@Query("select u from User u")', "@FlywayMigration", 'jdbcTemplate.query("LOCK t")'),
    "rust": ('db.query("SELECT 1")',),
}


def _line(number: str) -> str:
    return f"CASE doc_id % {len(_LINES)} " + " ".join(f"WHEN {i} THEN CASE ({number}) % {len(ls)} " + " ".join(f"WHEN {j} THEN '{x}'" for j, x in enumerate(ls)) + " END" for i, ls in enumerate(_LINES.values())) + " END"


_LANGUAGE = f"CASE doc_id % {len(_LINES)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LINES)) + " END"
CODE = f"SELECT doc_id AS id, {_LANGUAGE} AS language, {_line('doc_id')} || chr(10) || text || chr(10) || {_line('doc_id * 7 + doc_id % 5')} AS content FROM {{documents}}"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _places(x: c.Call) -> str:
    pattern = _q("(?is)(.*?)(?:" + x.pattern + ")")
    ends, before = (f"list_transform(regexp_extract_all(content, {pattern}, {g}), lambda z: length(z))" for g in (0, 1))
    return f"list_transform(range(1, len({ends}) + 1), lambda i: {{'framework': '{x.framework}', 'kind': '{x.kind}', 'at': CAST(coalesce(list_sum(({ends})[1:i - 1]), 0) + ({before})[i] AS BIGINT)}})"


_TABLES = {t: [n for n in c.CALLS if c.CALLS[n] is t] for t in c.CALLS.values()}
_SPOTS = " UNION ALL ".join(f"SELECT id, language, content, unnest(flatten([{', '.join(map(_places, t))}])) AS x FROM {duck(CODE)} f WHERE language IN ({', '.join(map(_q, names))})" for t, names in _TABLES.items())
_QUOTED = f"SELECT id, language, content, x, substr(content, x.at + 1) AS rest, regexp_extract(substr(content, x.at + 1, {c.REACH}), '[''\"`]') AS q FROM ({_SPOTS}) a"
_INSIDE = f"SELECT *, substr(rest, instr(rest, q) + 1) AS tail FROM ({_QUOTED}) b"
_UNTIL = r"(?s)^((?:|.*?[^\\]))`"
_RAW = f"CASE WHEN q = '' THEN '' WHEN language IN ('javascript', 'typescript') AND q = '`' AND regexp_matches(substr(tail, 1, {c.LONGEST - 1}), {_q(_UNTIL)}) THEN regexp_extract(substr(tail, 1, {c.LONGEST - 1}), {_q(_UNTIL)}, 1) WHEN contains(tail, q) THEN substr(tail, 1, instr(tail, q) - 1) ELSE '' END"
_CUT = rf"SELECT *, regexp_replace(regexp_replace({_RAW}, '^\s+', ''), '\s+$', '') AS s FROM ({_INSIDE}) c"
_TAGGED = " || ".join("CASE WHEN " + " OR ".join(f"contains(upper(s), '{w}')" for w in ws) + " THEN [" + ", ".join(map(_q, out)) + "] ELSE [] END" for ws, out in c.WORD_TAGS)
_BREAKS = "length({0}) - length(replace({0}, chr(10), ''))"
_CALLS = f"""SELECT id, language, x.framework AS framework, x.kind AS kind, 1 + {_BREAKS.format('substr(content, 1, x.at)')} AS start_line, 1 + {_BREAKS.format('substr(content, 1, x.at)')} + {_BREAKS.format('s')} AS end_line, substr(s, 1, {c.LONGEST}) AS snippet,
list_sort(list_distinct(['database', 'db-' || x.framework] || {_TAGGED} || CASE WHEN x.kind = 'migration' THEN ['migrations'] ELSE [] END)) AS tags FROM ({_CUT}) d"""


def _calls(spark, sf_dir):
    return c.db_calls(spread(sql(spark, sf_dir, CODE)))


@query("I30_call_sites", _CALLS)
def call_sites(spark, sf_dir):
    return _calls(spark, sf_dir)


@query("D16_call_summary", f"WITH k AS ({_CALLS}) SELECT 'total' AS what, '' AS name, count(*) AS n FROM k HAVING count(*) > 0" + "".join(f" UNION ALL SELECT '{x}', {x}, count(*) FROM k GROUP BY {x}" for x in ("language", "framework", "kind")) + " UNION ALL SELECT 'tag', t, count(*) FROM (SELECT unnest(tags) AS t FROM k) u GROUP BY t")
def call_summary(spark, sf_dir):
    return c.summary(_calls(spark, sf_dir))
