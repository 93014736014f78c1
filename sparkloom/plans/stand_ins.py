"""Files, sources, scripts and patches made of the input tables, by SQL text that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.registry import sql

_ENDINGS = (".py", ".js", ".tsx", ".go", ".java", ".h", ".sql", ".md", ".rst", ".bin")
_ENDING = "CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ENDINGS)) + " END"
_FOLDER = "CASE WHEN doc_id % 7 = 0 THEN 'tests/' WHEN doc_id % 11 = 0 THEN 'node_modules/x/' WHEN doc_id % 13 = 0 THEN '.cache/' WHEN doc_id % 17 = 0 THEN 'services/' WHEN doc_id % 19 = 0 THEN '../' ELSE '' END"
#: A repository whose files are documents.
FILES = f"SELECT doc_id AS id, source || '/' || {_FOLDER} || 'f' || doc_id || {_ENDING} AS path, text AS content, source, lang, n_chars FROM {{documents}}"

_PY = "'import os' || chr(10) || 'from m' || (p_partkey % 5) || ' import thing' || chr(10) || chr(10) || 'class C' || p_partkey || '(Base' || (p_partkey % 3) || '):' || chr(10) || '    def run(self):' || chr(10) || '        return helper' || p_partkey || '(1)' || chr(10) || chr(10) || 'def helper' || p_partkey || '(x):' || chr(10) || '    return len(x)' || chr(10)"
_GO = "'package main' || chr(10) || chr(10) || 'import \"fmt\"' || chr(10) || chr(10) || 'func add' || p_partkey || '(a int) int ' || chr(123) || chr(10) || '  return a + 1' || chr(10) || chr(125) || chr(10) || chr(10) || 'func (s *Set) Put' || p_partkey || '(x int) ' || chr(123) || chr(10) || '  add' || p_partkey || '(x)' || chr(10) || chr(125) || chr(10)"
#: Source files in two languages, one a part.
SOURCES = f"SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'python' ELSE 'go' END AS language, CASE WHEN p_partkey % 2 = 0 THEN {_PY} ELSE {_GO} END AS content FROM {{part}}"

_TABLE = "'-- script' || chr(10) || 'CREATE TABLE t' || s_suppkey || ' (' || chr(10) || '  id BIGINT PRIMARY KEY,' || chr(10) || '  name TEXT NOT NULL,' || chr(10) || '  ref BIGINT REFERENCES t' || (s_suppkey % 7) || '(id)' || chr(10) || ');' || chr(10)"
_INSERTS = "repeat('INSERT INTO t' || s_suppkey || ' VALUES (1);' || chr(10), CAST(s_suppkey % 4 AS INT))"
_FUNCTION = "'CREATE FUNCTION f' || s_suppkey || '(a INT) RETURNS INT AS $$' || chr(10) || 'BEGIN' || chr(10) || '  IF a > 0 THEN' || chr(10) || '    EXECUTE IMMEDIATE a;' || chr(10) || '  END IF;' || chr(10) || 'END;' || chr(10) || '$$ LANGUAGE plpgsql;' || chr(10)"
#: SQL scripts, one a supplier: a table, none to three insertions, a function.
SCRIPTS = f"SELECT s_suppkey AS id, {_TABLE} || {_INSERTS} || {_FUNCTION} AS content FROM {{supplier}}"

#: Single-file components, one a supplier, with none to three lines of markup.
COMPONENTS = "SELECT s_suppkey AS id, '<template>' || chr(10) || repeat('<p/>' || chr(10), CAST(s_suppkey % 4 AS INT)) || '</template>' || chr(10) || '<script lang=\"ts\">' || chr(10) || 'export default ' || s_suppkey || chr(10) || '</script>' || chr(10) AS content FROM {supplier}"

#: Patches, one a part: a change, a deletion, a new file or a move.
PATCHES = """SELECT p_partkey AS id, 'diff --git a/x b/x' || chr(10) || CASE p_partkey % 4 WHEN 2 THEN '--- /dev/null' ELSE '--- a/src/f' || p_partkey || '.py' END || chr(10)
|| CASE p_partkey % 4 WHEN 1 THEN '+++ /dev/null' WHEN 3 THEN '+++ b/new/f' || p_partkey || '.py' ELSE '+++ b/src/f' || p_partkey || '.py' END || chr(10) || '@@ -1 +1 @@' || chr(10) || '-a' || chr(10) || '+b' || chr(10) AS patch FROM {part}"""

#: References of all kinds, one a part.
REFERENCES = """SELECT p_partkey AS id, CASE p_partkey % 11 WHEN 0 THEN 'src/db/p' || p_partkey || '.py' WHEN 1 THEN 'from a' || p_partkey || '.b import c' WHEN 2 THEN '@app' || p_partkey || '.route' WHEN 3 THEN 'pool' || p_partkey || '.get(1)' WHEN 4 THEN 'connect' || p_partkey || '()'
WHEN 5 THEN 'Http' || p_partkey || 'Client' WHEN 6 THEN 'a' || p_partkey || '.b.c' WHEN 7 THEN 'MAX_' || p_partkey WHEN 8 THEN 'Config' || p_partkey WHEN 9 THEN 'name' || p_partkey ELSE 'two words ' || p_partkey END AS ref FROM {part}"""


def duck(text: str) -> str:
    """The same text for the oracle, as a table in brackets."""
    return "(" + text.replace("{", "").replace("}", "") + ")"


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return sql(spark, sf_dir, text)
