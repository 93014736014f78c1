"""Calls of a database in source code: pattern tables by language, the statement behind each call, tags by its words.

All is column expressions. A pattern's matches are taken in one pass over a text, each with what lies before it, so that the
lengths add up to their places. Only texts of a language meet its patterns. The statement is cut from the text for each call,
so the work on one text grows with its length times its calls: fit for source files, not for dumps.

Defined results: null texts have no calls; languages without a table have none; a call without a quote in the 100 characters
behind its start, or whose quote isn't closed, has the snippet "". Patterns are searched without regard to case; two
patterns of a table that match at one place are two calls, as `await conn.execute("` is one of either driver's.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Call(NamedTuple):
    framework: str
    kind: str
    pattern: str


#: Patterns by language; fixed values.
NODE = (
    Call("pg", "query", r"client\.query\s*\(\s*['\"`]"), Call("pg", "query", r"pool\.query\s*\(\s*['\"`]"), Call("pg", "connection", r"pool\.connect\s*\("),
    Call("knex", "query", r"knex\s*\(\s*['\"`]"), Call("knex", "query", r"knex\.raw\s*\(\s*['\"`]"), Call("knex", "ddl", r"knex\.schema\s*\."),
    Call("sequelize", "query", r"sequelize\.query\s*\(\s*['\"`]"), Call("sequelize", "ddl", r"\.sync\s*\("),
    Call("typeorm", "orm", r"getRepository\s*\("), Call("typeorm", "query-builder", r"createQueryBuilder\s*\("),
    Call("prisma", "orm", r"prisma\.\w+\."),
)
PYTHON = (
    Call("psycopg", "query", r"cursor\.execute\s*\(\s*['\"`]"), Call("psycopg", "query", r"cursor\.executemany\s*\(\s*['\"`]"), Call("psycopg", "query", r"conn\.execute\s*\(\s*['\"`]"),
    Call("asyncpg", "query", r"await\s+conn\.fetch\s*\(\s*['\"`]"), Call("asyncpg", "query", r"await\s+conn\.execute\s*\(\s*['\"`]"), Call("asyncpg", "query", r"await\s+conn\.fetchval\s*\(\s*['\"`]"),
    Call("sqlalchemy", "query", r"session\.execute\s*\(\s*text\s*\("), Call("sqlalchemy", "query", r"text\s*\(\s*['\"`]"), Call("sqlalchemy", "connection", r"create_engine\s*\("),
    Call("alembic", "migration", r"op\.create_table\s*\("), Call("alembic", "migration", r"op\.add_column\s*\("), Call("alembic", "migration", r"op\.execute\s*\(\s*['\"`]"),
)
GO = (
    Call("database/sql", "query", r"db\.Query\s*\(\s*['\"`]"), Call("database/sql", "execute", r"db\.Exec\s*\(\s*['\"`]"), Call("database/sql", "transaction", r"tx\.Exec\s*\(\s*['\"`]"),
    Call("pgx", "query", r"conn\.Query\s*\(\s*ctx"), Call("pgx", "query", r"pool\.Query\s*\(\s*ctx"),
    Call("gorm", "query", r"db\.Raw\s*\(\s*['\"`]"), Call("gorm", "execute", r"db\.Exec\s*\(\s*['\"`]"),
)
JAVA = (
    Call("jdbc", "query", r'prepareStatement\s*\(\s*"'), Call("jdbc", "query", r'createStatement\s*\(\s*"'), Call("jdbc", "query", r'executeQuery\s*\(\s*"'), Call("jdbc", "execute", r'executeUpdate\s*\(\s*"'),
    Call("jpa", "query", r'createNativeQuery\s*\(\s*"'), Call("jpa", "query", r'@Query\s*\(\s*"'),
    Call("spring-jdbc", "query", r'jdbcTemplate\.query\s*\(\s*"'), Call("spring-jdbc", "execute", r'jdbcTemplate\.update\s*\(\s*"'),
    Call("flyway", "migration", r"@FlywayMigration"),
)
CALLS = {"javascript": NODE, "typescript": NODE, "python": PYTHON, "go": GO, "java": JAVA}
#: Tags by words of a statement in capitals: any of the words, and what it is tagged; fixed values.
WORD_TAGS = (
    (("SELECT", "FETCH"), ("dml", "select")), (("INSERT", "UPDATE", "DELETE"), ("dml",)), (("INSERT",), ("insert",)), (("UPDATE",), ("update",)), (("DELETE",), ("delete",)),
    (("CREATE", "ALTER", "DROP"), ("ddl", "migrations")), (("BEGIN", "COMMIT", "ROLLBACK", "TRANSACTION"), ("transactions",)),
    (("LOCK", "FOR UPDATE", "FOR SHARE"), ("locks",)), (("GRANT", "REVOKE", "ROLE", "USER"), ("auth-db",)),
)
#: How far behind the start of a call its quote may be, and the longest snippet that is kept; fixed values.
REACH, LONGEST = 100, 500


def _places(text: Column, pattern: str) -> Column:
    """Where a pattern's matches begin, from 0. Each match is taken with the text before it, from the end of the last one."""
    step = r"(?is)\G(.*?)(?:" + pattern + ")"
    ends = F.transform(F.regexp_extract_all(text, F.lit(step), 0), F.length)
    before = F.transform(F.regexp_extract_all(text, F.lit(step), 1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    fold = F.aggregate(F.zip_with(before, ends, lambda b, e: F.struct(b.alias("b"), e.alias("e"))), start, lambda s, x: F.struct((s["at"] + x["e"]).alias("at"), F.concat(s["out"], F.array(s["at"] + x["b"])).alias("out")))
    return F.when(text.rlike("(?is)" + pattern), fold["out"]).otherwise(F.array().cast("array<int>"))


def snippet(text: Column, at: Column, language: Column) -> Column:
    """The quoted statement behind a place; templates of JavaScript end at the first backtick that isn't escaped."""
    rest = F.substr(text, at + 1)
    quote = F.regexp_extract(F.substr(rest, F.lit(1), F.lit(REACH)), "['\"`]", 0)
    inside = F.substr(rest, F.instr(rest, quote) + 1)
    plain = F.when(F.contains(inside, quote), F.substr(inside, F.lit(1), F.instr(inside, quote) - 1))
    template = F.regexp_extract(F.substr(inside, F.lit(1), F.lit(LONGEST - 1)), r"(?s)^((?:|.*?[^\\]))`", 1)
    ended = F.substr(inside, F.lit(1), F.lit(LONGEST - 1)).rlike(r"(?s)^(?:|.*?[^\\])`")
    is_template = language.isin("javascript", "typescript") & (quote == "`") & ended & plain.isNotNull()
    whole = F.when(quote == "", "").when(is_template, template).otherwise(F.coalesce(plain, F.lit("")))
    return F.regexp_replace(F.regexp_replace(whole, r"^\s+", ""), r"\s+$", "")


def tags(statement: Column, framework: Column, kind: Column) -> Column:
    """The tags of a call, sorted."""
    up = F.upper(statement)
    none = F.array().cast("array<string>")
    by_words = (F.when(reduce(Column.__or__, (F.contains(up, F.lit(w)) for w in words)), F.array(*map(F.lit, out))).otherwise(none) for words, out in WORD_TAGS)
    own = F.array(F.lit("database"), F.concat(F.lit("db-"), framework))
    return F.array_sort(F.array_distinct(F.concat(own, *by_words, F.when(kind == "migration", F.array(F.lit("migrations"))).otherwise(none))))


def db_calls(files: DataFrame, key: str = "id", calls: dict[str, tuple[Call, ...]] = CALLS) -> DataFrame:
    """key, language, content -> key, language, framework, kind, start_line, end_line, snippet, tags: a row a call."""
    text, language = F.col("content"), F.col("language")
    by_table: dict[tuple[Call, ...], list[str]] = {}
    for name, table in calls.items():
        by_table.setdefault(table, []).append(name)
    found = F.lit(None)
    for table, names in by_table.items():
        each = F.flatten(F.array(*(_named(_places(text, c.pattern), c) for c in table)))
        found = F.when(language.isin(names), each).otherwise(found)
    rows = files.select(key, "language", "content", F.explode(found).alias("c"))
    cut = rows.select(key, "language", "c.framework", "c.kind", "c.at", (F.regexp_count(F.substr("content", F.lit(1), F.col("c.at")), F.lit("\n")) + 1).alias("start_line"), snippet(text, F.col("c.at"), language).alias("s"))
    ended = F.col("start_line") + F.regexp_count("s", F.lit("\n"))
    return cut.select(key, "language", "framework", "kind", "start_line", ended.alias("end_line"), F.substring("s", 1, LONGEST).alias("snippet"), tags(F.col("s"), F.col("framework"), F.col("kind")).alias("tags"))


def _named(places: Column, call: Call) -> Column:
    return F.transform(places, lambda at: F.struct(F.lit(call.framework).alias("framework"), F.lit(call.kind).alias("kind"), at.alias("at")))


def summary(calls: DataFrame) -> DataFrame:
    """what (total, language, framework, kind or tag), name, n: how many calls, and of each kind."""
    named = F.concat(F.array(*(F.struct(F.lit(w).alias("what"), c.alias("name")) for w, c in (("total", F.lit("")), ("language", F.col("language")), ("framework", F.col("framework")), ("kind", F.col("kind"))))), F.transform("tags", lambda t: F.struct(F.lit("tag").alias("what"), t.alias("name"))))
    return calls.select(F.explode(named).alias("x")).groupBy("x.what", "x.name").agg(F.count(F.lit(1)).alias("n"))
