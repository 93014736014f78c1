"""Database calls against a plain scan of each text, and cases by hand."""

from __future__ import annotations

import random
import re

from sparkloom.operators import calls as c

PIECES = ('client.query("SELECT 1")', "knex.raw(`a \\` b\nc`)", "knex.raw(``)", "pool.connect(", "prisma.a.", 'cursor.execute( "drop x', "await  conn.fetch('a\n\n b')", "conn.execute('x')", 'text("user")', "op.add_column(", "db.Exec(`grant`)", "conn.Query(ctx)", '@Query("  lock  ")', "executeUpdate(\"é\")", "@FlywayMigration", "ä", "\n", " ", "x" * 120, "`" + "y" * 600 + "`", "DB.QUERY('insert')", "\\`")


def plain(text, language):
    for call in c.CALLS.get(language, ()) if text is not None else ():
        for m in re.finditer(call.pattern, text, re.I):
            opens = re.compile("['\"`]").search(text, m.start(), m.start() + 100)
            s = ""
            if opens:
                q, rest = opens[0], text[opens.end() :]
                s = rest.split(q, 1)[0] if q in rest else ""
                if q == "`" and language in ("javascript", "typescript"):
                    for i, x in enumerate(rest[:499]):
                        if x == "`" and (i == 0 or rest[i - 1] != "\\"):
                            s = rest[:i]
                            break
            s = s.strip()
            line = text[: m.start()].count("\n") + 1
            got = {"database", "db-" + call.framework} | ({"migrations"} if call.kind == "migration" else set())
            for words, out in c.WORD_TAGS:
                if any(w in s.upper() for w in words):
                    got |= set(out)
            yield (call.framework, call.kind, line, line + s.count("\n"), s[:500], tuple(sorted(got)))


def test_equals_a_plain_scan(spark):
    r = random.Random(8)
    rows = [(i, r.choice([*c.CALLS, "rust", None]), "".join(r.choice(PIECES) for _ in range(r.randint(0, 12)))) for i in range(250)]
    rows += [(900, "python", None), (901, "python", ""), (902, "go", "db.Exec(\"a\")" * 300)]
    got = {}
    for x in c.db_calls(spark.createDataFrame(rows, "id long, language string, content string")).collect():
        got.setdefault(x["id"], []).append((x["framework"], x["kind"], x["start_line"], x["end_line"], x["snippet"], tuple(x["tags"])))
    want = {i: sorted(plain(text, language)) for i, language, text in rows}
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in want.items() if v}
    assert len(got[902]) == 600  # two drivers have the pattern


def test_summary_by_hand(spark):
    rows = [(1, "python", 'op.execute("drop table a")\nconn.execute("x")'), (2, "java", "@FlywayMigration")]
    found = {(x["what"], x["name"]): x["n"] for x in c.summary(c.db_calls(spark.createDataFrame(rows, "id long, language string, content string"))).collect()}
    assert found["total", ""] == 3 and found["language", "python"] == 2 and found["framework", "alembic"] == 1 and found["kind", "migration"] == 2
    assert found["tag", "database"] == 3 and found["tag", "migrations"] == 2 and found["tag", "ddl"] == 1
    assert c.summary(c.db_calls(spark.createDataFrame([], "id long, language string, content string"))).count() == 0
