"""The rule set and detection against plain code, and cases by hand."""

from __future__ import annotations

import random
import re

from sparkloom.operators import migration as m

PIECES = ("import cx_Oracle", "ROWNUM", "xROWNUMx", "connect\nby", "NVL (", "from dual", "seq.nextval", "/*+ a\n*/", "package body", "DBMS_X", "merge into", "require x pymssql", "WITH ( nolock )", "[a]", "#t", "BEGIN TRY", "$match", "insertOne({a: {}})", "$near", "limit 3 , 4", "`a`", "auto_increment", "rollback", "exec @q", "GO", "jdbc:oracle", "mysql://", "Server=a;Database=b", "sp_", "limit\noffset", None)


def cases(n):
    r = random.Random(3)
    for i in range(n):
        words = r.sample(PIECES, r.randint(0, 4))
        text = None if None in words else r.choice([" ", "\n"]).join(words)
        yield (r.choice(["p", "q", None]), i, f"f{i}" + r.choice([".sql", ".pkb", ".tsql", ".PKB"]), text)


def plain(pattern):
    return re.compile(re.sub(r"(?<!\\)\$", r"\\Z", pattern.removeprefix("(?i)").replace(r"\y", r"\b")), re.I | re.S)


def test_rules_equal_plain_search(spark):
    rows = list(cases(120)) + [("p", 900, "a.sql", " go \n"), ("p", 901, "b.sql", "go\nx")]
    code = spark.createDataFrame(rows, "repo string, id long, path string, content string")
    used = spark.createDataFrame([("p", "sqlserver"), ("q", "mongodb")], "repo string, db string")
    got = {(x["repo"], x["rule"]): [e["id"] for e in x["evidence"]] for x in m.findings(code, used, k=7).collect()}
    want = {}
    for repo, i, _, text in rows:
        for rule in m.RULE_SET:
            if rule.source_db in ("", {"p": "sqlserver", "q": "mongodb"}.get(repo)) and text is not None and plain(rule.pattern).search(text):
                want.setdefault((repo, rule.id), []).append(i)
    assert got == {k: v[:7] for k, v in want.items()}
    assert 900 in want["p", "SQLSERVER_GO"] and 901 not in want["p", "SQLSERVER_GO"] and (None, "COMMON_TRANSACTION") in got


def test_detection_equals_plain_search(spark):
    rows = list(cases(150))
    code = spark.createDataFrame(rows, "repo string, id long, path string, content string")
    want = {}
    for db, kind, _, mark in m.marks():
        pattern = re.compile(m.mark_pattern(kind, mark).replace(r"\z", r"\Z"))
        for repo in {x[0] for x in rows}:
            if any(x[0] == repo and x[3] is not None and pattern.search(x[3]) for x in rows):
                want[repo, db] = want.get((repo, db), 0) + m.POINTS[kind][0]
    for db, kinds in m.DETECTION.items():
        for end in kinds.get("file_extensions", ()):
            for repo in {x[0] for x in rows}:
                n = min(m.FILES, sum(x[0] == repo and x[2].endswith(end) for x in rows))
                if n:
                    want[repo, db] = want.get((repo, db), 0) + 15 * n
    got = {(x["repo"], x["db"]): x for x in m.detect(code, code).collect()}
    assert {k: x["score"] for k, x in got.items()} == want
    assert all(x["confidence"] == min(1.0, x["score"] / 50) for x in got.values())
    assert all(sum(e.startswith("File: ") for e in x["evidence"]) <= 3 for x in got.values())


def test_score_by_hand(spark):
    rows = [("a", i, "x.sql", "CREATE OR REPLACE PACKAGE BODY p") for i in range(5)] + [("a", 9, "y.sql", "select rownum")]
    code = spark.createDataFrame(rows, "repo string, id long, path string, content string")
    found = m.findings(code, spark.createDataFrame([("a", "oracle")], "repo string, db string"))
    #: 50 * 1.5 * 0.5 and 15 * 1.0 * 0.1
    assert [tuple(x) for x in m.score(found).collect()] == [("a", 39, "medium")]
    assert m.summary(found).collect()[0]["summary"].startswith("Migration complexity: MEDIUM (score: 39/100). Found 2 issues: 1 critical, 0 high severity. Moderate")
    both = m.assess(code, code)
    assert sorted(map(str, both[1].collect())) == sorted(map(str, found.collect()))
    assert sorted(map(str, both[0].collect())) == sorted(map(str, m.detect(code, code).collect()))
    empty = code.limit(0)
    assert m.findings(empty, m.likeliest(m.detect(empty, empty))).count() == 0
