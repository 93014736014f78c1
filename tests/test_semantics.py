"""Constants and edges of the operators, by hand."""

from __future__ import annotations

from oracle import TABLES, compare, duck
from pyspark.sql import functions as F

import sparkloom.plans  # noqa: F401
from sparkloom.functions import text as t
from sparkloom.operators import claims, fulltext, fusion, graph, incremental, listings, rules, vector
from sparkloom.registry import ORACLES, QUERIES
from sparkloom.sources import code, extract, files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def test_identical_vectors_score_one_and_order_does_not_matter(spark):
    rows = [(i, [float(i), 1.0, -2.0]) for i in range(6)]
    a = vector.vector_topk(spark.createDataFrame(rows, "id long, vector array<float>"), rows[3][1], 3).collect()
    b = vector.vector_topk(spark.createDataFrame(rows[::-1], "id long, vector array<float>"), rows[3][1], 3).collect()
    assert a == b and a[0]["id"] == 3 and abs(a[0]["score"] - 1) < 1e-9
    more = vector.vector_topk(spark.createDataFrame(rows, "id long, vector array<float>"), rows[3][1], 4).collect()
    assert more[:3] == a


def test_zero_vector_has_no_score(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, vector array<double>")
    assert [r["id"] for r in vector.vector_topk(df, [1.0, 0.0], 5).collect()] == [2]


def test_step_decay_edges(spark):
    for days, want in ((0, 1.0), (7, 0.9), (7.01, 0.7), (30, 0.7), (90, 0.4), (180, 0.2), (181, 0.1)):
        assert one(spark, t.step_decay(F.lit(float(days)))) == want


def test_budget_edges(spark):
    spans = spark.createDataFrame([(i, 10) for i in range(5)], "at int, n int")
    assert [r["at"] for r in graph.pack_crossing(spans, 20, F.col("n")).orderBy("at").collect()] == [0, 1]
    assert [r["at"] for r in graph.pack_crossing(spans, 21, F.col("n")).orderBy("at").collect()] == [0, 1, 2]
    assert [r["at"] for r in graph.pack_within(spans, 29, F.col("n")).orderBy("at").collect()] == [0, 1]
    assert [r["at"] for r in graph.pack_within(spans, 30, F.col("n")).orderBy("at").collect()] == [0, 1, 2]


def test_traversal_keeps_multiplicity_and_expands_once(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)], "src long, dst long")
    got = sorted((r["node"], r["depth"]) for r in graph.traverse(edges, spark.createDataFrame([(1,)], "node long"), "out", 3).collect())
    assert got == [(1, 3), (2, 1), (3, 1), (4, 2), (4, 2)]


def test_scores_are_divided_after_filters(spark):
    vec = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id long, score double")
    fts = spark.createDataFrame([(2, 0.4), (3, 0.2)], "id long, score double")
    tags = spark.createDataFrame([(2, "x"), (3, "x")], "id long, tag string")
    got = {r["id"]: round(r["score"], 6) for r in fusion.hybrid(vec, fts, 5, tags=tags, tags_any=["x"]).collect()}
    assert got == {2: 1.0, 3: 0.275}


def test_scores_are_null_where_a_list_is_filtered_out(spark):
    vec = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id long, score double")
    fts = spark.createDataFrame([(4, 0.4), (3, 0.2)], "id long, score double")
    tags = spark.createDataFrame([(3, "x"), (4, "x")], "id long, tag string")
    rows = fusion.hybrid(vec, fts, 5, tags=tags, tags_all=["x"]).collect()
    assert [(r["id"], r["score"]) for r in rows] == [(3, None), (4, None)]


def test_feature_context_equals_sql_without_a_good_vector(spark, sf_dir, tmp_path):
    for name in TABLES:
        if name != "labels":
            (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    con = duck(sf_dir)
    con.execute(f"COPY (SELECT * FROM labels WHERE doc_id NOT IN (SELECT id FROM ({ORACLES['F1_vector_topk']}) v)) TO '{tmp_path}/labels.parquet'")
    con = duck(str(tmp_path))
    assert compare(QUERIES["J27_db_feature_context"](spark, str(tmp_path)), con, ORACLES["J27_db_feature_context"]) is None
    assert con.execute(f"SELECT count(*), count(score) FROM ({ORACLES['J27_db_feature_context']}) j").fetchone()[1] == 0


def test_validity_score_rounds_half_to_even(spark):
    parts = {"reference": F.lit(0.5), "embedding": F.lit(0.5), "freshness": F.lit(0.2)}
    assert one(spark, rules.validity_score(parts)) == 46  # 45.5
    assert one(spark, rules.validity_score(parts | {"llm": F.lit(1.0)})) == 56


def test_or_query_keeps_compound_words():
    assert fulltext.or_query("DBMS_JOB x foo.bar (Job)") == "dbms_job:* | foo.bar:* | job:*"


def test_fallback_only_when_nothing_matches(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma-delta")], "id long, content string")
    assert [r["id"] for r in fulltext.search_any(docs, "alp", 5).collect()] == [1]
    assert [r["id"] for r in fulltext.search_any(docs, "amma-d", 5).collect()] == [2]


def test_debounce_last_event_wins(spark):
    rows = [("a", "2024-01-01 00:00:00", "UPSERT"), ("a", "2024-01-01 00:00:01", "DELETE"), ("a", "2024-01-01 00:00:09", "UPSERT")]
    e = spark.createDataFrame(rows, "path string, ts string, op string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [(r["op"], r["n"]) for r in incremental.debounce(e, "2 seconds", ["path"]).orderBy("start").collect()]
    assert got == [("DELETE", 2), ("UPSERT", 1)]


def test_retry_until_third_attempt(spark):
    ops = ["claim", "fail", "claim", "fail", "claim", "fail"]
    df = lambda n: spark.createDataFrame([(1, i, op) for i, op in enumerate(ops[:n])], "id long, at long, op string")
    assert incremental.latest_state(df(4)).head()["status"] == "PENDING"
    assert incremental.latest_state(df(6)).head()["status"] == "FAILED"


def test_glob_and_ignore(spark):
    assert files.glob_regex("src/*.py") == r"^src/.*\.py$"
    paths = ["build/x.py", "a/build/y.py", "src/a.log", "keep.log", "top.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r["path"] for r in df.where(~files.ignored(F.col("path"), ["build/", "*.log", "!keep.log"])).collect()]
    assert got == ["keep.log", "top.py"]


def test_scan_repo(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / ".hidden.py").write_text("")
    (tmp_path / "b.bin").write_text("")
    assert [(r["path"], r["language"]) for r in files.scan_repo(spark, str(tmp_path)).collect()] == [("src/a.py", "python")]


def test_scans_over_a_tree_of_files(spark, tmp_path):
    """Sources by ignore rules and languages, documentation outside the excluded folders; empty files and names with a dot or an underscore before come as well."""
    tree = {"src/a.py": "x = 1\n", "src/b.GO": "package b", "lib/c.ts": "let c", "lib/__init__.py": "", "lib/_x.py": "é", "node_modules/d.js": "x", "docs/guide.md": "# G", "docs/old.RST": "O", "build/notes.md": "no", "db/t.sql": "SELECT 1", "db/u.ddl": "DROP", "target/kept.adoc": "k", ".github/w.md": "w", "README": "r", "x.min.js": "y"}
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "raw.bin").write_bytes(bytes(range(256)))
    got = {r["path"]: (r["language"], r["content"]) for r in files.scan_repo(spark, str(tmp_path), ["node_modules/", "*.min.js"]).collect()}
    assert got == {"src/a.py": ("python", "x = 1\n"), "src/b.GO": ("go", "package b"), "lib/c.ts": ("typescript", "let c"), "db/t.sql": ("sql", "SELECT 1"), "db/u.ddl": ("sql", "DROP"), "lib/__init__.py": ("python", ""), "lib/_x.py": ("python", "é")}
    docs = {r["path"]: r["type"] for r in files.scan_docs(spark, str(tmp_path)).collect()}
    assert docs == {"docs/guide.md": "markdown", "docs/old.RST": "restructuredtext", "db/t.sql": "sql_schema", "db/u.ddl": "sql_schema", "target/kept.adoc": "asciidoc", ".github/w.md": "markdown"}


def test_lines_stay_below_the_root(spark):
    rows = [("a.py", "1\n2\n3"), ("../a.py", "1"), ("x/../y", "1"), ("/etc/passwd", "1"), ("x..y", "1")]
    got = {r["path"]: (r["lines"], r["n_lines"]) for r in listings.read_lines(spark.createDataFrame(rows, "path string, content string"), 2, 9).collect()}
    assert got == {"a.py": ("2\n3", 3), "../a.py": (None, None), "x/../y": (None, None), "/etc/passwd": (None, None), "x..y": ("", 1)}


def test_upsert_and_insert_take_one_row_a_key(spark):
    old = spark.createDataFrame([(1, "old", 0), (2, "old", 0)], "id long, v string, at long")
    new = spark.createDataFrame([(2, "b", 1), (2, "c", 2), (3, "d", 1), (3, "e", 5)], "id long, v string, at long")
    rows = lambda df: sorted((r["id"], r["v"]) for r in df.collect())
    assert rows(incremental.upsert(old, new, ["id"], [F.desc("at")])) == [(1, "old"), (2, "c"), (3, "e")]
    assert rows(incremental.insert_new(old, new, ["id"], [F.desc("at")])) == [(1, "old"), (2, "old"), (3, "e")]


def test_keywords_by_row_equal_those_of_the_driver(spark):
    texts = ["How do I print lines with DBMS_OUTPUT and maxValue2", "Error error ERROR A1 XMLParser can our x über_maß", "", "the of AND"]
    for text in texts:
        tech, plain = fulltext.weighted_keywords(text)
        row = one(spark, fulltext.keywords_column(F.lit(text)))
        assert ([k["word"] for k in row if k["technical"]], [k["word"] for k in row if not k["technical"]]) == (tech, plain)
    assert fulltext.weighted_keywords(texts[0]) == (["dbms_output", "maxvalue2"], ["print", "lines"])
    assert fulltext.weighted_keywords("Error error ERROR A1 can our should") == (["a1"], ["error"])


def test_auto_tags(spark):
    paths = ["web/node_modules/x/y.js", "app/dist/a.js", "app/a.min.js", "a/min.js", "x/tests/t.py", "x/a_test.go", "x/a.spec.ts", "src/vendor/v/dist/b.js", "src/a.py"]
    df = spark.createDataFrame(list(enumerate(paths)), "id long, path string")
    got = sorted((r["id"], r["tag"]) for r in rules.auto_tags(df).collect())
    assert got == [(0, "vendor"), (1, "generated"), (2, "generated"), (4, "test"), (5, "test"), (6, "test"), (7, "generated"), (7, "vendor")]


def test_patch_of_several_files(spark):
    patch = "--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n--- not a head\n+x\n--- /dev/null\n+++ b/new.py\n--- a/gone.py\n+++ /dev/null\n--- a/o.py\n+++ b/p.py\n"
    got = sorted((r["op"], r["path"]) for r in t.patch_changes(spark.createDataFrame([(1, patch)], "id long, patch string")).collect())
    assert got == [("DELETE", "gone.py"), ("DELETE", "o.py"), ("UPSERT", "new.py"), ("UPSERT", "p.py"), ("UPSERT", "x.py")]


def test_full_text_index_equals_the_scan(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS id", "text AS content")
    fulltext.write_index(docs, str(tmp_path / "index"))
    index = fulltext.read_index(spark, str(tmp_path / "index"))
    for query in ("tion wor the_x", "zzzzq", "the", "ss, -- (", "er er ern"):
        want = [tuple(r) for r in fulltext.search_any(docs, query, 20).collect()]
        assert [tuple(r) for r in fulltext.search_index(index, docs, query, 20).collect()] == want
    plan = fulltext.search_index(index, docs, "tion", 5)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lexeme), StringStartsWith(lexeme,tion)]" in plan


def test_vector_index_equals_the_scan_and_reads_few_cells(spark, tmp_path):
    import random

    r = random.Random(3)
    middle = [[r.gauss(0, 1) for _ in range(12)] for _ in range(30)]
    rows = [(i, [x + r.gauss(0, 0.1) for x in middle[i % 30]]) for i in range(3000)] + [(5000, [0.0] * 12), (5001, rows_ := middle[0]), (5002, rows_)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    index = vector.write_cells(df, str(tmp_path / "cells"), 30)
    read = []
    for i in range(0, 3000, 150):
        want = [tuple(x) for x in vector.vector_topk(df, rows[i][1], 10).collect()]
        found, cells = vector.search_cells(spark, index, rows[i][1], 10)
        got = [tuple(x) for x in found.collect()]
        assert [x[0] for x in got] == [x[0] for x in want] and all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(got, want))
        read.append(len(cells))
    assert sum(read) / len(read) < 10
    assert vector.search_cells(spark, vector.write_cells(df.where("false"), str(tmp_path / "none"), 3), rows[0][1], 5)[0].count() == 0


def test_html_branches():
    html = "<html><head><title>T</title></head><body><nav>no</nav><h1>Head</h1><p>A paragraph of text.</p><pre>x = 1\ny</pre><table><tr><td>a</td><td>b</td></tr></table><ul><li>one</li><li>two</li></ul><script>bad()</script></body></html>"
    got = extract.html_sections(html)
    assert [s[2] for s in got] == ["text", "code", "table", "list"]
    assert got[0][:2] == ("Head", 1) and "no" not in got[0][3] and got[1][3] == "x = 1\ny"


def test_statements_with_dollar_quotes():
    sql = "CREATE FUNCTION f() AS $x$\nSELECT 1;\n$x$;\n\n-- c\nINSERT INTO t VALUES (1);"
    assert [(k, a, b) for k, _, a, b, _ in code.statements_of(sql)] == [("CREATE_FUNCTION", 1, 3), ("INSERT", 6, 6)]


def test_split_text_overlaps_and_loses_nothing():
    text = " ".join(f"word{i}." for i in range(900))
    sizes = code.Sizes(400, 500, 50, 40)
    parts = code.split_text(text, sizes)
    assert all(len(p) <= sizes.most for p in parts)
    at = 0
    for p in parts:
        found = text.find(p, max(0, at - sizes.overlap - 2))
        assert 0 <= found <= at
        at = found + len(p) + 1
    assert at >= len(text)


def test_dialect_ties_go_to_oracle(spark):
    assert one(spark, t.sql_dialect(F.lit("SELECT TOP 5 x FROM t WITH (NOLOCK) WHERE ROWNUM < 3 AND NVL(a, 1) = 1"))) == "oracle"
    assert one(spark, t.sql_dialect(F.lit("SELECT SYSDATE"))) == "postgres"


def test_scan_repo_query_lists_every_table(spark, tmp_path):
    import sparkloom.plans  # noqa: F401
    from sparkloom.registry import QUERIES

    for name in ("a.parquet", "b.parquet"):
        (tmp_path / name).write_bytes(b"x" * len(name))
    (tmp_path / "c.parquet").mkdir()
    (tmp_path / "c.parquet" / "part-0.parquet").write_bytes(b"xy")
    got = QUERIES["A1_folder_files"](spark, str(tmp_path)).collect()
    assert sorted((r["path"], r["size"]) for r in got) == [("a.parquet", 9), ("b.parquet", 9), ("part-0.parquet", 2)]


def test_claims_judgements_and_their_severity(spark):
    """Replies in every shape; equal values are no mismatch; without code none is found."""
    replies = {"a": '[{"claim_text": "x 5", "expected_value": 5, "confidence": 0.9}, {"claim_text": "weak", "confidence": 0.5}]', "b": '```json\n{"claims": [{"claim_text": "y", "confidence": 1, "topic": "t"}]}\n```', "c": 'Here: {"claim_text": "z", "confidence": 0.8}', "d": "none", "e": "[]"}
    docs = spark.createDataFrame([(i, k) for i, k in enumerate(replies)], "id long, content string")
    found = claims.claims_of(docs, replies.__getitem__)
    got = sorted((r["id"], r["claim"], r["topic"], r["expected"]) for r in found.collect())
    assert got == [(0, "x 5", "unknown", "5"), (1, "y", "t", None), (2, "z", "unknown", None)]
    verdicts = {"one": '{"verdict": "mismatch", "confidence": 0.95, "actual_value": "5.0 items"}', "two": '{"verdict": "mismatch", "confidence": 0.75, "actual_value": 6}', "three": "?"}
    said = spark.createDataFrame([(1, "one", "5"), (2, "two", "5"), (3, "three", "5"), (4, "four", None)], "id long, claim string, expected string")
    code_ = spark.createDataFrame([(1, "c"), (2, "c"), (3, "c")], "id long, code string")
    judged = claims.verify(said, code_, lambda claim, code: verdicts[claim])
    assert sorted((r["id"], r["verdict"]) for r in judged.collect()) == [(1, "match"), (2, "mismatch"), (3, "unclear"), (4, "no_code_found")]
    assert [(r["id"], r["severity"]) for r in claims.drift_issues(judged).collect()] == [(2, "medium")]


def test_reindex_keeps_tags_by_hand(spark):
    tags = spark.createDataFrame([(1, "rule"), (1, "manual"), (2, "rule"), (3, "rule")], "id long, source string")
    changed = spark.createDataFrame([(1, "update"), (3, "insert")], "id long, op string")
    assert sorted(tuple(r) for r in incremental.keep_manual(tags, changed).collect()) == [(1, "manual"), (2, "rule"), (3, "rule")]
