"""What moving a code base to another database takes: which database it uses, what rules find in it, score and outline.

Patterns are written for the dialect of the fixed tables below, in which they are searched without regard to case, `.` meets
line ends, `\\y` is the border of a word and `^` and `$` are the ends of the text; `ported` writes them for Spark. All of them
run in one pass over the texts: each is a literal, so that it is compiled once, and stands behind a plain search of the
lower-cased text for the words that it needs, so that most texts meet few patterns.

Defined results: null texts and paths match nothing; a null repository is one like others; repositories without any mark have
no row; of equal scores the database first by name is taken.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.grams import regex_needs
from sparkloom.operators.rules import tier, weight_of
from sparkloom.session import settle


class Rule(NamedTuple):
    id: str
    source_db: str  # "" for all
    category: str
    severity: str
    title: str
    pattern: str


#: Weights of a finding; fixed values.
SEVERITY = {"info": 0.0, "low": 5.0, "medium": 15.0, "high": 30.0, "critical": 50.0}
CATEGORY = {"drivers": 0.5, "orm": 0.7, "sql_dialect": 1.0, "schema": 0.8, "procedures": 1.5, "transactions": 1.2, "nosql_patterns": 2.0, "ops": 0.6}

#: Marks of a database by kind; fixed values.
DETECTION = {
    "oracle": {
        "drivers": ("oracledb", "oracle", "cx_Oracle", "ojdbc", "oracle.jdbc"),
        "connection_patterns": ("jdbc:oracle", "oracle://", "@//.*:1521/"),
        "dialect_keywords": ("ROWNUM", "CONNECT BY", "NVL", "DECODE", "SYSDATE", "DUAL", "PL/SQL", "DBMS_"),
        "file_extensions": (".pls", ".pkb", ".pks"),
    },
    "sqlserver": {
        "drivers": ("mssql", "tedious", "pyodbc", "pymssql", "sqlserver", "com.microsoft.sqlserver"),
        "connection_patterns": ("jdbc:sqlserver", "mssql://", "Server=.*Database="),
        "dialect_keywords": ("NOLOCK", "READUNCOMMITTED", r"GO\s*$", "IDENTITY", "T-SQL", "sp_", "xp_"),
        "file_extensions": (".tsql",),
    },
    "mongodb": {
        "drivers": ("mongodb", "mongoose", "pymongo", "mongo-driver", "org.mongodb"),
        "connection_patterns": ("mongodb://", "mongodb+srv://"),
    },
    "mysql": {
        "drivers": ("mysql", "mysql2", "pymysql", "mysqldb", "mysql-connector"),
        "connection_patterns": ("jdbc:mysql", "mysql://"),
        "dialect_keywords": ("LIMIT.*OFFSET", "AUTO_INCREMENT", "TINYINT", "MEDIUMINT"),
    },
}
#: Points of a mark and how many of its kind are shown; fixed values. A score of 50 is certain.
POINTS = {"drivers": (10.0, "Driver: ", 3), "connection_patterns": (8.0, "Connection: ", 2), "dialect_keywords": (5.0, "Dialect: ", 5), "file_extensions": (15.0, "File: ", 3)}
#: Files of an ending that count.
FILES = 5

#: The rule set; fixed values.
RULE_SET = (
    Rule("COMMON_DYNAMIC_SQL", "", "sql_dialect", "medium", "Dynamic SQL execution", r"(?i)(EXECUTE|EXEC)\s+(IMMEDIATE|@|N?')"),
    Rule("COMMON_TRANSACTION", "", "transactions", "low", "Transaction management", r"(?i)(BEGIN\s+(TRAN|TRANSACTION)|COMMIT|ROLLBACK)"),
    Rule("ORACLE_DRIVER", "oracle", "drivers", "low", "Oracle driver usage", r"(?i)(import|require|using).*(oracledb|cx_Oracle|ojdbc)"),
    Rule("ORACLE_ROWNUM", "oracle", "sql_dialect", "medium", "ROWNUM pagination", r"\yROWNUM\y"),
    Rule("ORACLE_CONNECT_BY", "oracle", "sql_dialect", "high", "Hierarchical queries (CONNECT BY)", r"(?i)\yCONNECT\s+BY\y"),
    Rule("ORACLE_NVL", "oracle", "sql_dialect", "low", "NVL function", r"\yNVL\s*\("),
    Rule("ORACLE_DECODE", "oracle", "sql_dialect", "medium", "DECODE function", r"\yDECODE\s*\("),
    Rule("ORACLE_DUAL", "oracle", "sql_dialect", "low", "DUAL table usage", r"(?i)\yFROM\s+DUAL\y"),
    Rule("ORACLE_SYSDATE", "oracle", "sql_dialect", "low", "SYSDATE function", r"\ySYSDATE\y"),
    Rule("ORACLE_SEQUENCE_NEXTVAL", "oracle", "schema", "low", "Sequence NEXTVAL syntax", r"\w+\.NEXTVAL"),
    Rule("ORACLE_HINTS", "oracle", "sql_dialect", "medium", "Oracle optimizer hints", r"/\*\+.*\*/"),
    Rule("ORACLE_PLSQL_PACKAGE", "oracle", "procedures", "critical", "PL/SQL packages", r"(?i)\y(CREATE\s+(OR\s+REPLACE\s+)?PACKAGE|PACKAGE\s+BODY)\y"),
    Rule("ORACLE_DBMS_PACKAGE", "oracle", "procedures", "high", "Oracle DBMS_ package usage", r"\yDBMS_\w+"),
    Rule("ORACLE_AUTONOMOUS_TRANSACTION", "oracle", "transactions", "critical", "Autonomous transactions", r"(?i)PRAGMA\s+AUTONOMOUS_TRANSACTION"),
    Rule("ORACLE_MERGE", "oracle", "sql_dialect", "medium", "MERGE statement", r"(?i)\yMERGE\s+INTO\y"),
    Rule("SQLSERVER_DRIVER", "sqlserver", "drivers", "low", "SQL Server driver usage", r"(?i)(import|require|using).*(mssql|tedious|pyodbc|pymssql)"),
    Rule("SQLSERVER_NOLOCK", "sqlserver", "sql_dialect", "medium", "WITH (NOLOCK) hint", r"(?i)WITH\s*\(\s*NOLOCK\s*\)"),
    Rule("SQLSERVER_TOP", "sqlserver", "sql_dialect", "low", "TOP clause", r"(?i)\ySELECT\s+TOP\s+\d+"),
    Rule("SQLSERVER_IDENTITY", "sqlserver", "schema", "low", "IDENTITY columns", r"(?i)\yIDENTITY\s*\("),
    Rule("SQLSERVER_GO", "sqlserver", "schema", "low", "GO batch separator", r"(?i)^\s*GO\s*$"),
    Rule("SQLSERVER_SQUARE_BRACKETS", "sqlserver", "sql_dialect", "low", "Square bracket identifiers", r"\[\w+\]"),
    Rule("SQLSERVER_STORED_PROC", "sqlserver", "procedures", "high", "T-SQL stored procedures", r"(?i)\yCREATE\s+(OR\s+ALTER\s+)?PROC(EDURE)?\y"),
    Rule("SQLSERVER_SP_EXECUTESQL", "sqlserver", "procedures", "medium", "sp_executesql dynamic SQL", r"(?i)\ysp_executesql\y"),
    Rule("SQLSERVER_TEMP_TABLE", "sqlserver", "sql_dialect", "low", "Temporary table syntax", r"#\w+"),
    Rule("SQLSERVER_TRY_CATCH", "sqlserver", "procedures", "medium", "TRY...CATCH blocks", r"(?i)\y(BEGIN\s+TRY|BEGIN\s+CATCH)\y"),
    Rule("SQLSERVER_OUTPUT_PARAM", "sqlserver", "procedures", "medium", "OUTPUT parameters", r"(?i)\yOUTPUT\y"),
    Rule("MONGODB_DRIVER", "mongodb", "drivers", "low", "MongoDB driver usage", r"(?i)(import|require|using).*(mongodb|mongoose|pymongo)"),
    Rule("MONGODB_AGGREGATION", "mongodb", "nosql_patterns", "critical", "MongoDB aggregation pipeline", r"\$match|\$group|\$lookup|\$unwind|\$project"),
    Rule("MONGODB_EMBEDDED_DOCS", "mongodb", "nosql_patterns", "high", "Embedded documents pattern", r"(insertOne|insertMany|updateOne|updateMany).*\{.*\{.*\}"),
    Rule("MONGODB_ARRAY_FIELDS", "mongodb", "nosql_patterns", "medium", "Array field usage", r"\$push|\$pull|\$addToSet|\$pop"),
    Rule("MONGODB_TEXT_SEARCH", "mongodb", "nosql_patterns", "medium", "MongoDB text search", r"\$text"),
    Rule("MONGODB_GEO_QUERIES", "mongodb", "nosql_patterns", "high", "Geospatial queries", r"\$near|\$geoWithin|\$geoIntersects"),
    Rule("MONGODB_SCHEMA_LESS", "mongodb", "nosql_patterns", "critical", "Schema-less design", r"(?i)(collection|insertOne|insertMany)"),
    Rule("MYSQL_DRIVER", "mysql", "drivers", "low", "MySQL driver usage", r"(?i)(import|require|using).*(mysql|mysql2|pymysql)"),
    Rule("MYSQL_LIMIT_OFFSET", "mysql", "sql_dialect", "low", "LIMIT with OFFSET", r"(?i)\yLIMIT\s+\d+\s*,\s*\d+"),
    Rule("MYSQL_AUTO_INCREMENT", "mysql", "schema", "low", "AUTO_INCREMENT columns", r"(?i)\yAUTO_INCREMENT\y"),
    Rule("MYSQL_BACKTICKS", "mysql", "sql_dialect", "low", "Backtick identifiers", r"`\w+`"),
)


def ported(pattern: str) -> str:
    """A pattern of the tables above for Spark (and other engines that know `\\b` and `\\z`)."""
    out = re.sub(r"\\y", r"\\b", pattern.removeprefix("(?i)"))
    return "(?is)" + re.sub(r"(?<!\\)\$", r"\\z", out)


def mark_pattern(kind: str, mark: str) -> str:
    """Drivers stand behind an import, words of a dialect between borders; connections are patterns as they are."""
    if kind == "drivers":
        return ported("(import|require|using).*" + re.escape(mark))
    return ported(rf"\y{mark}\y" if kind == "dialect_keywords" else mark)


def marks(detection: dict = DETECTION) -> list[tuple[str, str, int, str]]:
    """db, kind, place within the kind, mark: all that are searched in texts."""
    return [(db, kind, i, m) for db, kinds in detection.items() for kind, ms in kinds.items() if kind != "file_extensions" for i, m in enumerate(ms)]


def found_in(text: Column, low: Column, pattern: str) -> Column:
    """Whether a ported pattern is found in a text; `low` is the text in lower case. The longest words it needs come first."""
    needs = sorted(regex_needs(pattern), key=lambda some: -min(map(len, some)))
    gates = [reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in sorted(some))) for some in needs]
    return reduce(Column.__and__, [*gates, text.rlike(pattern)])


_SPOT = "struct<db string, kind string, at int, what string>"


def _spot(db: str, kind: str, at: int, what: Column) -> Column:
    return F.struct(F.lit(db).alias("db"), F.lit(kind).alias("kind"), F.lit(at).alias("at"), what.alias("what")).cast(_SPOT)


def _marks_in(text: Column, low: Column, detection: dict) -> Column:
    return F.array_compact(F.array(*(F.when(found_in(text, low, mark_pattern(kind, m)), _spot(db, kind, i, F.lit(m))) for db, kind, i, m in marks(detection))))


def _rules_in(text: Column, low: Column, rules: Sequence[Rule]) -> Column:
    return F.array_compact(F.array(*(F.when(found_in(text, low, ported(r.pattern)), F.struct(F.lit(i).alias("at"), F.lit(r.source_db).alias("own"))) for i, r in enumerate(rules))))


def _excerpt(text: Column) -> Column:
    return F.substring(F.array_join(F.slice(F.split(text, "\n"), 1, 5), "\n"), 1, 500)


def _shown(found: str, kind: str) -> Column:
    _, label, most = POINTS[kind]
    return F.transform(F.slice(F.filter(found, lambda x: x["kind"] == kind), 1, most), lambda x: F.concat(F.lit(label), x["what"]))


def detect(chunks: DataFrame, files: DataFrame, detection: dict = DETECTION, repo: str = "repo", text: str = "content", path: str = "path") -> DataFrame:
    """repo, db, score, confidence (a fiftieth of the score, 1 at most), evidence: a driver found counts 10, a connection 8, a
    word of the dialect 5, a file with an ending of the database 15 (of each ending the first five by path)."""
    low = chunks.select(F.col(repo).alias("repo"), F.col(text).alias("content"), F.lower(text).alias("low"))
    return _detected(low.select("repo", F.explode(_marks_in(F.col("content"), F.col("low"), detection)).alias("m")), files, detection, repo, path)


def _detected(spots: DataFrame, files: DataFrame, detection: dict, repo: str, path: str) -> DataFrame:
    seen = spots.select("repo", "m.*").distinct()
    ends = [(db, i, e) for db, kinds in detection.items() for i, e in enumerate(kinds.get("file_extensions", ()))]
    own = F.array(*(F.when(F.endswith(F.col(path), F.lit(e)), _spot(db, "file_extensions", i, F.col(path))) for db, i, e in ends))
    of_files = files.select(F.col(repo).alias("repo"), F.explode(F.array_compact(own)).alias("m")).select("repo", "m.*").distinct()
    first = F.row_number().over(Window.partitionBy("repo", "db", "at").orderBy("what"))
    all_ = seen.unionByName(of_files.withColumn("n", first).where(F.col("n") <= FILES).drop("n"))
    kinds = list(POINTS)
    points = F.create_map(*(F.lit(x) for k in kinds for x in (k, POINTS[k][0])))
    #: a few dozen marks a repository at most
    each = all_.groupBy("repo", "db").agg(F.sum(points[F.col("kind")]).alias("score"), F.array_sort(F.collect_list(F.struct("kind", "at", "what"))).alias("m"))
    shown = F.flatten(F.array(*(_shown("m", k) for k in kinds)))
    return each.select("repo", "db", "score", F.least(F.lit(1.0), F.col("score") / 50).alias("confidence"), shown.alias("evidence"))


def likeliest(detected: DataFrame) -> DataFrame:
    """repo, db: the database with the highest confidence."""
    return detected.groupBy("repo").agg(F.min_by("db", F.struct(-F.col("confidence"), F.col("db"))).alias("db"))


def findings(chunks: DataFrame, databases: DataFrame, rules: Sequence[Rule] = RULE_SET, k: int = 50, key: str = "id") -> DataFrame:
    """repo, id, path, content of chunks and repo, db -> repo, rule, source_db, category, severity, title, n (evidence, at most
    k), evidence (id, path, excerpt; by id): the rules for all databases and those of the repository's own. Repositories
    without a database meet the rules for all. The excerpt is five lines, 500 characters at most."""
    low = chunks.select("repo", key, "path", "content", F.lower("content").alias("low"))
    each = low.select("repo", key, "path", F.explode(_rules_in(F.col("content"), F.col("low"), rules)).alias("r"), _excerpt(F.col("content")).alias("excerpt"))
    return _findings(each, databases, rules, k, key)


def _findings(hits: DataFrame, databases: DataFrame, rules: Sequence[Rule], k: int, key: str) -> DataFrame:
    each = hits.select("repo", key, "path", "excerpt", "r.*")
    used = F.broadcast(databases.select(F.col("repo").alias("__repo"), "db"))
    each = each.join(used, F.col("repo").eqNullSafe(F.col("__repo")), "left").where((F.col("own") == "") | (F.col("own") == F.col("db")))
    w = Window.partitionBy("repo", "at").orderBy(key, "path")
    few = each.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    rows = few.groupBy("repo", "at", "db").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(key, "path", "excerpt"))).alias("evidence"))
    what = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("rule", "source_db", "category", "severity", "title"), r[:5], strict=True))) for r in rules))
    named = rows.withColumn("w", what[F.col("at")])
    own = F.when(F.col("w.source_db") == "", F.coalesce("db", F.lit("unknown"))).otherwise(F.col("w.source_db"))
    return named.select("repo", "w.rule", own.alias("source_db"), "w.category", "w.severity", "w.title", "n", "evidence")


def assess(chunks: DataFrame, files: DataFrame, detection: dict = DETECTION, rules: Sequence[Rule] = RULE_SET, k: int = 50, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """What `detect` gives, and the findings for each repository's likeliest database. The texts are read once: marks and rules
    found in them are settled, without the texts."""
    low = chunks.select("repo", key, "path", "content", F.lower("content").alias("low"))
    text = (F.col("content"), F.col("low"))
    hits = F.transform(_rules_in(*text, rules), lambda r: F.struct(r["own"].alias("db"), F.lit("rule").alias("kind"), r["at"].alias("at"), F.lit("").alias("what")).cast(_SPOT))
    #: one array is exploded, as a filter by two would work both out again
    seen = low.select("repo", key, "path", _excerpt(F.col("content")).alias("excerpt"), F.explode(F.concat(_marks_in(*text, detection), hits)).alias("m"))
    seen = settle(seen)
    detected = _detected(seen.where("m.kind <> 'rule'").select("repo", "m"), files, detection, "repo", "path")
    ruled = seen.where("m.kind = 'rule'").select("repo", key, "path", "excerpt", F.struct("m.at", F.col("m.db").alias("own")).alias("r"))
    return detected, _findings(ruled, likeliest(detected), rules, k, key)


def score(found: DataFrame) -> DataFrame:
    """repo, score, tier: severity times category times a tenth of the evidence (2 at most), summed; whole, 100 at most."""
    one = weight_of(SEVERITY, F.col("severity"), 0.0) * weight_of(CATEGORY, F.col("category"), 1.0) * F.least(F.col("n") / 10, F.lit(2.0))
    whole = F.least(F.lit(100), F.floor(F.round(F.sum(one), 6))).cast("int")
    return found.groupBy("repo").agg(whole.alias("score")).withColumn("tier", tier(F.col("score")))


#: Order of severities and closing sentences of a summary by tier; fixed values.
ORDER = ("critical", "high", "medium", "low", "info")
CLOSING = {
    "low": "Straightforward migration with mostly mechanical changes.",
    "medium": "Moderate complexity requiring careful planning and testing.",
    "high": "Significant refactoring needed across multiple areas.",
    "extreme": "Major undertaking requiring substantial architecture changes.",
}


def blockers(found: DataFrame, most: int = 10) -> DataFrame:
    """repo, place, rule, title, severity, category, n: the gravest findings of a repository, then those with the most evidence."""
    grade = F.array_position(F.array(*map(F.lit, ORDER)), F.col("severity"))
    place = F.row_number().over(Window.partitionBy("repo").orderBy(grade, F.desc("n"), "rule"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("repo", "place", "rule", "title", "severity", "category", "n")


def summary(found: DataFrame) -> DataFrame:
    """repo, score, tier, summary: one paragraph a repository with findings."""
    count = found.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    closing = F.create_map(*(F.lit(x) for kv in CLOSING.items() for x in kv))[F.col("tier")]
    text = F.format_string("Migration complexity: %s (score: %d/100). Found %d issues: %d critical, %d high severity. %s", F.upper("tier"), "score", "n", "critical", "high", closing)
    both = score(found).alias("s").join(count.alias("c"), F.col("s.repo").eqNullSafe(F.col("c.repo")))
    return both.select("s.repo", "score", "tier", text.alias("summary"))
