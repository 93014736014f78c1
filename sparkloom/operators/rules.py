"""Rules over texts and paths: tags, findings and scores. Each rule is a literal predicate, so that its pattern is compiled
once and one pass over the texts serves all rules."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.incremental import upsert
from sparkloom.operators.similar import most_similar


class TagRule(NamedTuple):
    tag: str
    kind: str  # PATH, IMPORT, REGEX or SYMBOL
    pattern: str
    weight: float


#: A starter set; fixed values.
STARTER_TAGS = ("database", "auth", "api/http", "logging", "caching", "metrics", "payments")


def matches(rule: TagRule, path: Column, content: Column, symbol: Column) -> Column:
    """PATH: part of the path, IMPORT: an import line that names it, REGEX: in the content, SYMBOL: in the symbol's name."""
    if rule.kind == "PATH":
        return F.contains(path, F.lit(rule.pattern))
    if rule.kind == "IMPORT":
        return content.ilike(f"%import%{rule.pattern}%") | content.ilike(f"%from%{rule.pattern}%")
    return content.rlike("(?i)" + rule.pattern) if rule.kind == "REGEX" else symbol.rlike(rule.pattern)


def apply_tag_rules(entities: DataFrame, rules: Sequence[TagRule], key: str = "id") -> DataFrame:
    """id, path, content, symbol -> id, tag, confidence: the first rule of a tag that fits counts."""
    found = [F.when(matches(r, F.col("path"), F.col("content"), F.col("symbol")), F.struct(F.lit(i).alias("at"), F.lit(r.tag).alias("tag"), F.lit(r.weight).alias("confidence"))) for i, r in enumerate(rules)]
    each = entities.select(key, F.explode(F.array_compact(F.array(*found))).alias("r"))
    return each.groupBy(key, "r.tag").agg(F.min_by("r.confidence", "r.at").alias("confidence"))


#: Tags by place: globs (`**` crosses folders, `*` doesn't) or, behind `re:`, regular expressions; fixed values.
PATH_TAGS = (
    ("vendor", ("**/node_modules/**", "**/vendor/**", "**/third_party/**", "**/.venv/**", "**/venv/**", "**/site-packages/**")),
    ("generated", ("**/dist/**", "**/build/**", "**/*.min.js", "**/*.min.css", "**/bundle.js")),
    ("test", ("**/test/**", "**/tests/**", "**/__tests__/**", r"re:\.test\.(js|ts|py|go|java)$", r"re:\.spec\.(js|ts|py|go|java)$", r"re:_test\.(go|rs)$")),
)


def _place_regex(pattern: str) -> str:
    if pattern.startswith("re:"):
        return pattern[3:]
    return "^" + "".join(".*" if x == "**" else "[^/]*" if x == "*" else re.escape(x) for x in re.split(r"(\*\*|\*)", pattern)) + "$"


def auto_tags(files: DataFrame, tags: Sequence[tuple[str, Sequence[str]]] = PATH_TAGS, key: str = "id", path: str = "path") -> DataFrame:
    """key, tag: the tags of which a pattern fits a file's path, each once; a tag's patterns are one expression."""
    found = F.array(*(F.when(F.col(path).rlike("|".join(f"(?:{_place_regex(p)})" for p in patterns)), tag) for tag, patterns in tags))
    return files.select(key, F.explode(F.array_compact(found)).alias("tag"))


def tag_entities(tags: DataFrame, entities: DataFrame, tag: str, kind: str, source: str = "manual", confidence: float = 1.0, key: str = "id") -> DataFrame:
    """entity, id, tag, source, confidence with some entities tagged; a tag that an entity has is written anew."""
    new = entities.select(F.lit(kind).alias("entity"), F.col(key).alias("id"), F.lit(tag).alias("tag"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))
    return upsert(tags, new, ["entity", "id", "tag"])


def tag_files_with_chunks(tags: DataFrame, files: DataFrame, chunks: DataFrame, tag: str, key: str = "id", owner: str = "file_id") -> DataFrame:
    """Files are tagged, and their chunks with them."""
    own = chunks.join(files.select(F.col(key).alias(owner)), owner, "left_semi")
    return tag_entities(tag_entities(tags, files, tag, "file", key=key), own, tag, "chunk", key=key)


def entity_tags(tags: DataFrame, kind: str, id_: int) -> DataFrame:
    """The tags of an entity, the surest first."""
    return tags.where((F.col("entity") == kind) & (F.col("id") == id_)).select("tag", "source", "confidence").orderBy(F.desc("confidence"), "tag")


def list_features(features: DataFrame, prefix: str = "", most: int = 20, name: str = "name") -> DataFrame:
    return features.where(F.lower(name).startswith(prefix.lower())).select(name).distinct().orderBy(name).limit(most)


def validate_symbols(refs: DataFrame, symbols: DataFrame, near: float = 0.7, suggest_at: float = 0.3) -> DataFrame:
    """ref, confidence; name -> ref, status (valid, STALE_API or MISSING_SYMBOL), severity, match.

    The name is what stands before `(` and behind the last dot. It is valid if a symbol has it; else the most similar
    symbol by trigrams (ties by name) makes it an old name if it is closer than `near`, or is suggested from `suggest_at`.
    """
    name = F.element_at(F.split(F.element_at(F.split("ref", r"\("), 1), r"\."), -1)
    asked = refs.select("ref", "confidence", name.alias("asked")).distinct()
    known = symbols.select(F.col("name")).distinct()
    open_ = asked.select("asked").distinct().join(known, F.col("asked") == F.col("name"), "left_anti")
    best = most_similar(open_, known.withColumnRenamed("name", "best"), suggest_at, "asked", "best")
    out = asked.join(known.withColumnRenamed("name", "same"), F.col("asked") == F.col("same"), "left").join(best, "asked", "left")
    sim = F.col("similarity")
    status = F.when(F.col("same").isNotNull(), "valid").when(sim > near, "STALE_API").otherwise("MISSING_SYMBOL")
    severity = F.when(F.col("same").isNotNull(), F.lit(None)).when(sim > near, "info").when(F.col("confidence") > 0.8, "error").otherwise("warning")
    return out.select("ref", status.alias("status"), severity.alias("severity"), F.coalesce("same", "best").alias("match"))


def validate_imports(refs: DataFrame, files: DataFrame, symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """ref; path; name; content -> ref, status: valid (a module's file or a symbol), external (the first part of the name
    stands behind `import` in a line's text) or INVALID_IMPORT. All by equi-joins: words behind an import are exploded."""
    base = F.translate(F.col("ref"), ".", "/")
    asked = refs.select("ref").distinct().withColumn("root", F.lower(F.element_at(F.split("ref", r"\."), 1)))
    paths = asked.select("ref", F.explode(F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")), base)).alias("path"))
    by_file = paths.join(files.select("path").distinct(), "path", "left_semi").select("ref")
    by_symbol = asked.join(symbols.select(F.col("name").alias("ref")).distinct(), "ref", "left_semi").select("ref")
    behind = F.regexp_extract(F.lower("content"), r"(?s)import(.*)", 1)
    named = chunks.select(F.explode(F.array_distinct(F.regexp_extract_all(behind, F.lit(r"[a-z0-9_]+"), 0))).alias("root")).distinct()
    known = by_file.unionByName(by_symbol).distinct().withColumn("known", F.lit(True))
    out = asked.join(known, "ref", "left").join(named.withColumn("named", F.lit(True)), "root", "left")
    return out.select("ref", F.when(F.col("known"), "valid").when(F.col("named"), "external").otherwise("INVALID_IMPORT").alias("status"))


class MigrationRule(NamedTuple):
    id: str
    category: str
    severity: str
    pattern: str


#: Weights of a finding by our own rules (those of the whole rule set are in `migration`).
SEVERITY = {"critical": 20.0, "high": 10.0, "medium": 5.0, "low": 2.0, "info": 0.0}
CATEGORY = {"procedures": 1.5, "sql_dialect": 1.2, "drivers": 1.0, "schema": 1.3}
#: Upper bounds of the tiers.
TIERS = ((25, "low"), (50, "medium"), (75, "high"), (100, "extreme"))
#: Our own rules.
MIGRATION_RULES = (
    MigrationRule("connect-by", "sql_dialect", "high", r"(^|[^a-z])con[a-z]*"),
    MigrationRule("packages", "procedures", "critical", r"(^|[^a-z])the[a-z]* of"),
    MigrationRule("drivers", "drivers", "medium", r"(^|[^a-z])tion[a-z]*"),
    MigrationRule("types", "schema", "low", r"(^|[^a-z])ver[a-z]*"),
)


def findings(chunks: DataFrame, rules: Sequence[MigrationRule], k: int = 20, repo: str = "repo", key: str = "id", text: str = "content") -> DataFrame:
    """repo, rule, category, severity, n (evidence, at most k), evidence (ids): for each repository and rule with any."""
    hit = F.array_compact(F.array(*(F.when(F.col(text).rlike("(?i)" + r.pattern), F.struct(*(F.lit(v).alias(n) for n, v in zip(("rule", "category", "severity"), r, strict=False)))) for r in rules)))
    each = chunks.select(repo, key, F.explode(hit).alias("r")).select(repo, key, "r.*")
    w = Window.partitionBy(repo, "rule").orderBy(key)
    few = each.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k)
    return few.groupBy(repo, "rule", "category", "severity").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("evidence"))


def weight_of(table: dict[str, float], name: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[name], F.lit(default))


def tier(score: Column) -> Column:
    return reduce(lambda rest, t: F.when(score <= t[0], t[1]).otherwise(rest), reversed(TIERS), F.lit("extreme"))


def migration_score(found: DataFrame, repo: str = "repo") -> DataFrame:
    """Severity times category times a tenth of the evidence (2 at most), summed; whole, 100 at most."""
    one = weight_of(SEVERITY, F.col("severity"), 0.0) * weight_of(CATEGORY, F.col("category"), 1.0) * F.least(F.col("n") / 10, F.lit(2.0))
    score = F.least(F.lit(100), F.floor(F.sum(one))).cast("int")
    return found.groupBy(repo).agg(score.alias("score")).withColumn("tier", tier(F.col("score")))


#: Shares of the validity score's parts; fixed values.
WEIGHTS = {"reference": 0.55, "embedding": 0.30, "freshness": 0.15}
WEIGHTS_WITH_SEMANTIC = {"reference": 0.35, "embedding": 0.25, "freshness": 0.15, "semantic": 0.25}
LLM_WEIGHT = 0.20


def validity_score(parts: dict[str, Column]) -> Column:
    """Weighed sum of the parts given (llm takes a fifth from the others), times 100, rounded half to even, 0 to 100."""
    weights = dict(WEIGHTS_WITH_SEMANTIC if "semantic" in parts else WEIGHTS)
    if "llm" in parts:
        total = sum(weights.values())
        weights = {k: w * (1 - LLM_WEIGHT) / total for k, w in weights.items()} | {"llm": LLM_WEIGHT}
    score = reduce(lambda a, b: a + b, (F.lit(w) * parts[k] for k, w in weights.items()))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(score * 100).cast("int")))


def resolve_paths(refs: DataFrame, files: DataFrame, suggest_at: float = 0.3) -> DataFrame:
    """ref -> ref, how, path, similarity: exact, else the shortest path that ends in /ref (then by name), else as a
    suggestion the path most similar by trigrams (ties by path) from `suggest_at`, else missing. similarity is null but
    for suggestions.

    Suffixes of paths are exploded, so that the first two stages are equi-joins; the third is a set-similarity join of the
    references that are left.
    """
    parts = F.split("path", "/")
    tails = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("ref"))
    best = tails.groupBy("ref").agg(F.min(F.struct(F.length("path").alias("n"), "path")).alias("b"))
    exact = files.select(F.col("path").alias("ref"), F.col("path").alias("exact")).distinct()
    out = refs.select("ref").distinct().join(exact, "ref", "left").join(best, "ref", "left")
    left = out.where("exact IS NULL AND b IS NULL").select("ref")
    near = most_similar(left, files.select(F.col("path").alias("near")), suggest_at, "ref", "near")
    out = out.join(near, "ref", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("b").isNotNull(), "suffix").when(F.col("near").isNotNull(), "similar").otherwise("missing")
    return out.select("ref", how.alias("how"), F.coalesce("exact", "b.path", "near").alias("path"), "similarity")


class Tool(NamedTuple):
    name: str
    keywords: tuple[str, ...]


def suggest_tools(queries: DataFrame, tools: Sequence[Tool], text: str = "query", most: int = 3) -> DataFrame:
    """query -> query, tool, score (10 a keyword), confidence; the best `most` of each."""
    q = F.lower(F.col(text))
    scores = F.array(*(F.struct(F.lit(t.name).alias("tool"), reduce(lambda a, b: a + b, (F.when(F.contains(q, F.lit(k)), 10).otherwise(0) for k in t.keywords)).alias("score")) for t in tools))
    best = F.slice(F.array_sort(F.filter(scores, lambda s: s["score"] > 0), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["tool"] < b["tool"], -1).when(a["tool"] > b["tool"], 1).otherwise(0)), 1, most)
    return queries.select(text, F.explode(best).alias("s")).select(text, "s.tool", "s.score", F.when(F.col("s.score") >= 20, "high").otherwise("medium").alias("confidence"))


def usage_of_columns(columns: DataFrame, chunks: DataFrame) -> DataFrame:
    """column (name) and chunk (id, content) -> each line of a chunk that names a column: column, id, line, usage.

    Lines are split to words and meet the columns in an equi-join.
    """
    lines = chunks.select("id", F.posexplode(F.split("content", "\n")).alias("at", "s"))
    words = lines.select("id", (F.col("at") + 1).alias("line"), "s", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("s"), F.lit(r"[a-z_][a-z0-9_]*"), 0))).alias("word"))
    usage = F.when(F.col("s").rlike(r"(?i)\bwhere\b"), "filter").when(F.col("s").rlike(r"(?i)\bjoin\b"), "join").when(F.col("s").rlike(r"(?i)\b(insert|update|set)\b"), "write").otherwise("read")
    return words.join(F.broadcast(columns), words["word"] == F.lower(columns["column"])).select("column", "id", "line", usage.alias("usage")).distinct()
