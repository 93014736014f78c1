"""Re-ranking of found texts and files, and how they are cited."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a path that make it a test; fixed values.
TEST_MARKS = ("/tests/", "/test/", "/__tests__/", ".test.", ".spec.", "_test.", "_spec.", "test_", "spec_")
#: Marks of code that enforces something, each one signal; fixed values.
ENFORCING = (r">= \d+", r"<= \d+", r"Math\.min\s*\(", r"Math\.max\s*\(", r"\bmin\s*\(", r"\bmax\s*\(", r"return\s*\{.*error", r"throw\s+new\s+Error")
#: Messages about limits, one signal together; fixed values.
LIMIT_MESSAGES = (r"maximum\s+\w+", r"already\s+has", r"limit\s+reached", r"exceeded", r"too\s+many")
#: Where an expected number {n} stands if it is enforced, two signals together; fixed values.
EXPECTED = (r">= {n}\b", r"<= {n}\b", r"> {n}\b", r"< {n}\b", r"== {n}\b", r"\b{n}\s*\)", r"maximum.*{n}", r"limit.*{n}")


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def is_test(path: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(path), F.lit(m)) for m in TEST_MARKS))


def enforcement_score(score: Column, path: Column, content: Column, words: Sequence[str] = (), expected: str = "") -> Column:
    """Scores of results for a claim: tests count half, scripts 0.7, services 1.1; each signal of enforcement adds 15 %,
    each word of the claim 0.02."""
    any_of = lambda patterns: content.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)).cast("int")
    lower = F.lower(path)
    place = F.when(is_test(path), 0.5).when(lower.contains("/scripts/"), 0.7).when(lower.contains("service"), 1.1).otherwise(1.0)
    numbers = re.findall(r"\d+", expected)
    signals = [content.rlike("(?i)" + p).cast("int") for p in ENFORCING] + [any_of(LIMIT_MESSAGES)]
    if numbers:
        signals.append(2 * any_of([p.replace("{n}", n) for n in numbers for p in EXPECTED]))
    known = _sum([F.contains(F.lower(content), F.lit(w)).cast("int") for w in sorted({x for w in words for x in w.lower().split()})])
    return score * place * (1 + _sum(signals) * 0.15) + known * 0.02


def evidence_priority(path: Column) -> Column:
    """Services before configuration, entities and models, other code; tests last."""
    lower = F.lower(path)
    return F.when(is_test(path), 10).when(lower.contains("/services/"), 0).when(lower.contains("/config/"), 1).when(lower.contains("/entities/") | lower.contains("/models/"), 2).otherwise(3)


def key_files(lists: Sequence[tuple[DataFrame, float]], path: str = "path", score: str = "score", tie: str = "id") -> DataFrame:
    """Files by the sum of score * (results from here to the list's end) * weight over several ranked lists."""
    parts = []
    for results, weight in lists:
        w = Window.orderBy(F.desc(score), tie)  # a list is a top-k
        left = results.withColumn("__left", F.count("*").over(Window.partitionBy()) - F.row_number().over(w) + 1)
        parts.append(left.select(F.col(path).alias("path"), (F.col(score) * F.col("__left") * weight).alias("score")))
    return reduce(DataFrame.unionByName, parts).groupBy("path").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "path")


def citation(source: Column, sections: Column, page: Column) -> Column:
    """Source, path of sections and page, as far as there are any."""
    path = F.when(F.size(F.coalesce(sections, F.array())) > 0, F.array_join(sections, " > "))
    return F.concat_ws(", ", F.coalesce(source, F.lit("Unknown")), path, F.when(page > 0, F.concat(F.lit("Page "), page.cast("string"))))
