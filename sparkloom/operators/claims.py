"""Claims of documents, held against code: extraction and judgement are injected functions (a language model, or rules)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICTS = ("match", "mismatch", "unclear", "no_code_found")
CLAIM = "claim string, topic string, expected string, kind string, confidence double"


def parse_json(text: str):
    """The JSON value of a reply: the whole of it, what stands in a fenced block, or the outermost array or object; else None."""

    def tried(some: str):
        try:
            return json.loads(some)
        except ValueError:
            return None

    found = tried(text.strip())
    if found is None and (fence := re.search(r"```\w*\s*(.*?)```", text, re.S)):
        found = tried(fence[1].strip())
    for first, last in ("[]", "{}"):
        if found is None and 0 <= text.find(first) < text.rfind(last):
            found = tried(text[text.find(first) : text.rfind(last) + 1])
    return found


def claims_of(docs: DataFrame, ask: Callable[[str], str], most: int = 50, least: float = 0.7, key: str = "id", text: str = "content") -> DataFrame:
    """key, content -> key and the claims that `ask` replies for a text, as JSON: an array, an object with `claims`, or one
    claim. Claims without text or below `least` confidence go, of each document `most` come; replies that are no JSON give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for id_, content in zip(df[key], df[text], strict=True):
                reply = parse_json(ask(content or ""))
                reply = reply.get("claims", [reply] if "claim_text" in reply else []) if isinstance(reply, dict) else reply
                for c in (reply if isinstance(reply, list) else [])[:most]:
                    sure = float(c.get("confidence") or 0.0)
                    if c.get("claim_text") and sure >= least:
                        value = c.get("expected_value")
                        rows.append((id_, str(c["claim_text"]), str(c.get("topic") or "unknown"), None if value is None else str(value), c.get("value_type"), sure))
            yield pd.DataFrame(rows, columns=[key, *(x.split()[0] for x in CLAIM.split(", "))])

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, {CLAIM}")


def same_value(a: Column, b: Column) -> Column:
    """Whether two values are one number, whatever stands around it, or the same text."""
    number = lambda x: F.regexp_extract(x, r"(-?[0-9]+(?:\.[0-9]+)?)", 1)
    return (F.lower(F.trim(a)) == F.lower(F.trim(b))) | ((number(a) != "") & (number(a).try_cast("double") == number(b).try_cast("double")))


def verify(claims: DataFrame, evidence: DataFrame, judge: Callable[[str, str], str], key: str = "id") -> DataFrame:
    """key, claim, expected; key, code -> also verdict, sureness, actual. `judge` replies for a claim and its evidence; a
    claim without evidence found no code, a reply that is no JSON is unclear, and a mismatch of equal values is a match."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for claim, code in zip(df["claim"], df["code"], strict=True):
                reply = parse_json(judge(claim, code)) if isinstance(code, str) else {"verdict": "no_code_found"}
                reply = reply if isinstance(reply, dict) else {}
                verdict = reply.get("verdict", "unclear")
                actual = reply.get("actual_value")
                out.append((verdict if verdict in VERDICTS else "unclear", float(reply.get("confidence") or 0.0), None if actual is None else str(actual)))
            yield pd.concat([df.drop(columns=["code"]).reset_index(drop=True), pd.DataFrame(out, columns=["verdict", "sureness", "actual"])], axis=1)

    joined = claims.join(evidence.select(key, "code"), key, "left")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in claims.schema.fields)
    judged = joined.mapInPandas(run, f"{kinds}, verdict string, sureness double, actual string")
    return judged.withColumn("verdict", F.when((F.col("verdict") == "mismatch") & same_value(F.col("expected"), F.col("actual")), "match").otherwise(F.col("verdict")))


def drift_issues(verified: DataFrame) -> DataFrame:
    """Mismatches, with a severity by how sure they are."""
    sure = F.col("sureness")
    return verified.where("verdict = 'mismatch'").withColumn("severity", F.when(sure >= 0.9, "high").when(sure >= 0.7, "medium").otherwise("low"))


_LIMIT = re.compile(r"[^.\n]*\b(?:max(?:imum)?|at most|up to|limit(?: is| of)?|at least|minimum)\b[^.\n]*?\b(\d+)(%?)[^.\n]*", re.I)


def limits_of(text: str) -> str:
    """An offline stand-in for a model: sentences that name a limit and a number, as a reply."""
    found = [{"claim_text": m[0].strip(), "topic": "limit", "expected_value": m[1] + m[2], "value_type": "percentage" if m[2] else "number", "confidence": 0.9} for m in _LIMIT.finditer(text)]
    return "```json\n" + json.dumps(found) + "\n```"


def compare_numbers(claim: str, code: str) -> str:
    """An offline stand-in for a judge: the number behind a comparison in the code against that of the claim."""
    said, done = re.search(r"\d+", claim), re.search(r"[<>=]=?\s*(\d+)", code)
    if not said or not done:
        return "no verdict"
    return json.dumps({"verdict": "match" if said[0] == done[1] else "mismatch", "confidence": 0.95 if "throw" in code else 0.75, "actual_value": done[1]})
