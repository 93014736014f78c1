from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm.rules import RULES, STOP_WORDS, Rule, apply_rules, measure

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def wanted(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    bare = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_ellipsis_lines": sum(x.endswith(("...", "…")) for x in bare),
        "n_bullet_lines": sum(x.startswith(("-", "*", "•")) for x in bare),
        "n_stop_words": sum(w.lower() in STOP_WORDS for w in words),
        "n_repeat_words": len(hit),
    }


def fails(n, rule):
    under = n[rule.under] if rule.under else 1
    return rule.least is not None and rule.per * n[rule.top] < rule.least * under or rule.most is not None and rule.per * n[rule.top] > rule.most * under


def hold(spark, texts):
    df = spark.createDataFrame([(i if i % 7 else None, x) for i, x in enumerate(texts)], "doc_id long, text string")
    df = df.withColumns({c: F.lit("x") for c in ("held", "words", "lines", "hashes", "n_words", "kept", "failed", "a", "i")})
    rows = apply_rules(measure(df)).collect()
    assert len(rows) == len(texts)
    seen = sorted((tuple(sorted(r.asDict().items(), key=lambda x: x[0])) for r in rows), key=repr)
    want = []
    for i, x in enumerate(texts):
        n = wanted(x)
        failed = [r.name for r in RULES if fails(n, r)]
        want.append(n | {"doc_id": i if i % 7 else None, "failed": failed, "kept": not failed, "base_failed": n["n_words"] < 50 or 100 * n["n_repeat_words"] > 50 * n["n_words"]})
    assert seen == sorted((tuple(sorted(w.items(), key=lambda x: x[0])) for w in want), key=repr)


def test_counts_and_rules_of_a_corpus(spark, corpus):
    hold(spark, corpus)


def test_edges_and_random_texts(spark):
    r = random.Random(2)
    texts = [None, "", " ", "a", "a b", "a b c", "a b c a b c", "x x x x", "a\n\na\n a\na\n", "#|<>\n…\n- a...\n• b", "a\x1fb\x85c d e", "🙂 é #🙂#", "a\r\nb\r\nb\r\n", "the THE The"]
    texts += ["".join(r.choice("ab \n\t#.-é") for _ in range(r.randint(0, 120))) for _ in range(150)]
    texts += [" ".join(r.choice("abcdefgh") for _ in range(r.randint(40, 90))) for _ in range(40)]
    hold(spark, texts + texts[:20])


def test_very_long_text(spark):
    hold(spark, ["the word " * 150_000, " ".join(f"w{i}" for i in range(200_000))])


def test_empty_table(spark):
    assert apply_rules(measure(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


@pytest.mark.parametrize("rule", [Rule("r", "n_words", None, 1, 3, 5), Rule("r", "n_words", "n_lines", 2, None, 7), Rule("r", "n_words", "n_lines", 10, 15, None, True)])
def test_a_rule_of_ones_own(spark, rule):
    texts = ["a " * k + "\n" + "b\n" * m for k in range(8) for m in range(4)]
    df = measure(spark.createDataFrame([(t,) for t in texts], "text string"), keep=())
    for r in apply_rules(df, [rule]).collect():
        assert r["kept"] == (not fails(r.asDict(), rule)) and r["base_failed"] == (rule.base and not r["kept"])


def test_one_projection_without_python_or_shuffle(spark, sf_dir):
    plan = apply_rules(measure(spark.read.parquet(f"{sf_dir}/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
