from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import divergence
from sparkloom.llm.divergence import audit_sources, count_terms


def wanted(rows, least=3, ranks=200):
    """rows: (text, lang, source)."""
    uses, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        plain = (text or "").translate({c: c + 32 for c in range(65, 91)})
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", plain)
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        uses[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = sorted(s for x, s in groups if x == lang)

        def shares(counts, kept=kept):
            whole = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // whole for t in kept}

        p = {s: shares(uses[lang, s]) for s in mine}
        q = shares(sum((uses[lang, s] for s in mine), Counter()))
        for s in mine:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in mine if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if uses[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[:most])}
    return out


def table(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    return df.withColumns({c: F.lit("x") for c in ("term", "item", "value", "p", "q", "tid", "uses", "docs", "rank", "part", "doc_id")})


def got(df):
    rows = df.collect()
    assert len({(r["lang"], r["source"], r["part"], r["item"]) for r in rows}) == len(rows)
    return {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in rows}


def corpus(n=160, seed=3):
    r = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "éclair", "ß", "Éa", "日本", "x1y", "o'clock", "rare", *(f"w{chr(97 + i)}" for i in range(26))]
    out = [(None, None, None), ("", "", "s"), (" 12 \n --", "zz", "s"), ("only digits 1", "zz", None), ("İI", "en", "ü")]
    for _ in range(n):
        k = r.choice([1, 3, 20, 60])
        out.append((r.choice([" ", "\n", "-", "1"]).join(r.choices(words, k=k)), r.choice(["en", "en", "de", None]), r.choice(["hot", "hot", "b", "a", "B", None])))
    return out + out[20:24] * 2


def test_equals_brute_force(spark):
    rows = corpus()
    assert got(audit_sources(table(spark, rows).repartition(5))) == wanted(rows)
    assert got(audit_sources(table(spark, rows), least_docs=1, term_ranks=3)) == wanted(rows, 1, 3)


def test_language_without_kept_terms_has_pairs_of_zero(spark):
    rows = [("a b", "en", "s"), ("c", "en", "t"), (None, "en", None)]
    assert got(audit_sources(table(spark, rows))) == wanted(rows)
    assert {r[4] for r in wanted(rows)} == {0} and len(wanted(rows)) == 6


def test_empty_table(spark):
    assert audit_sources(table(spark, [])).count() == 0


def test_terms_given_in_parts_and_a_very_long_text(spark, monkeypatch):
    rows = [("ab CD é " * 50_000, "en", "s")] + [(f"ab w{chr(97 + i % 26)}x", "en", "t") for i in range(300)]
    assert got(audit_sources(table(spark, rows))) == wanted(rows)
    monkeypatch.setattr(divergence, "FLUSH", 3)
    from pyspark.sql.types import Row

    batches = table(spark, corpus()).select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text"))).toArrow().to_batches()
    some = Counter()
    for b in divergence._count(iter(b.slice(i, 7) for b in batches for i in range(0, b.num_rows, 7))):
        for r in b.to_pylist():
            some[r["lang"], r["source"], r["term"], "uses"] += r["uses"]
            some[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
    whole = Counter()
    for r in count_terms(table(spark, corpus())).collect():
        assert isinstance(r, Row)
        whole[r["lang"], r["source"], r["term"], "uses"] += r["uses"]
        whole[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
    assert some == whole


@pytest.mark.parametrize("uses", [8_999_999_999, 9_000_000_000, 2**62])
def test_shares_of_very_large_counts_are_exact(spark, uses):
    whole = 2**62 + 7
    row = spark.range(1).select(F.lit(uses).alias("u"), F.lit(whole).alias("n")).select(divergence._share("u", "n").alias("p")).head()
    assert row["p"] == 1 + 1_000_000_000 * (uses + 1) // whole
