"""Search by trigrams against the scan, what patterns need, and how much is read."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.operators import grams


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    words = ["tion", "Shall", "wor_th", "ÉCLAIR", "ß", "the", "x%y", "abcabc", "ΣΑΣ", "日本語", "İi", "a\nb", "100%", "under_score"]
    out = [" ".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(300)]
    return out + [None, "", "ab", "abc", "ABC", "needle in here", "NEEDLE", "nee dle", "abcab cabc", "Kelvin", "éclair"]


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string").repartition(3)
    return grams.write_grams(df, str(tmp_path_factory.mktemp("grams")), parts=16)


@pytest.fixture(scope="module")
def scan(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, content string").cache()


LIKES = ["%tion%shall%", "%needle%", "need%", "%\\_score%", "%100\\%%", "%éclair%", "%ß%", "ab", "%", "%zzzzz%", "%abcab_cabc%", "%日本%", "%k%elvin%", "%i̇i%"]
REGEXES = ["tion.*Shall", "(?i)needle", "(?i)(needle|shall|éclair)", "^abc$", "(abc)+", "x[%]y|wor_th", "(?:ab|nee)c?", "[a-c]{3}", "the|.", "(?=tion)t", "a\\nb", "under_(score|line)", "\\p{L}+", "ΣΑΣ", "(?i)ABC(?!a)", "日本語 (tion|the)", "(?i)σας", "t(io){1,2}n", "zzzz", "(?x) a b c"]


@pytest.mark.parametrize("pattern", LIKES)
def test_like_equals_the_scan(spark, index, scan, pattern):
    want = {r["id"] for r in scan.where(F.col("content").ilike(pattern)).collect()}
    assert sorted(r["id"] for r in grams.search_like(spark, index, pattern).collect()) == sorted(want)


@pytest.mark.parametrize("pattern", REGEXES)
def test_regex_equals_the_scan(spark, index, scan, pattern):
    want = {r["id"] for r in scan.where(F.col("content").rlike(pattern)).collect()}
    assert sorted(r["id"] for r in grams.search_regex(spark, index, pattern).collect()) == sorted(want)


def test_words_and_rules_equal_the_scan(spark, index, scan):
    for words in (["needle", "SHALL"], ["zz"], ["ß", "needle"], [], ["éclair"]):
        want = {r["id"] for r in scan.collect() if r["content"] is not None and any(w.lower() in r["content"].lower() for w in words)}
        assert {r["id"] for r in grams.search_words(spark, index, words).collect()} == want
    rules = [("a", "LIKE", "%Shall%"), ("b", "ILIKE", "%shall%"), ("c", "REGEX", "(?i)tion .*the"), ("d", "REGEX", "."), ("e", "LIKE", "a_"), ("f", "REGEX", "nothing here")]
    fits = {"LIKE": lambda p: F.col("content").like(p), "ILIKE": lambda p: F.col("content").ilike(p), "REGEX": lambda p: F.col("content").rlike(p)}
    want = {(n, r["id"]) for n, k, p in rules for r in scan.where(fits[k](p)).collect()}
    assert {(r["rule"], r["id"]) for r in grams.match_rules(spark, index, rules).collect()} == want


def test_only_candidates_are_read(spark, index, texts):
    #: the candidates hold the literal, in the order that a substring has, though grams of it stand elsewhere, too
    got = {r["key"] for r in grams.candidates(spark, index, grams.like_needs("%needle%")).collect()}
    assert got == {i for i, x in enumerate(texts) if x and "needle" in x.lower()}
    assert {r["key"] for r in grams.candidates(spark, index, grams.like_needs("%abcabc%")).collect()} == {i for i, x in enumerate(texts) if x and "abcabc" in x.lower()}
    read = grams.texts_of(spark, index, grams.like_needs("%needle%"))
    assert read.count() == len(got)
    want = {r["p"] for r in spark.createDataFrame([(k,) for k in got], "key long").select(F.pmod(F.xxhash64("key"), F.lit(16)).alias("p")).collect()}
    filters = re.search(r"PartitionFilters: \[[^\]]*part#\d+ (?:IN \(([\d,]+)\)|= (\d+))", read._jdf.queryExecution().executedPlan().toString())
    assert {int(x) for x in (filters[1] or filters[2]).split(",")} == want and len(want) < 16
    assert grams.candidates(spark, index, grams.regex_needs("a.b")) is None


def test_postings_have_every_place(spark, index, texts):
    want = {}
    for i, x in enumerate(texts):
        b = (x or "").lower().encode()
        for at in range(len(b) - 2):
            want.setdefault((b[at] << 16 | b[at + 1] << 8 | b[at + 2], i), []).append(at)
    rows = spark.read.parquet(f"{index.path}/postings").collect()
    plain = {(r["gram"], r["key"]): r["places"] for r in rows if "Σ" not in (texts[r["key"]] or "")}
    assert len(rows) == len({(r["gram"], r["key"]) for r in rows})
    assert plain == {k: v for k, v in want.items() if "Σ" not in (texts[k[1]] or "")}


def test_empty_table_nulls_and_repeated_keys(spark, tmp_path):
    none = grams.write_grams(spark.createDataFrame([(None, "needle"), (3, None)], "id long, content string"), str(tmp_path / "a"))
    assert grams.search_like(spark, none, "%needle%").count() == 0 and grams.search_regex(spark, none, ".").count() == 0
    twice = grams.write_grams(spark.createDataFrame([(1, "a needle"), (1, "none"), (1, "a needle"), (2, "x")], "id long, content string"), str(tmp_path / "b"))
    assert [r["id"] for r in grams.search_like(spark, twice, "%needle%").collect()] == [1, 1]


def test_what_patterns_need():
    n = lambda *sets: [frozenset(s) for s in sets]
    assert grams.regex_needs("foo(bar)baz.qux+") == n(["foobarbaz"], ["qu"], ["x"])
    assert grams.regex_needs("(?i)(LICENSE|token)s?") == n(["license", "token"])
    assert grams.regex_needs("(a|b*)c") == n(["c"]) and grams.regex_needs("(") == [] and grams.regex_needs("x*") == []
    assert grams.like_needs("%a\\%b%c_d%") == n(["a%b"], ["c"], ["d"])


_pattern = st.recursive(st.text("abc", min_size=1, max_size=3) | st.sampled_from([".", "[ab]", "[^c]", "\\b", "^", "a?"]), lambda x: st.builds(lambda a, b: a + b, x, x) | st.builds(lambda a, b: f"(?:{a}|{b})", x, x) | st.builds(lambda a, q: f"({a}){q}", x, st.sampled_from(["?", "*", "+", "{2}"])), max_leaves=8)


@settings(max_examples=400, deadline=None)
@given(_pattern, st.text("abc ", max_size=12))
def test_a_match_holds_what_its_pattern_needs(pattern, text):
    if re.search(pattern, text):
        assert all(any(x in text for x in some) for some in grams.regex_needs(pattern))
