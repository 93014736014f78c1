"""English search: stems, cover density and the index, against hand-computed values and brute force."""

from __future__ import annotations

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import stem
from sparkloom.operators import fulltext as ft

#: Words and their stems, from the published description of the stemmer.
PAIRS = """consign consigned:consign consigning:consign consignment:consign consist consisted:consist consistency:consist consistently:consist
consolation:consol console:consol consolidate:consolid conspicuous:conspicu conspicuously:conspicu conspiracy:conspiraci conspirator:conspir constable:constabl
constance:constanc constancy:constanc constantly:constant knackeries:knackeri knaves:knave knavish kneaded:knead kneels:kneel knees:knee knightly:knight knitted:knit
knives:knive knobs:knob knockers:knocker knopp knotted:knot generate:generat generously:generous generalization:general communism communities:communiti communication:communic
running:run relational:relat conditional:condit rational:ration hopping:hop hoping:hope skies:sky dying:die news inning innings:inning cats:cat ties:tie cries:cri gas this gaps:gap kiwis:kiwi
by say cry:cri enjoy fluently:fluentli probate:probat rate cease:ceas controll:control roll sensational:sensat happiness:happi hopefulness:hope formality:formal electrical:electr goodness:good
adoption:adopt adjustment:adjust archaeology:archaeolog apology:apolog luxuriated:luxuri bed bing agreed:agre feed exceeded:exceed youth yearly:year boyish playing:play syzygy:syzygi
national:nation vileness:vile replacement:replac arsenal arsenic generic dies:die x1s abc_s écoles as us a y sensibilities:sensibl relativity:relat analogously:analog""".split()


@pytest.fixture(scope="module")
def pairs():
    return [(x.partition(":")[0], x.partition(":")[2] or x) for x in PAIRS]


def test_stems_in_both_engines(spark, pairs):
    got = {r["w"]: r["s"] for r in spark.createDataFrame(pairs, "w string, want string").select("w", stem.stem("w").alias("s")).collect()}
    con = duckdb.connect()
    for w, want in pairs:
        assert (got[w], con.execute("SELECT " + stem.stem_sql("?", stem.DUCK), [w]).fetchone()[0]) == (want, want)
        #: so that only words that begin like a stem must be stemmed
        assert w.startswith(got[w][: max(1, len(got[w]) - 2)])


def brute(hits, n, weight=0.1):
    """Minimal stretches by trying all."""
    spans = [(i, j) for i in range(len(hits)) for j in range(i, len(hits)) if len({t for _, t in hits[i : j + 1]}) == n]
    least = [(i, j) for i, j in spans if not any((a, b) != (i, j) and i <= a and b <= j for a, b in spans)]
    return sum(weight / (1 + hits[j][0] - hits[i][0] - (j - i)) for i, j in least) if least else None


def ranks(spark, many, n):
    df = spark.createDataFrame([(i, [{"at": a, "term": t} for a, t in h]) for i, h in enumerate(many)], "id int, hits array<struct<at: int, term: int>>")
    return {r["id"]: r["rank"] for r in df.select("id", ft.cover_density(F.col("hits"), n).alias("rank")).collect()}


def test_hand_computed_covers(spark):
    many = [
        [(0, 0), (1, 1)],  # next to each other: 0.1
        [(0, 0), (3, 1)],  # two words between: 0.1 / 3
        [(0, 0), (2, 1), (4, 0)],  # two stretches with a word between each: 0.05 + 0.05
        [(0, 0), (1, 0), (2, 1)],  # only from the second: 0.1
        [(5, 0)],
        [],
    ]
    got = ranks(spark, many, 2)
    assert [None if got[i] is None else round(got[i], 9) for i in range(6)] == [0.1, round(0.1 / 3, 9), 0.1, 0.1, None, None]
    assert round(ranks(spark, [[(0, 0), (1, 0), (7, 0)]], 1)[0], 9) == 0.3
    #: three terms, a hit of another term inside isn't a gap: places 0 and 6, 3 steps of hits, so 3 words between
    assert round(ranks(spark, [[(0, 0), (2, 1), (3, 1), (6, 2)]], 3)[0], 9) == round(0.1 / 4, 9)


def test_covers_of_random_places_equal_brute_force(spark):
    r = random.Random(9)
    for n in (1, 2, 3, 4):
        many = [[(at, r.randrange(n)) for at in sorted(r.sample(range(30), r.randint(0, 12)))] for _ in range(60)]
        got = ranks(spark, many, n)
        for i, h in enumerate(many):
            want = brute(h, n)
            assert (got[i] is None) == (want is None) and (want is None or abs(got[i] - want) < 1e-12)


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    words = ["run", "Running", "runs", "the", "hope", "hoping", "hopes", "cat", "cats", "of", "écoles", "x1", "Skies", "sky"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 25)))) for i in range(120)] + [(200, None), (201, ""), (202, "the of"), (203, "a hope-running cat")]
    return spark.createDataFrame(rows, "id long, content string").cache()


STEMS = {"run": "run", "running": "run", "runs": "run", "hope": "hope", "hoping": "hope", "hopes": "hope", "cat": "cat", "cats": "cat", "skies": "sky", "sky": "sky"}


def wanted(docs, stems, every):
    out = {}
    for r in docs.collect():
        words = [w for w in (r["content"] or "").lower().replace("-", " ").split()]
        hits = [(i, stems.index(STEMS[w])) for i, w in enumerate(words) if STEMS.get(w) in stems]
        score = brute(hits, len(stems)) if every else 0.1 * len(hits) or None
        if score is not None:
            out[r["id"]] = round(score, 9)
    return out


@pytest.mark.parametrize("every", [True, False])
def test_search_and_index_equal_brute_force(spark, docs, every, tmp_path):
    path = str(tmp_path / "index")
    ft.write_english(docs, path)
    for query, stems in (("the Runner's runs and HOPED hopes cats", None), ("running hope", ["run", "hope"]), ("cats", ["cat"]), ("skies of cats running", ["sky", "cat", "run"]), ("zebra cats", ["zebra", "cat"])):
        a = {r["id"]: round(r["score"], 9) for r in ft.search_english(docs, query, 500, every=every).collect()}
        b = {r["id"]: round(r["score"], 9) for r in ft.search_english_index(spark, path, query, 500, every=every).collect()}
        assert a == b and (stems is None or a == wanted(docs, stems, every))
    best = [(r["id"], round(r["score"], 9)) for r in ft.search_english(docs, "running hope", 7, every=every, skip=3).collect()]
    assert best == sorted(wanted(docs, ["run", "hope"], every).items(), key=lambda x: (-x[1], x[0]))[3:10]


def test_stop_words_alone_and_stages(spark, docs, tmp_path):
    assert ft.search_english(docs, "the of a", 5).count() == 0
    assert {(r["stage"], r["score"]) for r in ft.search_english_staged(docs, "cats zebra", 5).collect()} == {(2, 1.0)}
    assert {r["stage"] for r in ft.search_english_staged(docs, "e-run", 5).collect()} == {1}
    assert {r["stage"] for r in ft.search_english_staged(docs, "opes", 5).collect()} == {3}
    first = [r["score"] for r in ft.search_english_staged(docs, "cat running", 50).collect()]
    assert first == sorted(first, reverse=True) and len(set(first)) > 3
    ft.write_english(docs.where("false"), str(tmp_path / "none"))
    assert ft.search_english_index(spark, str(tmp_path / "none"), "cats", 5).count() == 0


def test_plan_has_no_python(docs):
    plan = ft.search_english(docs, "cats running", 5)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pairs_are_many(pairs):
    assert len(pairs) > 100 and len(set(itertools.chain(*pairs))) > 150
