from __future__ import annotations

import re

import numpy as np
import pytest

from sparkloom.llm import neardup
from sparkloom.llm.components import connected_components
from sparkloom.llm.neardup import COORDINATES, FEW, MATCHES, Collisions, _forest, near_duplicates, shingle_sets, signature


def brute(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for x in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    part = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]) and part[i] != part[j]:
                a, b = sorted((part[i], part[j]))
                part = [a if p == b else p for p in part]
    return [(len(s), p, p == i) for i, (s, p) in enumerate(zip(sets, part, strict=True))]


@pytest.mark.parametrize("block", [2048, 3])
def test_equals_brute_force(docs_of, corpus, block):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs_of(corpus), block=block).collect()}
    assert [got[i] for i in range(len(corpus))] == brute(corpus)


def test_partners_in_several_rows(docs_of, corpus, monkeypatch):
    """A chain whose links the forests don't make, each class with more partners than a row takes."""
    monkeypatch.setattr(neardup, "PARTNERS", 1)
    monkeypatch.setattr(neardup, "LIKELY", 40)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs_of(corpus), block=8).collect()}
    assert [got[i] for i in range(len(corpus))] == brute(corpus)


def test_empty_tables_and_repeated_rows(docs_of):
    assert near_duplicates(docs_of([])).count() == 0
    assert [tuple(r) for r in near_duplicates(docs_of([None, "", " "])).orderBy("doc_id").collect()] == [(i, 0, i, True) for i in range(3)]
    assert [tuple(r) for r in near_duplicates(docs_of(["a b", "a b"], ids=[4, 4])).collect()] == [(4, 1, 4, True)] * 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_has_fewer_pairs_than_documents():
    for copies in (5, 40):
        values = np.repeat(np.arange(3), copies)[:, None] * np.ones(COORDINATES, np.int32)
        assert len(_forest(values, 14)) == 3 * (copies - 1)


def test_counting_by_postings_equals_comparing():
    """Long lists are merged by posting lists, the longest skipped; every pair over the threshold comes with its count."""
    r = np.random.default_rng(6)
    for n, kinds in ((FEW + 1, 2), (300, 3), (300, 60), (200, 1)):
        values = r.integers(0, kinds, (n, COORDINATES)).astype(np.int32)
        for least in (1, MATCHES, 20):
            found = Collisions(values, least)
            for i in range(1, n):
                want = (values[:i] == values[i]).sum(axis=1)
                near, count = found.before(i)
                assert list(near) == list(np.flatnonzero(want >= least)) and list(count) == list(want[near])


def test_chance_agreement_is_no_shared_list(docs_of):
    """a and c share one list alone, the fifth, where b hides their pair from the forest."""
    a = [34026, 66863, 37914, 90840, 24087, 98429, 17691, 84248, 86657, 48443, 98769, 2465, 39956]
    b = [24087, 37914, 86657, 39956, 17691, 75334, 56081, 36913, 222]
    c = [34026, 66863, 37914, 90840, 24087, 98429, 75334, 3682, 41647, 56081, 56764, 36913, 94876]
    docs = docs_of([" ".join(f"w{i}" for i in x) for x in (a, b, c)])
    got = near_duplicates(docs, similarity=30, size=1, matches=1).orderBy("doc_id").collect()
    assert [(r["component_id"], r["kept"]) for r in got] == [(0, True), (1, True), (0, False)]


def test_recall_of_pairs_just_over_the_threshold(docs_of):
    """2,000 pairs, no two of which are alike, at similarities from 0.75: all that brute force links are found."""
    r = np.random.default_rng(9)
    texts = []
    for i in range(2000):
        words = [f"p{i}x{j}" for j in range(r.integers(40, 120))]
        #: a changed word takes five shingles on either side, so this many reach 0.75 and not much more
        shingles = len(words) - 4
        cut = words[: len(words) - (shingles - int(np.ceil(0.75 * shingles)))]
        texts += [" ".join(words), " ".join(cut)]
    got = near_duplicates(docs_of(texts)).collect()
    found = sum(x["component_id"] == x["doc_id"] - 1 for x in got if x["doc_id"] % 2)
    assert found / 2000 >= 0.999 and all(x["kept"] for x in got if x["doc_id"] % 2 == 0)


def test_signatures_miss_what_the_binomial_says():
    """Share of pairs at 0.75 to 0.76 whose coordinates collide fewer than MATCHES times: none of 3,000."""
    import pyarrow as pa

    r, least = np.random.default_rng(10), COORDINATES
    for i in range(3000):
        n = int(r.integers(100, 200))
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        b = a[: int(np.ceil(0.75 * n))]
        with np.errstate(over="ignore"):
            x, y = (signature(v).reshape(COORDINATES, -1) for v in (a, b))
        least = min(least, int((x == y).all(axis=1).sum()))
    assert least >= MATCHES
    assert [len(v) for v in shingle_sets(pa.array([None, "", "a b", "a b c d e f"]))] == [0, 0, 1, 2]


def test_very_long_texts_and_large_groups(docs_of):
    """Near copies of 300,000 words beside a group of 300 near copies, in blocks of 50."""
    words = [f"w{i}" for i in range(300_000)]
    base = [f"g{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:-5] + ["x"])] + [" ".join([*base, f"t{i}"]) for i in range(300)]
    got = near_duplicates(docs_of(texts), block=50).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 0} | {i: 2 for i in range(2, 302)}


def test_null_and_repeated_ids(docs_of):
    """Documents without an id are linked and kept like others; two texts under one id are two documents."""
    words = [f"w{i}" for i in range(60)]
    near = lambda start: [" ".join([*(f"{start}{w}" for w in words), *more]) for more in ([], ["x"])]
    (a, a2), (b, b2), (c, c2), (d, d2) = map(near, "abcd")
    texts, ids = [a, a2, b, b2, "alone", c, d, c2, d2, c2], [None, 3, None, None, None, 5, 5, 6, 7, 6]
    docs = docs_of(texts, ids=ids)
    got = near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = sorted(got.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] or 0, r["n_shingles"]))
    assert [(r["doc_id"], r["component_id"], r["kept"]) for r in rows[:6]] == [(3, 3, True), (5, 5, True), (5, 5, True), (6, 5, False), (6, 5, False), (7, 5, False)]
    unknown = [(r["n_shingles"], r["component_id"], r["kept"]) for r in rows[6:]]
    assert (1, None, True) in unknown and (56, 3, False) in unknown
    assert sum(r[2] for r in unknown) == 2 and len(unknown) == 4


def test_two_texts_under_one_id_have_links_of_their_own(docs_of):
    words = [f"w{i}" for i in range(60)]
    x, y = (" ".join(f"{k}{w}" for w in words) for k in "xy")
    got = near_duplicates(docs_of([x, y, x + " z", y + " z"], ids=[1, 1, 2, 3])).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(1, 1, True), (2, 1, False), (3, 1, False)}


def test_components_of_a_large_star_and_clashing_names(spark):
    from pyspark.sql import functions as F

    star = spark.range(1, 100_001).select((F.col("id") + 5).alias("a"), F.lit(3).cast("long").alias("b"))
    path = spark.range(100).select((F.col("id") + 1_000_000).alias("a"), (F.col("id") + 1_000_001).alias("b"))
    edges = star.union(path).withColumns({c: F.lit("x") for c in ("u", "v", "m", "e", "node", "component")})
    found = connected_components(edges)
    assert {(r["component"], r["count"]) for r in found.groupBy("component").count().collect()} == {(3, 100_001), (1_000_000, 101)}
