from __future__ import annotations

import hashlib
import re

from sparkloom.llm.decontamination import clean_of, contamination, words_of

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(x):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOW))


def brute(texts, items):
    windows = {}
    for item, x in items:
        w = words(x)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for x in texts:
        w, hit, found = words(x), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_equals_brute_force(spark, docs_of, corpus):
    long_ = corpus[-1].split()
    items = [(1, " ".join(long_[50:90])), (2, " ".join(long_[60:70])), (10, " ".join(long_[60:69])), (3, "Two, WORDS!"), (4, None), (5, "..."), (6, corpus[50]), (6, corpus[50]), (7, corpus[0].upper())]
    df, bench = docs_of(corpus), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in contamination(df, bench).collect()}
    want = brute(corpus, items)
    assert [got[i] for i in range(len(corpus))] == want
    assert sum(w[4] for w in want) > 5
    assert sorted(r["doc_id"] for r in clean_of(df, bench).collect()) == [i for i, w in enumerate(want) if not w[4]]


def test_short_items_of_every_length_and_beyond_the_broadcast_bound(spark, docs_of, corpus):
    """Items of 1 to 12 words from many places, one of them in many documents; once by a join without broadcast."""
    long_ = corpus[-1].split()
    items = [(n, " ".join(long_[100 * n : 100 * n + n])) for n in range(1, 13)] + [(100 + n, " ".join(corpus[50].split()[3 : 3 + n])) for n in range(1, 13)]
    items += [(200 + n, corpus[56]) for n in range(5)] + [(None, " ".join(long_[7:30]))]
    df, bench = docs_of(corpus), spark.createDataFrame(items, "item_id long, text string")
    want = brute(corpus, [(i, x) for i, x in items if i is not None])
    hit = brute(corpus, items)
    for most in (2_000_000, 0):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in contamination(df, bench, most).collect()}
        assert [got[i] for i in range(len(corpus))] == [(w[0], h[1], w[2], w[3], h[4]) for w, h in zip(want, hit, strict=True)]
    assert sorted(r["doc_id"] for r in clean_of(df, bench, 0).collect()) == [i for i, w in enumerate(hit) if not w[4]]


def test_words_end_at_every_gap(spark):
    text = "".join(f"a{chr(c)}B" for c in range(128)) + "é\u00a0ü ß\u2028x"
    df = spark.createDataFrame([(text,), (None,), ("",), (" \x00 ",)], "text string")
    from pyspark.sql import functions as F

    got = [r["w"] for r in df.select(words_of(F.col("text")).alias("w")).collect()]
    assert got == [words(text), [], [], []]


def test_null_and_repeated_ids(spark, docs_of):
    passage = " ".join(f"w{i}" for i in range(12))
    texts, ids = [passage, "x " + passage, "clean", passage, passage, None], [None, None, None, 4, 4, 5]
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_hit"]) for r in contamination(docs_of(texts, ids=ids), bench).collect()))
    assert got == [(0, 1, 0), (0, 12, 12), (0, 13, 12), (4, 12, 12), (4, 12, 12), (5, 0, 0)]
    long = docs_of(["y " * 300_000 + passage])
    assert [(r["n_words"], r["n_hit"]) for r in contamination(long, bench).collect()] == [(300_012, 12)]


def test_long_items_only(spark, docs_of, corpus):
    items = [(1, " ".join(corpus[-1].split()[50:90])), (2, corpus[50])]
    got = {r["doc_id"]: r["n_hit"] for r in contamination(docs_of(corpus), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [got[i] for i in range(len(corpus))] == [w[1] for w in brute(corpus, items)]


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in contamination(docs_of(["a b c", None]), none).collect()] == [False, False]
    assert contamination(docs_of([]), none).count() == 0
