from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from sparkloom.llm.urls import filter_urls, labelled_urls, mine_rules, tokens_of

URLS = ["http://a.Example.NET/en/1", "http://net/x", "http://a.net", "HTTPS://x.example.com/de/?q", "http://b.org/fr/y#t", "http://evilnet/x", None, "no scheme", "http://u@example.net:80/en/", "ftp://example.net/en", "a://b://net/"]


def test_given_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages, mine_rules(labelled_urls(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")))).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == ("net", "/x", "net/", "block")
    assert got[2] == ("a.net", "", None, "allow")
    assert got[3] == ("x.example.com", "/de/", "example.com/de/", "block")
    assert got[4] == ("b.org", "/fr/y", "org/fr/", "allow")
    assert got[5] == ("evilnet", "/x", None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("u@example.net:80", "/en/", None, "allow")
    assert got[9] == ("example.net", "/en", "net/", "block")
    assert got[10] == ("b:", "//net/", None, "allow")


def test_mined_rules_block(spark):
    pages = spark.createDataFrame([(i, f"http://{'spam' if i % 2 else 'fine'}.site/p{i % 3}/x") for i in range(60)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    out = filter_urls(pages, mine_rules(labelled_urls(pages, labels))).collect()
    assert len(out) == 60 and all((r["verdict"] == "block") == (r["page_id"] % 2 == 1) for r in out)
    assert filter_urls(pages.where("false"), mine_rules(labelled_urls(pages, labels))).count() == 0


def test_rules_on_late_tokens(spark):
    """What tells the marks apart is the seventh parameter, folder or label of the host."""
    many = "&".join(f"q{i}=1" for i in range(6))
    shapes = [lambda bad: f"http://h.site/x?{many}&{'ad' if bad else 'ok'}=1", lambda bad: f"http://h.site/a/a/a/a/a/a/{'ad' if bad else 'ok'}", lambda bad: f"http://{'ad' if bad else 'ok'}.f.e.d.c.b.site/x"]
    for shape in shapes:
        pages = spark.createDataFrame([(i, shape(i % 2)) for i in range(40)], "page_id long, url string")
        labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
        out = filter_urls(pages, mine_rules(labelled_urls(pages, labels))).collect()
        assert all((r["verdict"] == "block") == (r["page_id"] % 2 == 1) for r in out)


def brute_rules(sets, bad, support, confidence, lift, least):
    """All token sets with enough evidence, without those that have a subset as confident."""
    share, found = sum(bad) / len(bad), {}
    for size in range(1, max(map(len, sets)) + 1):
        for some in {c for s in sets for c in itertools.combinations(sorted(s), size)}:
            on = [b for s, b in zip(sets, bad, strict=True) if set(some) <= set(s)]
            right = sum(on)
            if right >= max(least, support * len(bad)) and right / len(on) >= confidence and right / len(on) / share >= lift:
                found[some] = right / len(on)
    return {t: c for t, c in found.items() if not any(set(u) < set(t) and found[u] >= c for u in found)}


def test_mined_rules_equal_brute_force(spark):
    """Random URLs with a planted pair of tokens that is bad together only."""
    r = random.Random(8)
    rows = []
    for i in range(400):
        host, folder, name = r.choice("abcde"), r.choice("xyz"), r.choice(["", "?ad=1", "?ref=2&ad=3"])
        planted = host == "a" and "ad" in name
        rows.append((i, f"http://{host}.site/{folder}/{i}.html{name}", 0 if planted and r.random() < 0.97 or r.random() < 0.1 else 1, 0))
    pages = spark.createDataFrame([x[:2] for x in rows], "page_id long, url string").withColumns({c: F.lit(1) for c in ("tokens", "t", "own", "bad", "given", "confidence")})
    labels = spark.createDataFrame([(x[0], *x[2:]) for x in rows], "doc_id long, quality int, toxic int")
    for least, support in ((10, 0.01), (25, 0.01), (1, 0.05)):
        labelled = labelled_urls(pages, labels)
        got = {tuple(x["tokens"]): round(x["confidence"], 9) for x in mine_rules(labelled, support=support, least=least).collect()}
        sets = [x["t"] for x in pages.select("page_id", tokens_of(F.col("url")).alias("t")).orderBy("page_id").collect()]
        want = brute_rules(sets, [x[2] == 0 for x in rows], support, 0.75, 1.3, least)
        assert got == {t: round(c, 9) for t, c in want.items()} and got
    out = filter_urls(pages, mine_rules(labelled_urls(pages, labels)))
    planted = {x[0] for x in rows if "/a.site" in x[1] and "ad=" in x[1]}
    blocked = {x["page_id"] for x in out.collect() if x["verdict"] == "block"}
    assert planted <= blocked and len(blocked - planted) < 20 and out.count() == 400


def test_few_labels_are_no_evidence_and_ties_have_one_answer(spark):
    pages = spark.createDataFrame([(i, f"http://{'ad' if i % 2 else 'ok'}.site/x") for i in range(14)] * 2, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(14)], "doc_id long, quality int, toxic int")
    few = labels.where("doc_id < 9")
    assert mine_rules(labelled_urls(pages.distinct(), few)).count() == 0
    rules = mine_rules(labelled_urls(pages, labels))
    out = filter_urls(pages, rules).orderBy("page_id").collect()
    assert len(out) == 28 and {(r["page_id"] % 2, r["verdict"], r["mined_rule"]) for r in out} == {(0, "allow", None), (1, "block", "h:ad.site")}
    long = spark.createDataFrame([(1, "http://ad.site/" + "x/" * 100_000)], "page_id long, url string")
    assert [r["verdict"] for r in filter_urls(long, rules).collect()] == ["block"]


def test_many_labels_of_a_host_and_pages_without_a_number(spark):
    """Twenty suffixes of one host always stand together: they make 20 sets, not a million, and the rule is one of them."""
    deep = ".".join(f"l{i}" for i in range(20)) + ".site"
    rows = [(i if i else None, f"http://{deep if i % 3 == 0 else 'ok.site'}/x") for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i if i else None, 0 if i % 3 == 0 else 1, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    rules = mine_rules(labelled_urls(pages, labels)).collect()
    assert {len(r["tokens"]) for r in rules} == {1} and {r["confidence"] for r in rules} == {1.0} and len(rules) == 20
    out = filter_urls(pages, mine_rules(labelled_urls(pages, labels))).collect()
    assert len(out) == 90 and all((r["verdict"] == "block") == (deep in r["host"]) for r in out) and any(r["page_id"] is None and r["verdict"] == "block" for r in out)
