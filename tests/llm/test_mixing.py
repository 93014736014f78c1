from __future__ import annotations

import re
from collections import defaultdict

from sparkloom.llm.mixing import mix_sources


def wanted(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        rest = budget - sum(out.values())
        level = rest / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level >= most * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in free}
        out |= {s: most * sizes[s] for s in over}
        free -= over
    return out


def test_targets_and_taken(docs_of, corpus):
    sources = [["b", "a", None, "ü", "hot", "hot", "hot"][i % 7] for i in range(len(corpus))]
    df = docs_of(corpus, sources)
    rows = mix_sources(df).collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", x or "")) for x in corpus]
    sums, biggest = defaultdict(int), defaultdict(int)
    for s, n in zip(sources, size, strict=True):
        sums[s] += n
        biggest[s] = max(biggest[s], n)
    want, taken = wanted(sums), defaultdict(int)
    assert len(rows) == len(corpus)
    for r in rows:
        s = sources[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[s] and abs(r["target"] - want[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in sums:
        assert abs(taken[s] - want[s]) <= biggest[s]
    assert sorted(rows) == sorted(mix_sources(df.repartition(5)).collect())


def test_one_source_empty_table_and_no_words(docs_of):
    assert mix_sources(docs_of(["a b", "c"])).select("target").distinct().collect()[0][0] == 4.5
    assert mix_sources(docs_of([])).count() == 0
    assert [tuple(r) for r in mix_sources(docs_of([None, ""])).orderBy("doc_id").collect()] == [(0, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0)]


def test_null_ids_repeated_rows_and_a_very_long_text(docs_of):
    """Rows with the same doc_id and text are taken alike; rows without an id are documents of their own."""
    texts = ["w " * 400_000, "a b", "a b", "c", None, "d e f"] * 3
    ids = [None, 4, 4, None, None, 7] * 3
    rows = mix_sources(docs_of(texts, ["s"] * 9 + [None] * 9, ids)).collect()
    assert len(rows) == 18 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for source in {(r["source_size"], r["target"]) for r in rows}:
        mine = [r for r in rows if (r["source_size"], r["target"]) == source]
        assert abs(sum(r["taken"] for r in mine) - source[1]) <= 3 * 400_000
        assert len({r["taken"] for r in mine if r["doc_id"] == 4}) == 1


def test_hot_source_is_cut_near_its_target(docs_of):
    """A source of two thirds of all rows, with words of one size: what is taken is within one document of the target."""
    texts = [f"x{i} y z" for i in range(600)]
    sources = ["hot" if i % 3 else ["a", "b", "c"][i % 9 // 3] for i in range(600)]
    rows = mix_sources(docs_of(texts, sources)).collect()
    by = defaultdict(list)
    for r in rows:
        by[sources[r["doc_id"]]].append(r)
    assert all(abs(sum(r["taken"] for r in some) - some[0]["target"]) <= 3 for some in by.values())
