from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm.substrings import dedup_substrings, repeated_windows, suffix_order


def brute(texts, length):
    data = [(x or "").encode() for x in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        mask = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                mask[i] += 1
                mask[i + length] -= 1
        hit = np.cumsum(mask)[: len(d)] > 0
        rest = bytes(b for b, h in zip(d, hit, strict=True) if not h)
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out.append((len(d), len(d) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "k", "hot"), [(200, 48, 4096), (60, 16, 1), (61, 48, 3), (200, 48, 1), (70, 8, 2)])
def test_equals_brute_force(docs_of, corpus, length, k, hot):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in dedup_substrings(docs_of(corpus), length, k, hot).collect()}
    assert [got[i] for i in range(len(corpus))] == brute(corpus, length)


def test_empty_table_and_repeated_rows(docs_of):
    assert dedup_substrings(docs_of([])).count() == 0
    twice = dedup_substrings(docs_of(["q" * 199 + "é", "q" * 199 + "é"], ids=[3, 3])).collect()
    assert [(r["n_bytes"], r["n_removed"]) for r in twice] == [(201, 201)] * 2


def test_cut_inside_a_character_leaves_whole_characters(docs_of):
    shared = "é" * 110  # repeated 200-byte strings begin at any byte of it
    rows = dedup_substrings(docs_of(["a" + shared, "b" + shared])).collect()
    assert all(r["kept_text"] in ("a", "b") for r in rows)


def test_suffix_order():
    """Random rows of few letters in groups, zeros among them, against Python's sort."""
    r = np.random.default_rng(1)
    for width in (1, 8, 13, 20):
        rows = r.integers(0, 2, (300, width)).astype(np.uint8)
        rows[::3, width // 2 :] = 1
        group = r.integers(0, 5, 300)
        order, shared = suffix_order(rows, group)
        at = [(group[i], rows[i].tobytes()) for i in order]
        assert at == sorted(at) and sorted(order) == list(range(300))
        for (g, x), (h, y), n in zip(at, at[1:], shared[1:]):
            assert n == (-1 if g != h else next((i for i in range(width) if x[i] != y[i]), width))
    assert suffix_order(np.zeros((0, 9), np.uint8), np.zeros(0, np.int64))[0].size == 0


def test_repeated_windows():
    """Pieces around equal cores, in groups, against a count of their windows by place before the core."""
    r = np.random.default_rng(2)
    for core, length in ((4, 9), (1, 6), (5, 6)):
        pieces, at, group = [], [], []
        for g in range(6):
            lead = r.integers(0, 2, core).astype(np.uint8)
            for _ in range(9):
                left = r.integers(0, length - core + 1)
                right = r.integers(length - core - left if left < length - core else 0, length - core + 1)
                pieces.append(np.concatenate([r.integers(0, 2, left), lead, r.integers(0, 2, right)]).astype(np.uint8))
                at.append(left)
                group.append(g)
        size = np.array(list(map(len, pieces)))
        begin = np.cumsum(size) - size
        got = repeated_windows(np.concatenate(pieces), begin, np.array(at), np.full(len(at), core), size - length, np.array(group), length)
        of = lambda i: [(group[i], at[i] - j, pieces[i][j : j + length].tobytes()) for j in range(size[i] - length + 1)]
        n = Counter(w for i in range(len(at)) for w in of(i))
        assert [list(x) for x in got] == [[j for j, w in enumerate(of(i)) if n[w] > 1] for i in range(len(at))]


def test_runs_over_the_bound_take_narrower_leads(docs_of):
    """A line of all documents with different surroundings, cut to the narrowest range; repeated rows and null ids beside."""
    r = np.random.default_rng(3)
    word = lambda n: "".join(r.choice(list("abcd"), n))
    line = word(190)
    texts = [word(250) + line + "xy"[i % 2] * (i % 13) + word(250) for i in range(24)]
    texts += [texts[0]] * 3 + [word(400), line]
    ids = [*range(24), 5, None, None, None, 40]
    rows = dedup_substrings(docs_of(texts, ids=ids), hot=4).collect()
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)
    assert got == sorted(brute(texts, 200))


def test_very_long_text(docs_of):
    r = np.random.default_rng(4)
    long = r.integers(97, 123, 1_200_000).astype(np.uint8).tobytes().decode()
    texts = [long, "x" + long[500_000:500_300] + "y", long[:5000] + long[-5000:]]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in dedup_substrings(docs_of(texts)).collect()}
    assert got == {0: (1_200_000, 10_300, 3), 1: (302, 300, 1), 2: (10_000, 10_000, 1)}


def test_copies_are_found_by_sorting_too(docs_of, corpus, monkeypatch):
    """Without the sorted runs nothing is found, exact copies and repeated rows neither: hashes decide nothing alone."""
    texts = ["".join(chr(97 + (i * i + 7 * i // 3) % 26) for i in range(600))] * 3 + corpus[:5]
    assert sum(r["n_removed"] for r in dedup_substrings(docs_of(texts)).collect()) >= 1800
    import sparkloom.llm.substrings as module

    #: tasks take the module by value, as it is here
    monkeypatch.setattr(module, "repeated_windows", lambda data, begin, *a: [np.zeros(0, np.int64)] * len(begin))
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(module)
    try:
        assert sum(r["n_removed"] for r in dedup_substrings(docs_of(texts)).collect()) == 0
    finally:
        cloudpickle.unregister_pickle_by_value(module)
