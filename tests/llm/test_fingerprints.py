from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from sparkloom.llm.fingerprints import add_fingerprints, compare_with_next, edit_distance, edited, fingerprint, likeness


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 64))) for _ in range(2))
        assert edit_distance(a, b) == slow_distance(a, b)


@pytest.mark.parametrize("buckets", [1, 7])
def test_against_a_plain_loop(docs_of, corpus, buckets):
    ids = [3 * i + i % 2 for i in range(len(corpus))]
    got = {r["doc_id"]: r for r in compare_with_next(docs_of(corpus, ids=ids), buckets).collect()}
    assert len(got) == len(corpus)
    for i, x in enumerate(corpus):
        x, y = x or "", corpus[i - 1] or ""
        changed = edited(x, y)
        print_ = lambda s: fingerprint(np.frombuffer(s.encode(), np.uint8))
        r = got[ids[i]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(x), hashlib.sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (print_(x), print_(changed))
        assert (r["near_edited"], r["near_next"]) == (likeness(print_(x), print_(changed)), likeness(print_(x), print_(y)))
        assert 0 <= r["near_edited"] <= 1


def slow_fingerprint(data):
    """Cuts behind every window of seven bytes whose hash is a multiple, chunk by chunk, in plain numbers."""
    from sparkloom.llm.common import _BYTE, _BASE

    full = (1 << 64) - 1

    def spread(x):
        x ^= x >> 31
        x = x * 0xBF58476D1CE4E5B9 & full
        x ^= x >> 29
        x = x * 0x94D049BB133111EB & full
        return x ^ x >> 32

    value = lambda some: spread(sum(int(_BYTE[b]) * pow(int(_BASE), i, 1 << 64) for i, b in enumerate(some)) & full)
    roll = {i + 7: value(data[i : i + 7]) for i in range(len(data) - 6)}
    cuts = lambda block: [i for i, v in sorted(roll.items()) if i < len(data) and v % block == 0]
    block = 3
    while len(cuts(block)) + 1 > 64:
        block *= 2

    def sign(at):
        return "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[value(data[i:j]) >> 58] for i, j in zip([0, *at], [*at, len(data)]) if j > i)

    return f"{block}:{sign(cuts(block))}:{sign(cuts(2 * block))}"


def test_fingerprint_against_plain_numbers():
    r = random.Random(7)
    for n in (0, 1, 6, 7, 8, 50, 400, 3000):
        for letters in (b"ab", bytes(range(256))):
            data = bytes(r.choice(letters) for _ in range(n))
            assert fingerprint(np.frombuffer(data, np.uint8)) == slow_fingerprint(data)


def test_null_and_repeated_ids_and_long_texts(docs_of):
    """Rows without an id come last; of rows with one id each is followed by another of them or by the next id."""
    texts = ["t" * 10, "u" * 400_000, None, "same", "same", "same", "other", ""]
    ids = [9, 9, None, None, 4, 4, 4, 1]
    for buckets in (1, 5):
        rows = compare_with_next(docs_of(texts, ids=ids), buckets).collect()
        assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in rows) == sorted((i or 0, len(x or "")) for i, x in zip(ids, texts))
        got = {}
        for r in rows:
            got.setdefault(r["doc_id"], []).append(r["edited_sha256"])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[1] in ([sha("")], [sha("")])
        first_of_9 = {sha(edited(a, b)) for a in texts[:2] for b in (*texts[:2], "same", "other") if a != b}
        assert set(got[9]) <= first_of_9 and len(got[4]) == 3 and len(got[None]) == 2


def test_likeness_tells_edits_from_strangers(corpus):
    r = random.Random(3)
    text = lambda: "".join(r.choice("abcdefgh ") for _ in range(4000)).encode()
    a, b = text(), text()
    one = lambda x: fingerprint(np.frombuffer(x, np.uint8))
    assert likeness(one(a), one(a[:2000] + b"!" + a[2000:])) > 0.8
    assert likeness(one(a), one(b)) < 0.2
    assert one(b"") == "3::" and likeness("3::", "3::") == 1 and len(one(a).split(":")[1]) <= 64


def test_empty_single_and_repeated(docs_of):
    assert compare_with_next(docs_of([])).count() == 0
    assert [r["near_next"] for r in compare_with_next(docs_of(["alone"])).collect()] == [1.0]
    assert compare_with_next(docs_of(["x", "y", "x"], ids=[1, 1, 1])).count() == 3
    assert add_fingerprints(docs_of(["abc", None])).count() == 2
