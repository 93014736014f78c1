from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm.compression import compress, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def wanted(rows, parts=8, entries=16, rounds=6):
    """By plain numbers, all distances: {vec_id: [(code, error, label_error)]} and the digest."""
    f32 = lambda x: float(np.float32(x))
    kept = [(i, [math.floor(4096 * f32(x)) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    cut = lambda v: [(v + [0] * (parts * w - len(v)))[p * w : (p + 1) * w] for p in range(parts)]
    kept = sorted(((i, cut(v), y) for i, v, y in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[list(v[p]) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda y, p: min((far(y, c), j) for j, c in enumerate(books[p]))
    for _ in range(rounds):
        found = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                found[p, best(v[p], p)[1]].append(v[p])
        for (p, j), some in found.items():
            books[p][j] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    out, labels = [], defaultdict(int)
    for i, v, y in kept:
        b = [best(v[p], p) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in b), sum(d for d, _ in b), y))
        labels[y] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return sorted(((i, c, e, labels[y], digest) for i, c, e, y in out), key=repr)


def got(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("code", "error", "label_error", "part", "entry", "at", "n", "total")})


def vectors(n, d, seed=1):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(d)] for _ in range(9)]
    return [(i * 3 + 1, [x + r.gauss(0, 0.1) for x in r.choice(centres)], r.choice([None, 1, 2, 2, 2])) for i in range(n)]


def test_equals_brute_force_with_bad_vectors_ties_and_copies(spark):
    rows = vectors(150, 16)
    rows += [(0, None, 1), (2, [0.1] * 15 + [float("nan")], 1), (3, [0.1] * 15 + [None], 2), (5, [float("inf")] * 16, 2), (None, [0.5] * 16, None)]
    rows += rows[3:6] * 40 + [(7, [0.25] * 16, None), (7, [-0.25] * 16, 1)]
    assert got(compress(frame(spark, rows).repartition(5))) == wanted(rows)


def test_lengths_that_differ_fewer_vectors_than_entries_and_other_parameters(spark):
    rows = vectors(9, 10) + [(100, [0.5, -0.5], 4), (101, [], 4)]
    assert got(compress(frame(spark, rows))) == wanted(rows)
    rows = vectors(60, 12, 5)
    assert got(compress(frame(spark, rows), parts=3, entries=5, rounds=2)) == wanted(rows, 3, 5, 2)


def test_empty_table_and_all_bad(spark):
    assert compress(frame(spark, [])).count() == 0
    assert got(compress(frame(spark, [(1, [], 2)] * 3))) == wanted([(1, [], 2)] * 3)
    assert compress(frame(spark, [(1, None, 2), (2, [float("nan")], 3)])).count() == 0


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        compress(frame(spark, [(1, [1e9] * 8, 1)])).collect()


def test_annuli_give_the_nearest_of_all_and_compare_few():
    r = np.random.default_rng(4)
    entries = (r.integers(-3, 4, (64, 4)) * r.integers(1, 400, (64, 1))).astype(np.int64)
    points = np.concatenate([r.integers(-1200, 1200, (3000, 4)), entries, (entries[:32] + entries[32:]) // 2]).astype(np.int64)
    index, best, tried = nearest(points, entries)
    all_ = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (best == all_.min(1)).all() and (index == all_.argmin(1)).all()
    assert tried < all_.size
    #: points near their entries have narrow annuli
    close = np.repeat(entries, 20, 0) + r.integers(-9, 10, (64 * 20, 4))
    index, best, tried = nearest(close, entries)
    assert (best == ((close[:, None] - entries[None]) ** 2).sum(2).min(1)).all() and tried < 0.2 * len(close) * len(entries)
