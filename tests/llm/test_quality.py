from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.llm.quality import FactorisationMachine, features, fit_quality, is_held_out, score_quality
from sparkloom.session import table


def test_sum_of_squares_identity():
    fm = FactorisationMachine()
    ids, values, starts = features(pa.array(["alpha beta gamma beta", "x"]))
    margins = fm.margins(ids, values, starts)
    for i in range(2):
        at = range(starts[i], starts[i + 1])
        slow = sum(float(fm.factors[ids[p]] @ fm.factors[ids[q]]) * values[p] * values[q] for p in at for q in at if p < q)
        assert abs(margins[i] - slow) < 1e-4


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = score_quality(docs, fit_quality(docs, labels)).join(labels, "doc_id").where(is_held_out(F.col("doc_id"))).toPandas()
    good, bad = scored[scored.quality == 1].score, scored[scored.quality == 0].score
    assert (good >= 0.3).mean() >= 0.97
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id)


def test_inputs_are_the_text_only(spark, docs_of, corpus):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(1, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs_of(corpus)
    model = fit_quality(df, labels)
    a = {r["doc_id"]: r["score"] for r in score_quality(df, model).collect()}
    b = {r["doc_id"] - 1000: r["score"] for r in score_quality(df.withColumns({"doc_id": F.col("doc_id") + 1000, "lang": F.lit("xx"), "source": F.lit(None).cast("string")}), model).collect()}
    assert a == b and len(a) == len(corpus) and all(0 <= s <= 1 for s in a.values())


def test_without_labels_or_rows(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit_quality(docs_of(["a", None]), labels)
    assert score_quality(docs_of(["a", None]), model).count() == 2
    assert score_quality(docs_of([]), model).count() == 0


def test_training_follows_the_loss(monkeypatch):
    """One step on one document moves every parameter against the numeric slope of the logistic loss."""
    from sparkloom.llm import quality

    monkeypatch.setattr(quality, "WIDTH", 6)
    ids, x = np.array([0, 2, 5]), np.array([0.5, 0.25, 1.0], np.float32)
    start = FactorisationMachine()

    def loss(bias, linear, factors):
        pairs = sum(float(factors[a] @ factors[b]) * p * q for i, (a, p) in enumerate(zip(ids, x)) for b, q in zip(ids[i + 1 :], x[i + 1 :]))
        margin = bias + float(linear[ids] @ x) + pairs
        return np.log1p(np.exp(-margin))

    bias = float(np.log((1 - 1e-3) / 1e-3))  # of one mark, which is 1
    fitted = FactorisationMachine().fit([(ids, x)], np.array([1.0], np.float32), epochs=1, decay=0.0)
    at = start.factors.astype(float)
    for i in ids:
        up = np.zeros(6)
        up[i] = 1e-4
        slope = (loss(bias, up, at) - loss(bias, -up, at)) / 2e-4
        assert slope < 0 < fitted.linear[i]
        for f in range(at.shape[1]):
            some = np.zeros_like(at)
            some[i, f] = 1e-3
            slope = (loss(bias, np.zeros(6), at + some) - loss(bias, np.zeros(6), at - some)) / 2e-3
            moved = float(fitted.factors[i, f] - start.factors[i, f])
            assert moved * slope <= 0 and (abs(slope) < 1e-9 or moved)
    assert not fitted.linear[[1, 3, 4]].any()


def test_repeated_rows_long_texts_and_null_ids(spark, docs_of):
    texts = ["good words here", None, "b", "word " * 250_000, ""]
    ids = [1, 1, None, 3, 4]
    df = docs_of(texts * 40, ids=ids * 40)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 1, 0), (4, 0, 0), (None, 1, 0)] * 3, "doc_id long, quality int, toxic int")
    model, once = fit_quality(df, labels), fit_quality(docs_of(texts, ids=ids), labels)
    assert np.array_equal(model.factors, once.factors)
    scores = score_quality(df, model).collect()
    assert len(scores) == 200 and all(0 <= r["score"] <= 1 for r in scores) and len({r["score"] for r in scores if r["doc_id"] == 4}) == 1
