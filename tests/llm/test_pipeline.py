from __future__ import annotations

import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_neardup import brute as near
from test_decontamination import brute as leaks
from test_substrings import brute as repeats


def test_stages_against_brute_force(spark, tmp_path, docs_of, corpus):
    bench = [(1, " ".join(corpus[-1].split()[50:90]))]
    sf = str(tmp_path)
    docs_of(corpus, [["a", "b"][i % 2] for i in range(len(corpus))]).select(*corpus_pipeline.COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    #: without labels nothing is rejected
    kept = [i for i, n in enumerate(near(corpus)) if n[2]]
    cut = repeats([corpus[i] for i in kept], 200)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert sorted(rows) == kept and docs.columns == corpus_pipeline.COLUMNS
    #: a cut inside a character takes the rest of it, on either side of a removed span
    for i, (n, removed, spans, _) in zip(kept, cut, strict=True):
        assert 0 <= n - removed - len((rows[i]["text"] or "").encode()) <= 2 * spans
    left = [rows[i]["text"] for i in kept]
    clean = {i: x for i, x, w in zip(kept, left, leaks(left, bench), strict=True) if not w[4]}
    out = {r["doc_id"]: r["size"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert out == {i: len(re.findall(r"[^\x20\x09-\x0D]+", x or "")) for i, x in clean.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-dedup", "suffix-array dedup", "benchmark decontamination", "source mixing"]


def test_near_dedup_keeps_null_ids_and_one_of_repeated_rows(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(60))
    texts = ["clean text", None, "other text", "again", "again", long, long + " x", long]
    ids = [None, None, None, 4, 4, 8, 9, 8]
    docs = docs_of(texts, ids=ids).select(*corpus_pipeline.COLUMNS)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(None, "clean text"), (None, None), (None, "other text"), (4, "again"), (8, long)], key=str)


def tables(spark, path, docs, labels=(), bench=()):
    clash = {c: F.lit("x") for c in ("score", "kept", "size", "th", "n", "gram", "runs", "item", "taken", "component_id")}
    docs.withColumns(clash).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").withColumns({"text": F.lit("x"), "score": F.lit(1)}).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string").withColumns({"words": F.lit("x"), "doc_id": F.lit(1)}).write.parquet(f"{path}/benchmark.parquet")
    return path


def test_empty_documents(spark, tmp_path, docs_of):
    path = tables(spark, str(tmp_path), docs_of([]).select(*corpus_pipeline.COLUMNS), [(1, 1, 0)], [(1, "a b c")])
    out = corpus_pipeline.run(spark, path)
    assert out.count() == 0 and out.columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_very_long_texts_and_clashing_names(spark, tmp_path, docs_of):
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [long, long + " end", "short and clean text", None, "leak " + " ".join(f"b{i}" for i in range(12))]
    path = tables(spark, str(tmp_path), docs_of(texts).select(*corpus_pipeline.COLUMNS), bench=[(7, " ".join(f"b{i}" for i in range(12)))])
    out = {r["doc_id"]: r["size"] for r in corpus_pipeline.run(spark, path).collect()}
    assert out == {0: 60_000, 2: 4, 3: 0}
