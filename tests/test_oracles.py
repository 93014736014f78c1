"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import compare, duck

import sparkloom.plans  # noqa: F401
from sparkloom.registry import ORACLES, QUERIES

#: At this size all documents have vectors.
EMPTY_HERE = {"C3_missing_embeddings"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, con, name):
    difference = compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert difference is None or name in EMPTY_HERE and difference == "no rows"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).limit(3).collect()
    if name == "F10_embed_missing":  # at this size all documents have vectors
        done = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id AS doc_id")
        assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").join(done, "doc_id", "left_anti").count() == 0
    else:
        assert rows


def test_entry_is_stable(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "score", "vec_rank", "fts_rank", "matched_tags"]
    assert df.count() > 0
