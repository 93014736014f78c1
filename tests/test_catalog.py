from __future__ import annotations

import duckdb
from oracle import compare

import sparkloom.plans  # noqa: F401
from sparkloom.registry import ORACLES, QUERIES


def test_tables_of_any_name_are_described(spark, tmp_path):
    con = duckdb.connect()
    for name, columns in (("region", "1 AS r_regionkey"), ("invoices", "1 AS id, 'x' AS note")):
        con.execute(f"COPY (SELECT {columns}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    assert compare(QUERIES["A17_catalog"](spark, str(tmp_path)), con, ORACLES["A17_catalog"]) is None
