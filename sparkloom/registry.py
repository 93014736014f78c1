"""Where queries and their SQL oracles are registered, side by side."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) -> DataFrame, with the DuckDB SQL that gives the same rows."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Spark SQL over input tables and given frames, written {name}."""
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: frames[n] if n in frames else table(spark, sf_dir, n) for n in names})


def shared(name: str, text: str, duck: str | None = None) -> None:
    """Register a query whose SQL both engines read. RX(text, pattern) is a regular-expression search; `duck` is the
    oracle where the dialects differ."""
    QUERIES[name] = lambda spark, sf_dir: sql(spark, sf_dir, text.replace("RX(", "regexp_like("))
    ORACLES[name] = (duck or text).replace("RX(", "regexp_matches(").replace("{", "").replace("}", "")
