"""All queries of the engine and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factmill.plans import evidence, financial, ledger, narrative, reading, review, snapshots

_PLANS = (financial, evidence, review, snapshots, narrative, ledger, reading)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for p in _PLANS for k, f in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for p in _PLANS for k, s in p.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All formulas of all companies and periods."""
    return financial.formulas(spark, sf_dir)
