"""Queries of the snapshot operators, and the SQL they agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.functions import columns as C
from factmill.operators import snapshots as sx


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A part's tax rates by supplier as records; for even parts its least rate is the decision, for some a rate that isn't there."""
    lines = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_tax").cast("decimal(6,2)").alias("value"))
    decided = lines.groupBy("l_partkey", "l_suppkey").agg(F.min("value").alias("least")).where("l_partkey % 2 = 0").select("l_partkey", "l_suppkey", F.when(F.col("l_partkey") % 10 == 0, F.lit("9.99").cast("decimal(6,2)")).otherwise(F.col("least")).alias("value"))
    return sx.build(lines, ["l_partkey", "l_suppkey"], decided)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)[0].select("l_partkey", "l_suppkey", F.col("value").cast("double").alias("value"))


def exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)[1]


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return sx.pending(o.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey"), o.select("o_custkey", "o_orderpriority"), ["o_custkey"], F.col("o_orderpriority") == "1-URGENT")


def focus_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters with orders as periods, the fourth standing for the year."""
    o = _t(spark, sf_dir, "orders").select("o_custkey", F.last_day(F.make_date(F.year("o_orderdate"), F.quarter("o_orderdate") * 3, F.lit(1))).alias("period"))
    found = sx.focus_periods(o.withColumn("kind", C.period_type(F.col("period"))), "o_custkey", "period", "kind")
    return found.withColumn("period", F.col("period").cast("string"))


def exact_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sx.exact_conflicts(_t(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderstatus")


def causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    ordered = [("NOT_RETRIEVED", F.col("l_quantity") < 10), ("RANKED_LOW", F.col("l_discount") > 0.07), ("WRONG_PAGE", F.col("l_tax") == 0)]
    return sx.causes(lines, "id", ordered).groupBy("cause").agg(F.count("*").alias("n"))


def authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    citations = _t(spark, sf_dir, "lineitem").where("l_discount > 0.03").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    return sx.authority(_t(spark, sf_dir, "orders"), citations, "o_orderkey", _t(spark, sf_dir, "part").where("p_size > 5"), "p_partkey")


def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals in a readable unit, rounded half up."""
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    shown = o.select("o_custkey", C.large_number(F.col("v").cast("decimal(24,2)")).alias("shown"), C.large_number((F.col("v") * 100).cast("decimal(24,2)")).alias("hundredfold"))
    return shown


def item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select("p_partkey", C.item_name(F.concat(F.lit("1. "), F.col("p_name"), F.lit("（A）"))).alias("name"))
    return p.groupBy("name").agg(F.count("*").alias("n"))


QUERIES = {
    "snapshot_items": items, "snapshot_exceptions": exceptions, "pending_items": pending, "focus_periods": focus_periods, "exact_conflicts": exact_conflicts,
    "failure_causes": causes, "citation_authority": authority, "display_numbers": display, "item_names": item_names,
}

_BUILD = """r AS (SELECT l_partkey, l_suppkey, CAST(l_tax AS DECIMAL(6,2)) AS v FROM lineitem), g AS (SELECT l_partkey, l_suppkey, count(DISTINCT v) AS n, min(v) AS one, list(DISTINCT v) AS vs FROM r GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN l_partkey % 10 = 0 THEN CAST(9.99 AS DECIMAL(6,2)) WHEN l_partkey % 2 = 0 THEN one END AS chosen FROM g), b AS (SELECT *, CASE WHEN n = 1 THEN one WHEN list_contains(vs, chosen) THEN chosen END AS value FROM s)"""

ORACLE_SQL = {
    "snapshot_items": f"WITH {_BUILD} SELECT l_partkey, l_suppkey, CAST(value AS DOUBLE) AS value FROM b WHERE value IS NOT NULL",
    "snapshot_exceptions": f"WITH {_BUILD} SELECT l_partkey, l_suppkey, CASE WHEN chosen IS NULL THEN 'CONFLICT' ELSE 'DECISION_OUT_OF_SET' END AS reason, n FROM b WHERE value IS NULL",
    "pending_items": "SELECT o_custkey, o_orderkey FROM orders o WHERE o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_custkey = o.o_custkey AND d.o_orderpriority = '1-URGENT')",
    "focus_periods": """WITH p AS (SELECT DISTINCT o_custkey, last_day(make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1)) AS period FROM orders), k AS (SELECT *, CASE strftime(period, '%m-%d') WHEN '12-31' THEN 'annual' WHEN '06-30' THEN 'interim' ELSE 'quarterly' END AS kind FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, kind ORDER BY period DESC) AS n, max(CASE WHEN kind = 'annual' THEN period END) OVER (PARTITION BY o_custkey) AS top FROM k)
SELECT o_custkey, CAST(period AS VARCHAR) AS period, kind FROM n WHERE (kind = 'annual' AND n <= 3) OR (kind <> 'annual' AND n = 1 AND coalesce(period > top, true))""",
    "exact_conflicts": "SELECT o_custkey, o_orderpriority, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) > 1",
    "failure_causes": "SELECT CASE WHEN l_quantity < 10 THEN 'NOT_RETRIEVED' WHEN l_discount > CAST(0.07 AS DOUBLE) THEN 'RANKED_LOW' WHEN l_tax = 0 THEN 'WRONG_PAGE' ELSE 'UNKNOWN' END AS cause, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
    "citation_authority": """WITH c AS (SELECT l_orderkey, count(*) AS cited, count(p_partkey) AS resolved FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON p_partkey = l_partkey WHERE l_discount > CAST(0.03 AS DOUBLE) GROUP BY 1)
SELECT o_orderkey, coalesce(cited, 0) AS cited, coalesce(resolved, 0) AS resolved, CASE WHEN coalesce(cited, 0) = 0 THEN 'none' WHEN resolved < cited THEN 'broken' ELSE 'resolved' END AS verdict FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""",
    "item_names": "SELECT regexp_replace(lower(p_name) || 'a', '[^a-z0-9]+', '', 'g') AS name, count(*) AS n FROM part GROUP BY 1",
}
