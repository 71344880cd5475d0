"""Snapshots: admission of reconciled records, exceptions, pending decisions, and the periods a report shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build(records: DataFrame, key: list[str], decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and exceptions of a snapshot. A key with one distinct value is an item; one with several needs a decision
    (key and value): without it, or with one for a value that isn't there, it is an exception.
    """
    grouped = records.where("value is not null").groupBy(*key).agg(F.count_distinct("value").alias("n"), F.min("value").alias("one"), F.collect_set("value").alias("values"))
    joined = grouped.join(decided.select(*key, F.col("value").alias("chosen")), key, "left")
    admitted = F.when(F.col("n") == 1, F.col("one")).when(F.array_contains("values", F.col("chosen")), F.col("chosen"))
    reason = F.when(F.col("chosen").isNull(), "CONFLICT").otherwise("DECISION_OUT_OF_SET")
    state = joined.withColumn("value", admitted)
    return state.where("value is not null").select(*key, "value"), state.where("value is null").select(*key, reason.alias("reason"), "n")


def pending(issues: DataFrame, decisions: DataFrame, key: list[str], active: Column) -> DataFrame:
    """Issues without an active decision."""
    return issues.join(decisions.where(active), key, "left_anti")


def focus_periods(rows: DataFrame, key: str, period: str, kind: str, annual: int = 3) -> DataFrame:
    """The last annual periods of each key and its latest period of another kind that is later than all of them."""
    last = F.row_number().over(Window.partitionBy(key, kind).orderBy(F.desc(period)))
    distinct = rows.select(key, period, kind).distinct().withColumn("n", last)
    top = F.max(F.when(F.col(kind) == "annual", F.col(period))).over(Window.partitionBy(key))
    return distinct.withColumn("top", top).where(((F.col(kind) == "annual") & (F.col("n") <= annual)) | ((F.col(kind) != "annual") & (F.col("n") == 1) & (F.coalesce(F.col(period) > F.col("top"), F.lit(True))))).select(key, period, kind)


def exact_conflicts(rows: DataFrame, key: list[str], identity: str) -> DataFrame:
    """Keys that more than one identity claims."""
    return rows.groupBy(*key).agg(F.count_distinct(identity).alias("n")).where("n > 1")


def causes(rows: DataFrame, id_: str, ordered: list[tuple[str, Column]]) -> DataFrame:
    """Each failed row's cause, by fixed precedence."""
    return rows.select(id_, F.coalesce(*(F.when(c, F.lit(name)) for name, c in ordered), F.lit("UNKNOWN")).alias("cause"))


def authority(claims: DataFrame, citations: DataFrame, claim: str, evidence: DataFrame, key: str) -> DataFrame:
    """Per claim: its citations, how many resolve, and a verdict: none, broken, or resolved."""
    known = citations.join(evidence.select(key).distinct().withColumn("known", F.lit(True)), key, "left")
    counted = known.groupBy(claim).agg(F.count("*").alias("cited"), F.count("known").alias("resolved"))
    joined = claims.select(claim).join(counted, claim, "left").select(claim, F.coalesce("cited", F.lit(0)).alias("cited"), F.coalesce("resolved", F.lit(0)).alias("resolved"))
    return joined.withColumn("verdict", F.when(F.col("cited") == 0, "none").when(F.col("resolved") < F.col("cited"), "broken").otherwise("resolved"))
