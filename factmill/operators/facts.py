"""Financial facts: long rows (company, item, period, value), their pivot, and the checks that precede formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.functions import columns as C

KEY = ["company", "item", "period"]


def missing_dimensions(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds `missing`: the names whose value is null or empty, in the given order."""
    gaps = F.array(*(F.when(F.coalesce(F.col(n).cast("string"), F.lit("")) == "", F.lit(n)) for n in names))
    return df.withColumn("missing", F.array_compact(gaps))


def first_failing(conditions: dict[str, Column]) -> Column:
    """The name of the first condition that doesn't hold, in the given order; null if all do."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in conditions.items()))


def value_index(facts: DataFrame) -> DataFrame:
    """One row per key: its state (one, missing or ambiguous by the distinct values present) and the value if it is one."""
    n = F.count_distinct("value")
    return facts.groupBy(*KEY).agg(
        F.when(n == 1, "one").when(n == 0, "missing").otherwise("ambiguous").alias("state"),
        F.when(n == 1, F.min("value")).alias("value"),
    )


def snapshot_items(facts: DataFrame, items: list[str]) -> DataFrame:
    """A row per company and period with a column per item: the value where the key has exactly one, else null."""
    return facts.where(F.col("item").isin(*items)).groupBy("company", "period").agg(*(F.when(F.min(F.when(F.col("item") == i, F.col("value"))) == F.max(F.when(F.col("item") == i, F.col("value"))), F.min(F.when(F.col("item") == i, F.col("value")))).alias(i) for i in items))


def with_prior(snapshot: DataFrame, items: list[str], prior: Column) -> DataFrame:
    """Adds the items of the period that `prior` computes for each row, as columns prior_<item>: a self-join on a
    computed key, so a gap in the periods leaves nulls rather than a further period."""
    before = snapshot.select(F.col("company"), F.col("period").alias("prior"), *(F.col(i).alias(f"prior_{i}") for i in items))
    return snapshot.withColumn("prior", prior).join(before, ["company", "prior"], "left")


def reconcile(records: DataFrame, key: list[str], value: str = "value", step: str = "step", source: str = "source") -> DataFrame:
    """Cross-source state of each key: the intervals value ± step/2 of its records have a common point, or not.

    Touching intervals match. Keys with a null value are INSUFFICIENT_SCOPE, with one source SINGLE_SOURCE.
    """
    low, high = F.max(F.col(value) - F.col(step) / 2), F.min(F.col(value) + F.col(step) / 2)
    grouped = records.groupBy(*key).agg(
        F.count_distinct(source).alias("n_sources"), F.count_if(F.col(value).isNull() | F.col(step).isNull()).alias("n_null"), low.alias("low"), high.alias("high")
    )
    state = F.when(F.col("n_null") > 0, "INSUFFICIENT_SCOPE").when(F.col("n_sources") == 1, "SINGLE_SOURCE").when(F.col("low") <= F.col("high"), "MATCHED").otherwise("CONFLICT")
    return grouped.select(*key, "n_sources", state.alias("state"), F.when(state == "MATCHED", F.col("low")).alias("low"), F.when(state == "MATCHED", F.col("high")).alias("high"))


def tolerance(step: Column, terms: int) -> Column:
    """Half a display step for each term of an identity; nothing if the step is unknown."""
    return F.coalesce(step / 2 * terms, F.lit(0))


def identity_check(left: Column, right: Column, allowed: Column) -> Column:
    """pass, fail, or not_applicable where a side is missing."""
    return F.when(left.isNull() | right.isNull(), "not_applicable").when(F.abs(left - right) <= allowed, "pass").otherwise("fail")


def restatement_families(records: DataFrame, key: list[str], version: str) -> DataFrame:
    """Keys with more than one restatement version, which need an explicit choice."""
    return records.groupBy(*key).agg(F.count_distinct(version).alias("n_versions")).where("n_versions > 1")


def blocked(exceptions: DataFrame, always: list[str], conditional: list[str], critical: Column) -> DataFrame:
    """Per company, whether any exception blocks its report."""
    stops = F.col("kind").isin(*always) | (F.col("kind").isin(*conditional) & critical)
    return exceptions.groupBy("company").agg(F.bool_or(stops).alias("blocked"))


def segment_shares(facts: DataFrame) -> DataFrame:
    """Per company, period and segment: revenue's share of all segments' and the gross margin, null without a cost."""
    total = facts.groupBy("company", "period").agg(F.sum("revenue").alias("total"))
    one = facts.groupBy("company", "period", "segment").agg(F.sum("revenue").alias("revenue"), F.sum("cost").alias("cost"))
    joined = one.join(total, ["company", "period"])
    as_double = lambda n: F.col(n).cast("double")
    return joined.select("company", "period", "segment", C.safe_divide(as_double("revenue"), as_double("total")).alias("share"), C.safe_divide((F.col("revenue") - F.col("cost")).cast("double"), as_double("revenue")).alias("margin"))


def trend(series: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Relation over a key's ordered values: up, down or flat if all steps are, else mixed; null for fewer than two."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value])  # a key's periods: tens
    grouped = series.where(F.col(value).isNotNull()).groupBy(*key).agg(ordered.alias("v"))
    steps = F.zip_with(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))), F.slice("v", 1, F.greatest(F.size("v") - 1, F.lit(0))), lambda b, a: F.signum((b - a).cast("double")))
    named = F.when(F.size("v") < 2, None).when(F.forall(steps, lambda x: x > 0), "up").when(F.forall(steps, lambda x: x < 0), "down").when(F.forall(steps, lambda x: x == 0), "flat").otherwise("mixed")
    return grouped.select(*key, F.size("v").cast("long").alias("n"), named.alias("trend"))
