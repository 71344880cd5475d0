"""Claims against evidence: value presence, provenance, rules, budgets, routing and precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_presence(claims: DataFrame, evidence: DataFrame, key: str, value: str, amount: str, unit: str) -> DataFrame:
    """Each claim's value among the amounts of its evidence, within half the claim's step.

    SUPPORTED if the matching amounts have one unit, AMBIGUOUS if several, UNSUPPORTED if none matches.
    """
    hit = F.abs(F.col(amount) - F.col(value)) <= F.col("step") / 2
    joined = claims.join(evidence.select(key, amount, unit), key, "left")
    found = joined.groupBy("claim_id").agg(F.count_distinct(F.when(hit, F.col(unit))).alias("units"), F.count_if(hit).alias("n"))
    return found.select("claim_id", "n", F.when(F.col("units") == 0, "UNSUPPORTED").when(F.col("units") == 1, "SUPPORTED").otherwise("AMBIGUOUS").alias("verdict"))


def closed_set(claims: DataFrame, members: DataFrame, key: str, total: str, member: str) -> DataFrame:
    """Claimed totals against the distinct members that were listed."""
    counted = members.groupBy(key).agg(F.count_distinct(member).alias("counted"))
    return claims.join(counted, key, "left").select(key, total, F.coalesce("counted", F.lit(0)).alias("counted"), (F.col(total) == F.coalesce("counted", F.lit(0))).alias("closed"))


def first_difference(fields: dict[str, tuple[Column, Column]]) -> Column:
    """The first field, in the given order, in which two facts differ; SAME if none does; INCOMPARABLE where a side is null."""
    branches = [F.when(a.isNull() | b.isNull(), F.lit("INCOMPARABLE")).when(a != b, F.lit(name)) for name, (a, b) in fields.items()]
    return F.coalesce(*branches, F.lit("SAME"))


def direction(text: Column, up: list[str], down: list[str]) -> Column:
    """up, down, both or null by the words that the text holds."""
    any_of = lambda words: reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))
    return F.when(any_of(up) & any_of(down), "both").when(any_of(up), "up").when(any_of(down), "down")


def first_limit(limits: list[tuple[str, Column, float]]) -> Column:
    """The first limit, in order, that a measure exceeds."""
    return F.coalesce(*(F.when(measure > most, F.lit(name)) for name, measure, most in limits))


def evaluate(rows: DataFrame, id_: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """One issue (id, rule, severity) per rule that a row breaks; all rules in one pass."""
    broken = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, (severity, bad) in rules.items())))
    return rows.select(F.col(id_), F.explode(broken).alias("i")).select(id_, "i.rule", "i.severity")


def status(issues: DataFrame, id_: str, precedence: list[str]) -> DataFrame:
    """The most severe issue of each row."""
    rank = reduce(lambda out, p: F.when(F.col("severity") == p[1], p[0]).otherwise(out), enumerate(precedence), F.lit(len(precedence)))
    worst = F.min_by("severity", rank)
    return issues.groupBy(id_).agg(worst.alias("status"), F.count("*").alias("n_issues"))


def ordered_route(rules: list[tuple[str, Column]], fallback: str) -> Column:
    """The first rule that applies."""
    out = F.lit(fallback)
    for name, applies in reversed(rules):
        out = F.when(F.coalesce(applies, F.lit(False)), name).otherwise(out)
    return out


def alias_matches(names: DataFrame, id_: str, name: str, aliases: DataFrame) -> DataFrame:
    """Which code each name maps to by its words: (alias, code, exclude). Unique, ambiguous or none.

    A code whose exclude word the name also holds is vetoed. Names meet aliases by word, not by scanning all aliases.
    """
    words = names.select(id_, F.explode(F.array_distinct(F.split(F.col(name), " "))).alias("alias"))
    hits = words.join(aliases, "alias")
    vetoed = hits.join(words.withColumnRenamed("alias", "exclude"), [id_, "exclude"], "left_anti")
    codes = vetoed.groupBy(id_).agg(F.count_distinct("code").alias("n"), F.min("code").alias("code"))
    state = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    return names.select(id_).join(codes, id_, "left").select(id_, state.alias("state"), F.when(F.col("n") == 1, F.col("code")).alias("code"))


def markers(text: Column) -> Column:
    """The ids of all {{fact:id}} markers, in order."""
    return F.regexp_extract_all(text, F.lit(r"\{\{fact:([A-Za-z0-9_-]+)\}\}"), F.lit(1))


def bare_number(text: Column) -> Column:
    """Whether a number stands outside markers."""
    return F.regexp_replace(text, r"\{\{fact:[A-Za-z0-9_-]+\}\}", "").rlike("[0-9]")


def filled(texts: DataFrame, facts: DataFrame, id_: str, text: str) -> DataFrame:
    """Texts with every marker replaced by its fact's display; a marker without a fact stays."""
    parts = texts.select(id_, F.posexplode(F.split(F.col(text), r"(?=\{\{fact:)|(?<=\}\})")).alias("at", "part"))
    key = F.regexp_extract("part", r"^\{\{fact:([A-Za-z0-9_-]+)\}\}$", 1)
    shown = parts.withColumn("fact_id", F.when(key != "", key)).join(facts, "fact_id", "left").select(id_, "at", F.coalesce("display", "part").alias("part"))
    return shown.groupBy(id_).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("filled"))


def split_by_priority(rows: DataFrame, key: str, order: list[Column], top: int) -> DataFrame:
    """Marks each key's first `top` rows."""
    return rows.withColumn("focus", F.row_number().over(Window.partitionBy(key).orderBy(*order)) <= top)


def sufficiency(sources: DataFrame, key: str) -> DataFrame:
    """Whether a key's sources suffice: one of grade A or B, or two independent hosts of grade C."""
    hosts = F.count_distinct(F.when(F.col("grade") == "C", F.col("host")))
    strong = F.count_if(F.col("grade").isin("A", "B"))
    return sources.groupBy(key).agg(strong.alias("strong"), hosts.alias("independent"), ((strong >= 1) | (hosts >= 2)).alias("sufficient"))
