"""Queries of the claim operators, and the SQL they agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.functions import columns as C
from factmill.operators import claims as cx
from factmill.operators import retrieval as rx
from factmill.plans.evidence import GRADE_SQL, GRADED_URL

ALIASES = [("small", "SIZE_SMALL", "large"), ("red", "COLOR_RED", "none"), ("blue", "COLOR_BLUE", "none"), ("large", "SIZE_LARGE", "small"), ("part", "PART", "red"), ("green", "COLOR_GREEN", "none")]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claim_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on an order's largest line, half of them off by one, against its lines."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(14,2)").alias("amount"), F.col("l_returnflag").alias("unit"))
    claims = lines.groupBy("l_orderkey").agg((F.max("amount") + F.col("l_orderkey") % 2).cast("decimal(16,2)").alias("value")).withColumns({"claim_id": F.col("l_orderkey"), "step": F.lit("0.02").cast("decimal(6,2)")})
    return cx.value_presence(claims, lines, "l_orderkey", "value", "amount", "unit")


def closed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("total"))
    return cx.closed_set(claims, _t(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "total", "l_partkey")


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a line and its order first differ."""
    joined = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    verdict = cx.first_difference({"DIFFERENT_PERIOD": (F.year("l_shipdate"), F.year("o_orderdate")), "DIFFERENT_SCOPE": (F.col("l_linestatus"), F.col("o_orderstatus")), "CONFLICT": (F.col("l_quantity") > 25, F.col("o_totalprice") > 150_000)})
    return joined.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    return d.groupBy("lang", cx.direction(F.col("text"), ["over", "onan"], ["unde", "thwh"]).alias("direction")).agg(F.count("*").alias("n"))


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first limit that a user's events exceed."""
    e = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("calls"), F.sum(F.col("value").cast("decimal(18,4)")).alias("cost"))
    limit = cx.first_limit([("errors", F.col("errors"), 25), ("calls", F.col("calls"), 70), ("cost", F.col("cost"), 3000)])
    return e.select("user_id", limit.alias("exceeded"))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "blocking_policy": ("blocking", F.col("o_orderstatus") == "P"),
        "coverage": ("rework", F.col("o_totalprice") < 50_000),
        "citation": ("rework", F.col("o_orderpriority") == "4-NOT SPECIFIED"),
        "freshness": ("warning", F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")),
    }
    return cx.evaluate(_t(spark, sf_dir, "orders"), "o_orderkey", rules)


def rule_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir)


def rule_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.status(_issues(spark, sf_dir), "o_orderkey", ["blocking", "rework", "warning"])


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    rules = [("external", F.contains("text", F.lit("@"))), ("structured", F.col("text").rlike("[0-9]{6,}")), ("deep", F.length("text") > 4000), ("direct", F.length("text") < 300)]
    return d.groupBy(cx.ordered_route(rules, "standard").alias("route")).agg(F.count("*").alias("n"))


def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _t(spark, sf_dir, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("name"))
    return cx.alias_matches(names, "p_partkey", "name", spark.createDataFrame(ALIASES, "alias string, code string, exclude string"))


def marker_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with markers of a supplier's facts, filled, with what a checker sees in them."""
    s = _t(spark, sf_dir, "supplier")
    texts = s.select("s_suppkey", F.concat(F.lit("Balance {{fact:b"), F.col("s_suppkey").cast("string"), F.lit("}} in nation {{fact:n"), F.col("s_nationkey").cast("string"), F.lit("}}, see {{fact:none}}"), F.when(F.col("s_suppkey") % 3 == 0, " 42").otherwise("")).alias("text"))
    facts = s.select(F.concat(F.lit("b"), F.col("s_suppkey").cast("string")).alias("fact_id"), F.col("s_name").alias("display")).unionAll(_t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), "n_name"))
    filled = cx.filled(texts, facts, "s_suppkey", "text")
    return texts.join(filled, "s_suppkey").select("s_suppkey", "filled", F.size(cx.markers(F.col("text"))).cast("long").alias("n_markers"), cx.bare_number(F.col("text")).alias("bare"))


def focus_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    return cx.split_by_priority(o, "o_custkey", [F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")], 5).select("o_orderkey", "focus")


def sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "pages").select(F.length("html").alias("n"), F.expr(GRADED_URL).alias("url")).select("n", C.host(F.col("url")).alias("host"), C.host_grade(F.col("url")).alias("grade"))
    return cx.sufficiency(p.withColumn("topic", F.col("n") % 10), "topic")


def boosted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc"), F.col("l_extendedprice").alias("score"), F.col("l_returnflag").alias("kind"))
    lines = lines.groupBy("query", "doc", "kind").agg(F.max("score").alias("score"))
    return rx.boosted(lines, "kind", {"A": 1.25, "R": 0.95}, 4).select("query", "doc", F.col("rank").cast("long").alias("rank"))


def run_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.expr("round(percentile(value, 0.5), 6)").alias("p50"), F.expr("round(percentile(value, 0.95), 6)").alias("p95"), F.round(F.avg(F.col("value").cast("decimal(18,6)")).cast("double"), 6).alias("mean"))


QUERIES = {
    "claim_values": claim_values, "closed_sets": closed_sets, "provenance": provenance, "directions": directions, "budget_limits": budgets, "rule_issues": rule_issues, "rule_status": rule_status,
    "routes": routes, "alias_map": alias_map, "marker_fill": marker_fill, "focus_split": focus_split, "source_sufficiency": sufficiency, "boosted_rank": boosted_rank, "run_aggregates": run_aggregates,
}

_ISSUES = """i AS (SELECT o_orderkey, 'blocking_policy' AS rule, 'blocking' AS severity, 0 AS r FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'coverage', 'rework', 1 FROM orders WHERE o_totalprice < 50000 UNION ALL SELECT o_orderkey, 'citation', 'rework', 1 FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'
UNION ALL SELECT o_orderkey, 'freshness', 'warning', 2 FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')"""
_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\.', '')"

ORACLE_SQL = {
    "claim_values": """WITH l AS (SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(14,2)) AS amount, l_returnflag AS unit FROM lineitem), c AS (SELECT l_orderkey, max(amount) + l_orderkey % 2 AS value FROM l GROUP BY l_orderkey),
j AS (SELECT l_orderkey AS claim_id, count(DISTINCT CASE WHEN abs(amount - value) <= 0.01 THEN unit END) AS units, count(*) FILTER (abs(amount - value) <= 0.01) AS n FROM c JOIN l USING (l_orderkey) GROUP BY 1)
SELECT claim_id, n, CASE units WHEN 0 THEN 'UNSUPPORTED' WHEN 1 THEN 'SUPPORTED' ELSE 'AMBIGUOUS' END AS verdict FROM j""",
    "closed_sets": "SELECT o_orderkey, o_orderkey % 7 + 1 AS total, count(DISTINCT l_partkey) AS counted, o_orderkey % 7 + 1 = count(DISTINCT l_partkey) AS closed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "provenance": """SELECT CASE WHEN year(l_shipdate) <> year(o_orderdate) THEN 'DIFFERENT_PERIOD' WHEN l_linestatus <> o_orderstatus THEN 'DIFFERENT_SCOPE' WHEN (l_quantity > 25) <> (o_totalprice > 150000) THEN 'CONFLICT' ELSE 'SAME' END AS verdict, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "directions": """WITH d AS (SELECT lang, contains(text, 'over') OR contains(text, 'onan') AS u, contains(text, 'unde') OR contains(text, 'thwh') AS w FROM documents)
SELECT lang, CASE WHEN u AND w THEN 'both' WHEN u THEN 'up' WHEN w THEN 'down' END AS direction, count(*) AS n FROM d GROUP BY 1, 2""",
    "budget_limits": "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') > 25 THEN 'errors' WHEN count(*) > 70 THEN 'calls' WHEN sum(CAST(value AS DECIMAL(18,4))) > 3000 THEN 'cost' END AS exceeded FROM events GROUP BY 1",
    "rule_issues": f"WITH {_ISSUES} SELECT o_orderkey, rule, severity FROM i",
    "rule_status": f"WITH {_ISSUES} SELECT o_orderkey, arg_min(severity, r) AS status, count(*) AS n_issues FROM i GROUP BY 1",
    "routes": "SELECT CASE WHEN contains(text, '@') THEN 'external' WHEN regexp_matches(text, '[0-9]{6,}') THEN 'structured' WHEN length(text) > 4000 THEN 'deep' WHEN length(text) < 300 THEN 'direct' ELSE 'standard' END AS route, count(*) AS n FROM documents GROUP BY 1",
    "alias_map": "WITH w AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS alias FROM part), a(alias, code, exclude) AS (VALUES "
    + ", ".join(f"('{a}', '{c}', '{e}')" for a, c, e in ALIASES)
    + """), h AS (SELECT w.p_partkey, code FROM w JOIN a USING (alias) WHERE NOT EXISTS (SELECT 1 FROM w x WHERE x.p_partkey = w.p_partkey AND x.alias = a.exclude)), n AS (SELECT p_partkey, count(DISTINCT code) AS n, min(code) AS code FROM h GROUP BY 1)
SELECT part.p_partkey, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS state, CASE WHEN n = 1 THEN code END AS code FROM part LEFT JOIN n USING (p_partkey)""",
    "marker_fill": "SELECT s_suppkey, 'Balance ' || s_name || ' in nation ' || n_name || ', see {{fact:none}}' || CASE WHEN s_suppkey % 3 = 0 THEN ' 42' ELSE '' END AS filled, CAST(3 AS BIGINT) AS n_markers, s_suppkey % 3 = 0 AS bare FROM supplier JOIN nation ON n_nationkey = s_nationkey",
    "focus_split": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) <= 5 AS focus FROM orders",
    "source_sufficiency": f"""WITH h AS (SELECT length(html) % 10 AS topic, {_HOST} AS host FROM (SELECT html, {GRADED_URL} AS url FROM pages)), g AS (SELECT *, {GRADE_SQL} AS grade FROM h)
SELECT CAST(topic AS INTEGER) AS topic, count(*) FILTER (grade IN ('A', 'B')) AS strong, count(DISTINCT CASE WHEN grade = 'C' THEN host END) AS independent, count(*) FILTER (grade IN ('A', 'B')) >= 1 OR count(DISTINCT CASE WHEN grade = 'C' THEN host END) >= 2 AS sufficient FROM g GROUP BY 1""",
    "boosted_rank": """WITH l AS (SELECT l_suppkey AS query, l_orderkey * 10 + l_linenumber AS doc, l_returnflag AS kind, max(l_extendedprice) AS s FROM lineitem GROUP BY ALL),
r AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY s * CASE kind WHEN 'A' THEN CAST(1.25 AS DOUBLE) WHEN 'R' THEN CAST(0.95 AS DOUBLE) ELSE 1 END DESC, doc) AS rank FROM l) SELECT query, doc, rank FROM r WHERE rank <= 4""",
    "run_aggregates": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(*), 6) AS mean FROM events GROUP BY 1",
}
