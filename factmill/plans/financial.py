"""Queries of the financial operators, over facts derived from orders and their lines, and the SQL they agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.functions import columns as C
from factmill.operators import facts as fx
from factmill.operators import formulas as fm

_P, _D, _T, _Q = "cast(l_extendedprice as decimal(14,2))", "cast(l_discount as decimal(6,2))", "cast(l_tax as decimal(6,2))", "cast(l_quantity as decimal(10,2))"

#: What stands for each item of a company (a customer) in a period (a year): a sum over its lines.
ITEM_SQL = {
    "CURRENT_ASSETS": (_P, "l_linestatus = 'O'"),
    "CURRENT_LIABILITIES": (f"{_P} * {_D}", "l_linestatus = 'O'"),
    "INVENTORY": (_Q, "l_returnflag = 'A'"),
    "PREPAYMENTS": (f"{_P} * {_T}", "l_linenumber = 1"),
    "TOTAL_ASSETS": (_P, "true"),
    "TOTAL_LIABILITIES": (f"{_P} * {_D}", "true"),
    "TOTAL_EQUITY": (f"{_P} - {_P} * {_D}", "true"),
    "TOTAL_REVENUE": (f"{_P} - {_P} * {_D}", "true"),
    "OPERATING_COST": (f"{_P} - {_P} * {_D}", "l_returnflag <> 'R'"),
    "NET_PROFIT": (f"{_P} - {_P} * {_D}", "l_returnflag = 'R'"),
    "OPERATING_PROFIT": (f"{_P} * {_T}", "l_returnflag = 'N'"),
    "TOTAL_PROFIT": (f"{_P} * {_T}", "true"),
    "INTEREST_EXPENSE": (f"{_P} * {_D}", "l_linenumber = 5"),
    "FINANCE_EXPENSES": (f"{_P} * {_D}", "l_linenumber = 4"),
    "SALES_EXPENSES": (f"{_P} * {_T}", "l_linenumber = 1"),
    "ADMIN_EXPENSES": (f"{_P} * {_T}", "l_linenumber = 2"),
    "R_AND_D_EXPENSES": (f"{_P} * {_T}", "l_linenumber = 3"),
    "ACCOUNTS_RECEIVABLE": (_P, "l_linenumber = 6"),
    "ACCOUNTS_RECEIVABLE_COMBINED": (_P, "l_linenumber in (3, 5, 6)"),
    "OPERATING_CASH_FLOW": (f"{_P} * {_T} - {_P} * {_D}", "true"),
    "INVESTING_CASH_FLOW": (_Q, "l_linestatus = 'F'"),
    "FINANCING_CASH_FLOW": (f"{_Q} - cast(25 as decimal(10,2))", "true"),
    "DEPRECIATION": (_Q, "l_linenumber = 1"),
    "AMORTIZATION": (_Q, "l_linenumber = 2"),
    "CAPEX": (_Q, "l_linenumber = 3"),
    **{name: (_P, f"l_linenumber = {k + 1}") for k, name in enumerate(fm.DEBT)},
}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pivoted items of every company and year, in one pass over the lines: filter and sum are one aggregation."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("company"), F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)).alias("period"))
    lines = _t(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("company", "period").agg(*(F.expr(f"cast(sum({v}) filter (where {c}) as decimal(38,4))").alias(k) for k, (v, c) in ITEM_SQL.items()))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = fx.with_prior(snapshot(spark, sf_dir), fm.ITEMS, C.prior_period(F.col("period"), F.lit("annual")))
    return fm.compute(wide)


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("period", F.col("period").cast("string"))


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(metrics(spark, sf_dir))


def metric_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).groupBy("formula_id", "status", "reason").agg(F.count("*").alias("n"))


def legacy_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth against the nearest earlier year that exists, in floating point."""
    one = snapshot(spark, sf_dir).select("company", F.year("period").cast("long").alias("year"), F.col("TOTAL_REVENUE").cast("double").alias("revenue"))
    from pyspark.sql import Window

    earlier = Window.partitionBy("company").orderBy("year")
    before = F.lag("revenue").over(earlier)
    return one.select("company", "year", F.lag("year").over(earlier).alias("base_year"), C.growth(F.col("revenue"), before).alias("growth"))


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's total in the header against its lines', each known to a step."""
    lines = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.expr(f"cast(sum({_P}) as decimal(20,2))").alias("value"))
    header = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit("header").alias("source"), F.expr("cast(round(cast(o_totalprice as decimal(20,2)), -3) as decimal(20,2))").alias("value"), F.lit(1000).cast("decimal(20,2)").alias("step"))
    detail = lines.select("k", F.lit("lines").alias("source"), "value", F.lit("0.01").cast("decimal(20,2)").alias("step"))
    out = fx.reconcile(header.unionByName(detail), ["k"])
    return out.select("k", "n_sources", "state", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three identities of each company and year, within half a step a term."""
    s = snapshot(spark, sf_dir)
    unit = F.lit("0.01").cast("decimal(10,2)")
    named = {
        "balance": (F.col("TOTAL_ASSETS"), F.col("TOTAL_LIABILITIES") + F.col("TOTAL_EQUITY"), 3),
        "profit": (F.col("TOTAL_REVENUE") - F.col("OPERATING_COST"), F.col("NET_PROFIT"), 3),
        "receivable": (F.col("ACCOUNTS_RECEIVABLE_COMBINED"), F.col("ACCOUNTS_RECEIVABLE"), 2),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("check_type"), fx.identity_check(a, b, fx.tolerance(unit, n)).alias("status"), (a - b).cast("double").alias("diff")) for k, (a, b, n) in named.items()))
    return _dated(s.select("company", "period", F.explode(rows).alias("c")).select("company", "period", "c.*"))


def value_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a part has one price, several or none among its lines of a year, with the price."""
    lines = _t(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_partkey").alias("company"), F.col("l_returnflag").alias("item"), F.year("l_shipdate").alias("period"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("value"))
    return fx.value_index(rows)


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first condition that an order fails, by counts."""
    o = _t(spark, sf_dir, "orders")
    tests = {"statement_type": F.col("o_orderstatus").isin("F", "O"), "period": F.year("o_orderdate") < 2000, "scope": F.col("o_orderpriority") != "5-LOW", "currency": F.col("o_totalprice") > 50_000}
    return o.select(fx.first_failing(tests).alias("failed")).groupBy(F.coalesce("failed", F.lit("admitted")).alias("failed")).agg(F.count("*").alias("n"))


def missing_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of an event's fields are missing, as counts of each combination."""
    e = _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.k").alias("k"), "event_type", F.when(F.col("value") > 10, F.col("value")).alias("value"))
    return fx.missing_dimensions(e, ["event_type", "value", "page"]).groupBy(F.concat_ws(",", "missing").alias("missing")).agg(F.count("*").alias("n"))


def restatements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem")
    return fx.restatement_families(lines, ["l_partkey", "l_suppkey"], "l_returnflag")


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("kind"), (F.col("o_totalprice") > 200_000).alias("critical"))
    return fx.blocked(o, ["1-URGENT"], ["2-HIGH", "3-MEDIUM"], F.col("critical"))


def segment_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("company"), F.year("l_shipdate").alias("period"), F.col("l_returnflag").alias("segment"), F.expr(f"cast({_P} as decimal(38,4))").alias("revenue"), F.expr(f"case when l_linestatus = 'F' then cast({_P} * {_D} as decimal(38,4)) end").alias("cost")
    )
    return fx.segment_shares(lines)


def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshot(spark, sf_dir).select("company", "period", "TOTAL_REVENUE")
    return fx.trend(s, ["company"], "period", "TOTAL_REVENUE")


def oversize_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items above a tenth of a company's assets, or that moved by more than 30 % from the year before."""
    names = ["INVENTORY", "PREPAYMENTS", "CURRENT_LIABILITIES", "ACCOUNTS_RECEIVABLE", "CAPEX"]
    s = fx.with_prior(snapshot(spark, sf_dir), [*names], C.prior_period(F.col("period"), F.lit("annual")))
    rows = F.array(*(F.struct(F.lit(n).alias("item"), F.col(n).alias("now"), F.col(f"prior_{n}").alias("before")) for n in names))
    long = s.select("company", "period", "TOTAL_ASSETS", F.explode(rows).alias("r")).select("company", "period", "TOTAL_ASSETS", "r.*").where("now is not null")
    share = C.safe_divide(F.col("now").cast("double"), F.col("TOTAL_ASSETS").cast("double"))
    change = C.growth(F.col("now").cast("double"), F.col("before").cast("double"))
    return _dated(long.select("company", "period", "item", share.alias("share"), change.alias("change")).where((F.col("share") > 0.1) | (F.abs("change") > 0.3)))


def stale_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose last order is later than the snapshot of their year before last, with the reason."""
    o = _t(spark, sf_dir, "orders")
    head = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_status"))
    taken = o.where("o_orderdate < timestamp '2000-01-01 00:00:00'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    reasons = F.array_compact(F.array(F.when(F.col("last_order") > F.col("at"), F.lit("records_moved")), F.when(F.col("last_status") != F.col("status"), F.lit("status_changed"))))
    return taken.join(head, "o_custkey").select("o_custkey", F.concat_ws(",", reasons).alias("reasons")).where("reasons <> ''")


QUERIES = {
    "formulas": formulas,
    "metric_status": metric_status,
    "legacy_growth": legacy_growth,
    "reconcile_intervals": reconcile,
    "identity_checks": checks,
    "value_index": value_index,
    "admission": admission,
    "missing_dimensions": missing_dimensions,
    "restatement_families": restatements,
    "blocking_flags": blocked,
    "segment_shares": segment_shares,
    "trend": trend,
    "oversize_items": oversize_items,
    "stale_snapshots": stale_snapshots,
}

# --- the same in SQL -------------------------------------------------------------------------------------------------

_SNAPSHOT = "s AS (SELECT o_custkey AS company, make_date(year(o_orderdate), 12, 31) AS period, " + ", ".join(f"CAST(sum({v}) FILTER (WHERE {c}) AS DECIMAL(38,4)) AS {k}" for k, (v, c) in ITEM_SQL.items()) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
_PRIOR = "w AS (SELECT s.*, " + ", ".join(f"p.{i} AS prior_{i}" for i in fm.ITEMS) + " FROM s LEFT JOIN s p ON p.company = s.company AND year(p.period) = year(s.period) - 1)"


def _sql(status: str, value: str = "CAST(NULL AS DOUBLE)", reason: str | None = None) -> tuple[str, str, str]:
    return value, f"'{status}'", f"'{reason}'" if reason else "NULL"


def _case(*branches: tuple[str, tuple[str, str, str]]) -> list[str]:
    """The three CASE expressions of an outcome; the last branch's condition is 'else'."""
    return ["CASE " + " ".join((f"WHEN {c} THEN {o[k]}" if c != "else" else f"ELSE {o[k]}") for c, o in branches) + " END" for k in range(3)]


def _over(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE)"


_MISS, _NOPRIOR, _ZERO = _sql("MISSING_INPUT", reason=fm.MISSING), _sql("MISSING_INPUT", reason=fm.NO_PRIOR), _sql("ZERO_DENOMINATOR", reason="ZERO_DENOMINATOR")


def _null(*items: str) -> str:
    return "(" + " OR ".join(f"{i} IS NULL" for i in items) + ")"


def _ratio(top: str, needs: list[str], bottom: str) -> list[str]:
    return _case((_null(*needs, bottom), _MISS), (f"{bottom} = 0", _ZERO), ("else", _sql("CALCULATED", _over(f"({top})", bottom))))


def _turnover(a: str, b: str) -> list[str]:
    return _case((_null(a, b), _MISS), (f"prior_{b} IS NULL", _NOPRIOR), (f"{b} + prior_{b} = 0", _ZERO), ("else", _sql("CALCULATED", f"CAST({a} AS DOUBLE) / (CAST({b} + prior_{b} AS DOUBLE) / 2)")))


def _growth(a: str) -> list[str]:
    return _case((f"{a} IS NOT NULL AND prior_{a} IS NULL", _NOPRIOR), (_null(a, f"prior_{a}"), _MISS), (f"prior_{a} = 0", _ZERO), ("else", _sql("CALCULATED", _over(f"({a} - prior_{a})", f"abs(prior_{a})"))))


_AR, _ARC = "ACCOUNTS_RECEIVABLE", "ACCOUNTS_RECEIVABLE_COMBINED"
_FORMULAS = {
    "SOLV_CURRENT_RATIO": _ratio("CURRENT_ASSETS", ["CURRENT_ASSETS"], "CURRENT_LIABILITIES"),
    "SOLV_QUICK_RATIO": _ratio("CURRENT_ASSETS - INVENTORY - PREPAYMENTS", ["CURRENT_ASSETS", "INVENTORY", "PREPAYMENTS"], "CURRENT_LIABILITIES"),
    "SOLV_DEBT_RATIO": _ratio("TOTAL_LIABILITIES", ["TOTAL_LIABILITIES"], "TOTAL_ASSETS"),
    "SOLV_INTEREST_COVER": _case(
        ("INTEREST_EXPENSE IS NOT NULL AND TOTAL_PROFIT IS NULL", _MISS),
        ("INTEREST_EXPENSE = 0", _ZERO),
        ("INTEREST_EXPENSE IS NOT NULL", _sql("CALCULATED", _over("(TOTAL_PROFIT + INTEREST_EXPENSE)", "INTEREST_EXPENSE"))),
        ("FINANCE_EXPENSES IS NULL OR TOTAL_PROFIT IS NULL", _MISS),
        ("FINANCE_EXPENSES = 0", _ZERO),
        ("else", _sql("CALCULATED_PROXY", _over("(TOTAL_PROFIT + FINANCE_EXPENSES)", "FINANCE_EXPENSES"), "PROXY_FINANCE_EXPENSES")),
    ),
    "SOLV_EQUITY_MULT": _ratio("TOTAL_ASSETS", ["TOTAL_ASSETS"], "TOTAL_EQUITY"),
    "PROF_GROSS_MARGIN": _ratio("TOTAL_REVENUE - OPERATING_COST", ["OPERATING_COST"], "TOTAL_REVENUE"),
    "PROF_NET_MARGIN": _ratio("NET_PROFIT", ["NET_PROFIT"], "TOTAL_REVENUE"),
    "PROF_ROE": _ratio("NET_PROFIT", ["NET_PROFIT"], "TOTAL_EQUITY"),
    "PROF_ROA": _ratio("NET_PROFIT", ["NET_PROFIT"], "TOTAL_ASSETS"),
    "PROF_OPER_MARGIN": _ratio("OPERATING_PROFIT", ["OPERATING_PROFIT"], "TOTAL_REVENUE"),
    "OPER_ASSET_TURNOVER": _turnover("TOTAL_REVENUE", "TOTAL_ASSETS"),
    "OPER_INV_TURNOVER": _turnover("OPERATING_COST", "INVENTORY"),
    "OPER_AR_TURNOVER": _case(
        ("TOTAL_REVENUE IS NULL", _MISS),
        (f"{_AR} IS NOT NULL AND prior_{_AR} IS NOT NULL AND {_AR} + prior_{_AR} = 0", _ZERO),
        (f"{_AR} IS NOT NULL AND prior_{_AR} IS NOT NULL", _sql("CALCULATED", f"CAST(TOTAL_REVENUE AS DOUBLE) / (CAST({_AR} + prior_{_AR} AS DOUBLE) / 2)")),
        (f"{_ARC} IS NOT NULL AND prior_{_ARC} IS NOT NULL AND {_ARC} + prior_{_ARC} = 0", _ZERO),
        (f"{_ARC} IS NOT NULL AND prior_{_ARC} IS NOT NULL", _sql("CALCULATED", f"CAST(TOTAL_REVENUE AS DOUBLE) / (CAST({_ARC} + prior_{_ARC} AS DOUBLE) / 2)")),
        (f"({_AR} IS NOT NULL OR prior_{_AR} IS NOT NULL) AND ({_ARC} IS NOT NULL OR prior_{_ARC} IS NOT NULL)", _sql("MISSING_INPUT", reason=fm.MIXED)),
        (f"{_AR} IS NOT NULL OR {_ARC} IS NOT NULL", _NOPRIOR),
        ("else", _MISS),
    ),
    "CASH_OCF_TO_NP": _ratio("OPERATING_CASH_FLOW", ["OPERATING_CASH_FLOW"], "NET_PROFIT"),
    "CASH_OCF_TO_ASSET": _ratio("OPERATING_CASH_FLOW", ["OPERATING_CASH_FLOW"], "TOTAL_ASSETS"),
    "CASH_OCF_TO_REV": _ratio("OPERATING_CASH_FLOW", ["OPERATING_CASH_FLOW"], "TOTAL_REVENUE"),
    "EXP_PERIOD_RATE": _ratio(" + ".join(fm.EXPENSES), fm.EXPENSES, "TOTAL_REVENUE"),
    "GROWTH_REVENUE": _growth("TOTAL_REVENUE"),
    "GROWTH_NET_PROFIT": _growth("NET_PROFIT"),
    "GROWTH_ASSET": _growth("TOTAL_ASSETS"),
    "GROWTH_LIABILITY": _growth("TOTAL_LIABILITIES"),
    "GROWTH_EQUITY": _growth("TOTAL_EQUITY"),
    "GROWTH_OCF": _growth("OPERATING_CASH_FLOW"),
    "GROWTH_ICF": _growth("INVESTING_CASH_FLOW"),
    "GROWTH_FINANCING_CASH_FLOW": _growth("FINANCING_CASH_FLOW"),
    "EBITDA": _case((_null("TOTAL_PROFIT", "INTEREST_EXPENSE", "DEPRECIATION", "AMORTIZATION"), _MISS), ("else", _sql("CALCULATED", "CAST(TOTAL_PROFIT + INTEREST_EXPENSE + DEPRECIATION + AMORTIZATION AS DOUBLE)"))),
    "INTEREST_BEARING_DEBT": _case(
        ("(" + " AND ".join(f"{i} IS NULL" for i in fm.DEBT) + ")", _MISS), (_null(*fm.DEBT), _sql("PARTIAL_INPUT", reason=fm.MISSING)), ("else", _sql("CALCULATED", f"CAST({' + '.join(fm.DEBT)} AS DOUBLE)"))
    ),
    "FREE_CASH_FLOW": _case((_null("OPERATING_CASH_FLOW", "CAPEX"), _MISS), ("else", _sql("CALCULATED", "CAST(OPERATING_CASH_FLOW - CAPEX AS DOUBLE)"))),
}
_METRICS = f"WITH {_SNAPSHOT}, {_PRIOR}, m AS (" + " UNION ALL ".join(f"SELECT company, period, '{k}' AS formula_id, {v} AS value, {s} AS status, {r} AS reason FROM w" for k, (v, s, r) in _FORMULAS.items()) + ")"

ORACLE_SQL = {
    "formulas": f"{_METRICS} SELECT company, CAST(period AS VARCHAR) AS period, formula_id, value, status, CAST(reason AS VARCHAR) AS reason FROM m",
    "metric_status": f"{_METRICS} SELECT formula_id, status, CAST(reason AS VARCHAR) AS reason, count(*) AS n FROM m GROUP BY ALL",
    "legacy_growth": f"""WITH {_SNAPSHOT}, y AS (SELECT company, CAST(year(period) AS BIGINT) AS year, CAST(TOTAL_REVENUE AS DOUBLE) AS revenue FROM s),
b AS (SELECT *, lag(revenue) OVER o AS before, lag(year) OVER o AS base_year FROM y WINDOW o AS (PARTITION BY company ORDER BY year))
SELECT company, year, base_year, CASE WHEN before <> 0 THEN (revenue - before) / abs(before) END AS growth FROM b""",
    "reconcile_intervals": f"""
WITH r AS (SELECT o_orderkey AS k, 'header' AS source, CAST(round(CAST(o_totalprice AS DECIMAL(20,2)), -3) AS DOUBLE) AS value, 1000.0 AS step FROM orders
UNION ALL SELECT l_orderkey, 'lines', CAST(sum({_P}) AS DOUBLE), 0.01 FROM lineitem GROUP BY 1),
g AS (SELECT k, count(DISTINCT source) AS n_sources, max(value - step / 2) AS low, min(value + step / 2) AS high FROM r GROUP BY k)
SELECT k, n_sources, CASE WHEN n_sources = 1 THEN 'SINGLE_SOURCE' WHEN low <= high THEN 'MATCHED' ELSE 'CONFLICT' END AS state,
       CASE WHEN n_sources > 1 AND low <= high THEN low END AS low, CASE WHEN n_sources > 1 AND low <= high THEN high END AS high FROM g""",
    "identity_checks": f"""WITH {_SNAPSHOT}, c AS (
SELECT company, period, 'balance' AS check_type, TOTAL_ASSETS AS a, TOTAL_LIABILITIES + TOTAL_EQUITY AS b, 0.015 AS t FROM s
UNION ALL SELECT company, period, 'profit', TOTAL_REVENUE - OPERATING_COST, NET_PROFIT, 0.015 FROM s
UNION ALL SELECT company, period, 'receivable', ACCOUNTS_RECEIVABLE_COMBINED, ACCOUNTS_RECEIVABLE, 0.01 FROM s)
SELECT company, CAST(period AS VARCHAR) AS period, check_type, CASE WHEN a IS NULL OR b IS NULL THEN 'not_applicable' WHEN abs(a - b) <= t THEN 'pass' ELSE 'fail' END AS status, CAST(a - b AS DOUBLE) AS diff FROM c""",
    "value_index": """SELECT l_partkey AS company, l_returnflag AS item, CAST(year(l_shipdate) AS INTEGER) AS period,
CASE count(DISTINCT v) WHEN 1 THEN 'one' WHEN 0 THEN 'missing' ELSE 'ambiguous' END AS state, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS value
FROM (SELECT *, CASE WHEN l_discount > 0 THEN l_discount END AS v FROM lineitem) GROUP BY 1, 2, 3""",
    "admission": """SELECT CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'statement_type' WHEN NOT year(o_orderdate) < 2000 THEN 'period' WHEN o_orderpriority = '5-LOW' THEN 'scope'
WHEN NOT o_totalprice > 50000 THEN 'currency' ELSE 'admitted' END AS failed, count(*) AS n FROM orders GROUP BY 1""",
    "missing_dimensions": """SELECT concat_ws(',', CASE WHEN coalesce(event_type, '') = '' THEN 'event_type' END, CASE WHEN value IS NULL OR NOT value > 10 THEN 'value' END,
CASE WHEN coalesce(json_extract_string(props, '$.page'), '') = '' THEN 'page' END) AS missing, count(*) AS n FROM events GROUP BY 1""",
    "restatement_families": "SELECT l_partkey, l_suppkey, count(DISTINCT l_returnflag) AS n_versions FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1",
    "blocking_flags": "SELECT o_custkey AS company, bool_or(o_orderpriority = '1-URGENT' OR (o_orderpriority IN ('2-HIGH', '3-MEDIUM') AND o_totalprice > 200000)) AS blocked FROM orders GROUP BY 1",
    "segment_shares": f"""WITH l AS (SELECT l_suppkey AS company, CAST(year(l_shipdate) AS INTEGER) AS period, l_returnflag AS segment, {_P} AS revenue, CASE WHEN l_linestatus = 'F' THEN {_P} * {_D} END AS cost FROM lineitem),
o AS (SELECT company, period, segment, sum(revenue) AS revenue, sum(cost) AS cost FROM l GROUP BY 1, 2, 3), t AS (SELECT company, period, sum(revenue) AS total FROM l GROUP BY 1, 2)
SELECT company, period, segment, CASE WHEN total <> 0 THEN {_over("revenue", "total")} END AS share, CASE WHEN revenue <> 0 THEN {_over("(revenue - cost)", "revenue")} END AS margin FROM o JOIN t USING (company, period)""",
    "trend": f"""WITH {_SNAPSHOT}, d AS (SELECT company, TOTAL_REVENUE AS v, lag(TOTAL_REVENUE) OVER (PARTITION BY company ORDER BY period) AS b FROM s WHERE TOTAL_REVENUE IS NOT NULL)
SELECT company, count(*) AS n, CASE WHEN count(*) < 2 THEN NULL WHEN bool_and(v > b) THEN 'up' WHEN bool_and(v < b) THEN 'down' WHEN bool_and(v = b) THEN 'flat' ELSE 'mixed' END AS trend FROM d GROUP BY 1""",
    "oversize_items": f"WITH {_SNAPSHOT}, {_PRIOR}, r AS ("
    + " UNION ALL ".join(f"SELECT company, period, '{n}' AS item, {n} AS now, prior_{n} AS before, TOTAL_ASSETS AS total FROM w WHERE {n} IS NOT NULL" for n in ("INVENTORY", "PREPAYMENTS", "CURRENT_LIABILITIES", "ACCOUNTS_RECEIVABLE", "CAPEX"))
    + f"), x AS (SELECT company, CAST(period AS VARCHAR) AS period, item, CASE WHEN total <> 0 THEN {_over('now', 'total')} END AS share, CASE WHEN before <> 0 THEN (CAST(now AS DOUBLE) - CAST(before AS DOUBLE)) / abs(CAST(before AS DOUBLE)) END AS change FROM r) SELECT * FROM x WHERE share > 0.1 OR abs(change) > 0.3",
    "stale_snapshots": """WITH h AS (SELECT o_custkey, max(o_orderdate) AS l, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS ls FROM orders GROUP BY 1),
t AS (SELECT o_custkey, max(o_orderdate) AS a, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS st FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1)
SELECT * FROM (SELECT o_custkey, concat_ws(',', CASE WHEN l > a THEN 'records_moved' END, CASE WHEN ls <> st THEN 'status_changed' END) AS reasons FROM t JOIN h USING (o_custkey)) WHERE reasons <> ''""",
}
