"""The 28 financial formulas: each a value, a status and a reason, as columns over pivoted items.

One pivot and one pass compute all formulas of all companies and periods. Values are ratios of exact decimals taken in
double precision. Prior-period items are columns prior_<item>.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING, NO_PRIOR, MIXED = "MISSING_REQUIRED_ITEM", "MISSING_PRIOR_PERIOD", "MIXED_RECEIVABLE_BASIS_FORBIDDEN"


def _outcome(status: str, value: Column | None = None, reason: str | None = None) -> Column:
    number = F.lit(None).cast("double") if value is None else value.cast("double")
    return F.struct(number.alias("value"), F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))


def _num(c: Column) -> Column:
    return c.cast("double")


def _any_null(*items: Column) -> Column:
    return reduce(lambda a, b: a | b, (i.isNull() for i in items))


def _divided(a: Column, b: Column, status: str = "CALCULATED", reason: str | None = None) -> Column:
    return F.when(b == 0, _outcome("ZERO_DENOMINATOR", reason="ZERO_DENOMINATOR")).otherwise(_outcome(status, F.try_divide(_num(a), _num(b)), reason))


def ratio(top: Callable[..., Column], needs: list[str], bottom: str) -> Column:
    parts = [F.col(n) for n in needs]
    return F.when(_any_null(*parts, F.col(bottom)), _outcome("MISSING_INPUT", reason=MISSING)).otherwise(_divided(top(*parts), F.col(bottom)))


def simple(a: str, b: str) -> Column:
    return ratio(lambda x: x, [a], b)


def turnover(a: str, b: str) -> Column:
    now, before = F.col(b), F.col(f"prior_{b}")
    return (
        F.when(_any_null(F.col(a), now), _outcome("MISSING_INPUT", reason=MISSING))
        .when(before.isNull(), _outcome("MISSING_INPUT", reason=NO_PRIOR))
        .otherwise(_averaged(F.col(a), now, before))
    )


def _averaged(a: Column, now: Column, before: Column) -> Column:
    both = now + before
    return F.when(both == 0, _outcome("ZERO_DENOMINATOR", reason="ZERO_DENOMINATOR")).otherwise(_outcome("CALCULATED", F.try_divide(_num(a), _num(both) / 2)))


def growth(a: str, annual: Column) -> Column:
    now, before = F.col(a), F.col(f"prior_{a}")
    return (
        F.when(~annual, _outcome("NOT_APPLICABLE", reason="NOT_APPLICABLE"))
        .when(now.isNotNull() & before.isNull(), _outcome("MISSING_INPUT", reason=NO_PRIOR))
        .when(_any_null(now, before), _outcome("MISSING_INPUT", reason=MISSING))
        .otherwise(_divided(now - before, F.abs(before)))
    )


def total(*items: str) -> Column:
    parts = [F.col(i) for i in items]
    return F.when(_any_null(*parts), _outcome("MISSING_INPUT", reason=MISSING)).otherwise(_outcome("CALCULATED", reduce(lambda a, b: a + b, parts)))


def interest_cover() -> Column:
    profit, interest, finance = F.col("TOTAL_PROFIT"), F.col("INTEREST_EXPENSE"), F.col("FINANCE_EXPENSES")
    missing = _outcome("MISSING_INPUT", reason=MISSING)
    return (
        F.when(interest.isNotNull(), F.when(profit.isNull(), missing).otherwise(_divided(profit + interest, interest)))
        .when(finance.isNotNull(), F.when(profit.isNull(), missing).otherwise(_divided(profit + finance, finance, "CALCULATED_PROXY", "PROXY_FINANCE_EXPENSES")))
        .otherwise(missing)
    )


def receivable_turnover() -> Column:
    revenue, one, old = F.col("TOTAL_REVENUE"), F.col("ACCOUNTS_RECEIVABLE"), F.col("prior_ACCOUNTS_RECEIVABLE")
    all_, all_old = F.col("ACCOUNTS_RECEIVABLE_COMBINED"), F.col("prior_ACCOUNTS_RECEIVABLE_COMBINED")
    return (
        F.when(revenue.isNull(), _outcome("MISSING_INPUT", reason=MISSING))
        .when(one.isNotNull() & old.isNotNull(), _averaged(revenue, one, old))
        .when(all_.isNotNull() & all_old.isNotNull(), _averaged(revenue, all_, all_old))
        .when((one.isNotNull() | old.isNotNull()) & (all_.isNotNull() | all_old.isNotNull()), _outcome("MISSING_INPUT", reason=MIXED))
        .when(one.isNotNull() | all_.isNotNull(), _outcome("MISSING_INPUT", reason=NO_PRIOR))
        .otherwise(_outcome("MISSING_INPUT", reason=MISSING))
    )


DEBT = ["SHORT_TERM_BORROWINGS", "LONG_TERM_BORROWINGS", "BONDS_PAYABLE", "LEASE_LIABILITIES", "NON_CURRENT_LIAB_DUE_WITHIN_ONE_YEAR"]


def interest_bearing_debt() -> Column:
    parts = [F.col(i) for i in DEBT]
    known = reduce(lambda a, b: a + b, (p.isNotNull().cast("int") for p in parts))
    return (
        F.when(known == 0, _outcome("MISSING_INPUT", reason=MISSING)).when(known < len(parts), _outcome("PARTIAL_INPUT", reason=MISSING)).otherwise(_outcome("CALCULATED", reduce(lambda a, b: a + b, parts)))
    )


EXPENSES = ["SALES_EXPENSES", "ADMIN_EXPENSES", "R_AND_D_EXPENSES", "FINANCE_EXPENSES"]


def registry(annual: Column) -> dict[str, Column]:
    """All formulas by their ids."""
    quick = ratio(lambda a, b, c: a - b - c, ["CURRENT_ASSETS", "INVENTORY", "PREPAYMENTS"], "CURRENT_LIABILITIES")
    return {
        "SOLV_CURRENT_RATIO": simple("CURRENT_ASSETS", "CURRENT_LIABILITIES"),
        "SOLV_QUICK_RATIO": quick,
        "SOLV_DEBT_RATIO": simple("TOTAL_LIABILITIES", "TOTAL_ASSETS"),
        "SOLV_INTEREST_COVER": interest_cover(),
        "SOLV_EQUITY_MULT": simple("TOTAL_ASSETS", "TOTAL_EQUITY"),
        "PROF_GROSS_MARGIN": ratio(lambda r, c: r - c, ["TOTAL_REVENUE", "OPERATING_COST"], "TOTAL_REVENUE"),
        "PROF_NET_MARGIN": simple("NET_PROFIT", "TOTAL_REVENUE"),
        "PROF_ROE": simple("NET_PROFIT", "TOTAL_EQUITY"),
        "PROF_ROA": simple("NET_PROFIT", "TOTAL_ASSETS"),
        "PROF_OPER_MARGIN": simple("OPERATING_PROFIT", "TOTAL_REVENUE"),
        "OPER_ASSET_TURNOVER": turnover("TOTAL_REVENUE", "TOTAL_ASSETS"),
        "OPER_INV_TURNOVER": turnover("OPERATING_COST", "INVENTORY"),
        "OPER_AR_TURNOVER": receivable_turnover(),
        "CASH_OCF_TO_NP": simple("OPERATING_CASH_FLOW", "NET_PROFIT"),
        "CASH_OCF_TO_ASSET": simple("OPERATING_CASH_FLOW", "TOTAL_ASSETS"),
        "CASH_OCF_TO_REV": simple("OPERATING_CASH_FLOW", "TOTAL_REVENUE"),
        "EXP_PERIOD_RATE": ratio(lambda *x: reduce(lambda a, b: a + b, x), EXPENSES, "TOTAL_REVENUE"),
        "GROWTH_REVENUE": growth("TOTAL_REVENUE", annual),
        "GROWTH_NET_PROFIT": growth("NET_PROFIT", annual),
        "GROWTH_ASSET": growth("TOTAL_ASSETS", annual),
        "GROWTH_LIABILITY": growth("TOTAL_LIABILITIES", annual),
        "GROWTH_EQUITY": growth("TOTAL_EQUITY", annual),
        "GROWTH_OCF": growth("OPERATING_CASH_FLOW", annual),
        "GROWTH_ICF": growth("INVESTING_CASH_FLOW", annual),
        "GROWTH_FINANCING_CASH_FLOW": growth("FINANCING_CASH_FLOW", annual),
        "EBITDA": total("TOTAL_PROFIT", "INTEREST_EXPENSE", "DEPRECIATION", "AMORTIZATION"),
        "INTEREST_BEARING_DEBT": interest_bearing_debt(),
        "FREE_CASH_FLOW": F.when(_any_null(F.col("OPERATING_CASH_FLOW"), F.col("CAPEX")), _outcome("MISSING_INPUT", reason=MISSING)).otherwise(_outcome("CALCULATED", F.col("OPERATING_CASH_FLOW") - F.col("CAPEX"))),
    }


ITEMS = [
    "CURRENT_ASSETS", "CURRENT_LIABILITIES", "INVENTORY", "PREPAYMENTS", "TOTAL_ASSETS", "TOTAL_LIABILITIES", "TOTAL_EQUITY", "TOTAL_REVENUE", "OPERATING_COST",
    "NET_PROFIT", "OPERATING_PROFIT", "TOTAL_PROFIT", "INTEREST_EXPENSE", "FINANCE_EXPENSES", "SALES_EXPENSES", "ADMIN_EXPENSES", "R_AND_D_EXPENSES",
    "ACCOUNTS_RECEIVABLE", "ACCOUNTS_RECEIVABLE_COMBINED", "OPERATING_CASH_FLOW", "INVESTING_CASH_FLOW", "FINANCING_CASH_FLOW", "DEPRECIATION", "AMORTIZATION", "CAPEX", *DEBT,
]


def compute(snapshot: DataFrame, annual: Column | None = None, only: list[str] | None = None) -> DataFrame:
    """Long rows (company, period, formula_id, value, status, reason) of the formulas over a snapshot with prior items.

    `only` names the formulas wanted; an unknown name is an error.
    """
    known = registry(F.lit(True) if annual is None else annual)
    if only and (unknown := sorted(set(only) - set(known))):
        raise ValueError(f"unknown formulas: {', '.join(unknown)}")
    rows = F.array(*(F.struct(F.lit(k).alias("formula_id"), known[k].alias("o")) for k in only or known))
    return snapshot.select("company", "period", F.explode(rows).alias("f")).select("company", "period", "f.formula_id", "f.o.value", "f.o.status", "f.o.reason")


def with_blocked(metrics: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Metrics of companies with a blocking exception become BLOCKED, without a value."""
    stopped = exceptions.where("blocked").select("company").distinct().withColumn("stop", F.lit(True))
    joined = metrics.join(stopped, "company", "left")
    stop = F.coalesce("stop", F.lit(False))
    return joined.select("company", "period", "formula_id", F.when(~stop, F.col("value")).alias("value"), F.when(stop, "BLOCKED").otherwise(F.col("status")).alias("status"), F.when(stop, "BLOCKING_EXCEPTION").otherwise(F.col("reason")).alias("reason"))
