"""The older ratios in floating point: neighbouring listed periods instead of computed ones, and no statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factmill.functions.columns import growth, safe_divide

#: Growth columns and the items that they are of.
GROWTH = {
    "revenue_growth": "TOTAL_REVENUE",
    "profit_growth": "NET_PROFIT",
    "assets_growth": "TOTAL_ASSETS",
    "liabilities_growth": "TOTAL_LIABILITIES",
    "equity_growth": "TOTAL_EQUITY",
    "operating_cash_growth": "OPERATING_CASH_FLOW",
    "investing_cash_growth": "INVESTING_CASH_FLOW",
    "financing_cash_growth": "FINANCING_CASH_FLOW",
}


def legacy_ratios(items: DataFrame, company: str, period: str) -> DataFrame:
    """17 ratios and 8 growths of every listed period, null where a part is missing or divides by zero.

    Averages are with the period listed before. A year's growth is against the nearest earlier year listed, any other
    period's against the one listed before. Receivables of zero count as missing, as those with notes then replace them.
    Periods are dates, one row each; a company's periods are few, so its windows are short.
    """
    v = lambda name: F.col(name).cast("double")
    year_end = (F.month(period) == 12) & (F.dayofmonth(period) == 31)
    rows = items.withColumn("_year_end", year_end).withColumn("_receivables", F.coalesce(F.nullif(v("ACCOUNTS_RECEIVABLE"), F.lit(0.0)), v("ACCOUNTS_RECEIVABLE_COMBINED")))
    listed = Window.partitionBy(company).orderBy(period)
    alike = Window.partitionBy(company, "_year_end").orderBy(period)

    def mean(c: Column) -> Column:
        return (c + F.lag(c).over(listed)) / 2

    def grown(name: str) -> Column:
        return growth(v(name), F.when(F.col("_year_end"), F.lag(v(name)).over(alike)).otherwise(F.lag(v(name)).over(listed)))

    assets, liabilities, equity, revenue, profit = (v(k) for k in ("TOTAL_ASSETS", "TOTAL_LIABILITIES", "TOTAL_EQUITY", "TOTAL_REVENUE", "NET_PROFIT"))
    current, due, stock, cost, finance, cash = (v(k) for k in ("CURRENT_ASSETS", "CURRENT_LIABILITIES", "INVENTORY", "OPERATING_COST", "FINANCE_EXPENSES", "OPERATING_CASH_FLOW"))
    spent = v("SALES_EXPENSES") + v("ADMIN_EXPENSES") + v("R_AND_D_EXPENSES") + finance
    ratios = {
        "current_ratio": safe_divide(current, due),
        "quick_ratio": safe_divide(current - stock, due),
        "debt_ratio": safe_divide(liabilities, assets),
        "interest_cover": safe_divide(v("TOTAL_PROFIT") + finance, finance),
        "equity_multiplier": safe_divide(assets, equity),
        "gross_margin": safe_divide(revenue - cost, revenue),
        "net_margin": safe_divide(profit, revenue),
        "roe": safe_divide(profit, equity),
        "roa": safe_divide(profit, assets),
        "operating_margin": safe_divide(v("OPERATING_PROFIT"), revenue),
        "asset_turnover": safe_divide(revenue, mean(assets)),
        "inventory_turnover": safe_divide(cost, mean(stock)),
        "receivables_turnover": safe_divide(revenue, mean(F.col("_receivables"))),
        "cash_to_profit": safe_divide(cash, profit),
        "cash_to_assets": safe_divide(cash, assets),
        "cash_to_revenue": safe_divide(cash, revenue),
        "expense_ratio": safe_divide(spent, revenue),
    }
    return rows.select(company, period, *(c.alias(k) for k, c in ratios.items()), *(grown(i).alias(k) for k, i in GROWTH.items()))
