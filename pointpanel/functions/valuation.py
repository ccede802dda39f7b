"""Valuation ratios as column expressions: a ratio that means nothing is null, never negative or infinite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def over_positive(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def market_cap(price: Column, shares: Column) -> Column:
    return F.when((price > 0) & (shares > 0), price * shares)


def ratio_columns(price: str = "price") -> dict[str, Column]:
    """All derived ratios of a fundamentals row that already carries its own-date price."""
    c = F.col
    cap = market_cap(c(price), c("shares_outstanding"))
    none = F.lit(None).cast("double")
    return {
        "market_cap": cap,
        "pe": over_positive(cap, c("net_income")),
        "pb": over_positive(cap, c("shareholders_equity")),
        "ps": over_positive(cap, c("revenue")),
        "roe": over_positive(c("net_income"), c("shareholders_equity")) * 100,
        "debt_to_equity": over_positive(c("total_debt"), c("shareholders_equity")),
        "gross_margin": over_positive(c("revenue") - c("cost_of_revenue"), c("revenue")) * 100,
        "roic": none,
        "fcf_yield": none,
    }
