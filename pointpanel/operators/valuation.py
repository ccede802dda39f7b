"""Valuation ratios per filing, priced on the filing's own publication date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointpanel.functions.valuation import ratio_columns
from pointpanel.operators.asof import asof_join


def price_at_report(fundamentals: DataFrame, bars: DataFrame) -> DataFrame:
    return asof_join(fundamentals, bars, "reported_date", "date", {"close": "price", "date": "price_date"})


def ratios(fundamentals: DataFrame, bars: DataFrame) -> DataFrame:
    priced = price_at_report(fundamentals, bars)
    return priced.select(
        "security_id", "reported_date", "price", *[c.alias(n) for n, c in ratio_columns("price").items()]
    )
