"""Performance figures of value curves, for all strategies at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
TRADING_DAYS = 252
REBALANCES_PER_YEAR = {"Monthly": 12, "Quarterly": 4, "Annual": 1}


def cagr(begin: Column, end: Column, days: Column) -> Column:
    ratio = end / F.when(begin > 0, begin)
    return (
        F.when((begin <= 0) | (days <= 0), 0.0)
        .when(ratio <= 0, -1.0)
        .otherwise(F.pow(ratio, F.lit(365.0) / F.when(days > 0, days)) - 1.0)
    )


def sharpe(ret: Column, risk_free_daily: float = 0.0) -> Column:
    """Mean excess over its population deviation, annualised; 0 for a flat series."""
    sd = F.stddev_pop(ret)
    return F.when(sd > 0, F.avg(ret - risk_free_daily) / sd * F.sqrt(F.lit(float(TRADING_DAYS)))).otherwise(0.0)


def sortino(ret: Column) -> Column:
    down = F.sqrt(F.avg(F.pow(F.least(ret, F.lit(0.0)), F.lit(2.0))))
    return F.when(down > 0, F.avg(ret) / down * F.sqrt(F.lit(float(TRADING_DAYS)))).otherwise(0.0)


def win_rate(ret: Column) -> Column:
    return F.count_if(ret > 0) / F.count(ret)


def with_returns(curve: DataFrame, value: str = "nav", key: str = "strategy_id") -> DataFrame:
    prev = F.lag(value).over(Window.partitionBy(key).orderBy("date"))
    return curve.withColumn("ret", F.when(prev == 0, 0.0).otherwise(F.col(value) / prev - 1.0))


def with_drawdown(curve: DataFrame, value: str = "nav", key: str = "strategy_id") -> DataFrame:
    peak = F.max(value).over(Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return curve.withColumn("_peak", peak).withColumn(
        "drawdown", F.when(F.col("_peak") > 0, F.col(value) / F.col("_peak") - 1.0)
    ).drop("_peak")


def span(value: str) -> dict[str, Column]:
    return {
        "begin": F.min_by(value, "date"), "end": F.max_by(value, "date"),
        "days": F.datediff(F.max("date"), F.min("date")),
    }


def summary(curve: DataFrame, values: DataFrame, per_year: int | str) -> DataFrame:
    """One row per strategy: growth net and gross, risk, hit rate, turnover and costs. ``per_year`` counts rebalances, or names the column of
    ``values`` that does."""
    yearly = F.lit(per_year) if isinstance(per_year, int) else F.max(per_year)
    rows = with_drawdown(with_returns(curve))
    net, gross = span("nav"), span("gross_nav")
    figures = rows.groupBy("strategy_id").agg(
        cagr(net["begin"], net["end"], net["days"]).alias("cagr_net"),
        cagr(gross["begin"], gross["end"], gross["days"]).alias("cagr_gross"),
        F.least(F.lit(0.0), F.min("drawdown")).alias("max_drawdown"),
        sharpe(F.col("ret")).alias("sharpe"),
        sortino(F.col("ret")).alias("sortino"),
        win_rate(F.col("ret")).alias("win_rate"),
    )
    turned = values.groupBy("strategy_id").agg(
        (F.avg("turnover") * yearly).alias("annual_turnover"), F.sum("costs").alias("total_costs")
    )
    return figures.join(turned, "strategy_id", "left")


def rebase(benchmark: DataFrame, capital: float, start: str, end: str) -> DataFrame:
    """Index values as money from ``capital`` on, with the growth rate of first to last; fewer than two points: none."""
    inside = benchmark.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    v = "total_return_index_value"
    ends = inside.groupBy("ticker").agg(
        *[c.alias(f"_{k}") for k, c in span(v).items()], F.count(F.lit(1)).alias("_n")
    )
    return (
        inside.join(ends, "ticker")
        .filter((F.col("_n") >= 2) & (F.col("_begin") > 0))
        .select(
            "ticker", "date", (F.col(v) / F.col("_begin") * capital).alias("nav"),
            cagr(F.col("_begin"), F.col("_end"), F.col("_days")).alias("cagr"),
        )
    )
