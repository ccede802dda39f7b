"""Rebalanced equal-weight portfolios as relations, many strategies in one job.

Convention, per strategy and rebalance leg k (a day-by-day walk is not replicated, it is restated in closed form):

* targets weigh 1/n each at the fill price; a target that finds no fill stays in cash for the leg;
* a holding's growth on day t is (S*P + D) / fill, with S the product of 1/factor of its splits, bonuses and rights since
  the execution, P the last close (carried over missing days) and D the dividends paid on S;
* a holding leaves for cash on its delisting date (at zero after a bankruptcy) or on its sixth missing day running, and its
  value stays frozen from there to the end of the leg;
* G(t) is the weighted growth of the leg, T the traded weight (differences below 0.0001 are not traded) and
  V(k+1) = V(k) * (G(k) - c*T(k)), with c the cost and slippage rate. Trades scale with V, so V is a running product.

Deviations from a walk that keeps share counts: trades are sized at the fill date's value, an unfilled sale exits at the
last mark, drifted weights ignore the cost just paid.

Growth depends on (leg, security) alone and is computed once, whatever the number of strategies. Everything after the
selection is bounded by positions x legs x days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointpanel.operators.actions import PRICE_ACTIONS

# Fixed values.
MAX_CARRY_DAYS = 5
MIN_TRADE_WEIGHT = 0.0001
COST_BPS = 23.0
SLIPPAGE_BPS = 5.0


def transaction_cost(notional, cost_bps=COST_BPS, slippage_bps=SLIPPAGE_BPS):
    return notional * (F.lit(cost_bps) + F.lit(slippage_bps)) / 10000.0


def targets_with_fills(signals: DataFrame, fills: DataFrame) -> DataFrame:
    """(strategy_id, rebalance_no, security_id) with its weight and fill; weight 0 where nothing could be bought."""
    size = signals.groupBy("strategy_id", "rebalance_no").agg(F.count(F.lit(1)).alias("n_targets"))
    return (
        signals.join(size, ["strategy_id", "rebalance_no"])
        .join(fills, ["rebalance_no", "security_id"], "left")
        .withColumn("weight", F.when(F.col("fill_price") > 0, 1.0 / F.col("n_targets")).otherwise(0.0))
    )


def leg_days(legs: DataFrame, days: DataFrame) -> DataFrame:
    """Trading days after the execution up to the leg's end, as one array per leg. Both inputs are calendars."""
    spans = legs.filter(F.col("period_end") > F.col("execution_date")).select(
        "rebalance_no", F.explode(F.sequence(F.date_add("execution_date", 1), F.col("period_end"))).alias("date"))
    return (
        spans.join(days, "date")
        .groupBy("rebalance_no")
        .agg(F.sort_array(F.collect_list("date")).alias("days"))
    )


def holding_days(
    held: DataFrame, legs: DataFrame, days: DataFrame, bars: DataFrame, factors: DataFrame, securities: DataFrame,
    carry: int = MAX_CARRY_DAYS,
) -> DataFrame:
    """Every held (leg, security) on every trading day of its leg, with price, share factor, dividends and growth.

    ``held``: rebalance_no, security_id, fill_price. The calendar of a leg is attached by broadcast and exploded in
    place, so the grid needs no shuffle of its own; bars arrive already hashed on (security_id, date).
    """
    grid = held.join(F.broadcast(leg_days(legs, days)), "rebalance_no").select(
        "rebalance_no", "security_id", "fill_price", F.explode("days").alias("date")
    )
    shares = F.when(F.col("action_type").isin(*PRICE_ACTIONS) & (F.col("factor") > 0), 1.0 / F.col("factor"))
    effects = factors.groupBy("security_id", F.col("effective_date").alias("date")).agg(
        F.product(F.coalesce(shares, F.lit(1.0))).alias("share_step"),
        F.sum(F.when(F.col("action_type") == "Dividend", F.col("dividend_amount"))).alias("dividend"),
    )
    exits = securities.filter(F.col("delisted_date").isNotNull()).select(
        "security_id", "delisted_date", "delisting_reason"
    )
    w = Window.partitionBy("rebalance_no", "security_id").orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        grid.join(bars.select("security_id", "date", "close"), ["security_id", "date"], "left")
        .join(effects, ["security_id", "date"], "left")
        .join(exits, "security_id", "left")
        .withColumn("day_no", F.row_number().over(w))
        .withColumns({
            "gap": F.col("day_no") - F.coalesce(F.max(F.when(F.col("close").isNotNull(), F.col("day_no"))).over(run), F.lit(0)),
            "price": F.coalesce(F.last("close", ignorenulls=True).over(run), F.col("fill_price")),
            "share_factor": F.product(F.coalesce("share_step", F.lit(1.0))).over(run),
        })
        .withColumn(
            "dividends", F.sum(F.coalesce("dividend", F.lit(0.0)) * F.col("share_factor")).over(run)
        )
    )
    delisted = F.coalesce(F.col("date") == F.col("delisted_date"), F.lit(False))
    reason = F.when(delisted, "delisted").when(F.col("gap") > carry, "missing")
    exit_price = F.when(delisted & (F.col("delisting_reason") == "Bankruptcy"), 0.0).otherwise(F.col("price"))
    rows = rows.withColumn("value", F.col("share_factor") * exit_price + F.col("dividends")).withColumn("reason", reason)
    rows = rows.withColumn(
        "exit", F.first(F.when(F.col("reason").isNotNull(), F.struct("date", "reason", "value")), ignorenulls=True).over(run)
    )
    return rows.select(
        "rebalance_no", "security_id", "date", "day_no", "fill_price", "close", "price", "gap", "share_factor", "dividends",
        F.col("exit.date").alias("exit_date"), F.col("exit.reason").alias("exit_reason"),
        (F.coalesce("exit.value", "value") / F.col("fill_price")).alias("growth"),
    )


def leg_growth(targets: DataFrame, days: DataFrame) -> DataFrame:
    """(strategy_id, rebalance_no, date, growth) of whole portfolios; cash grows by nothing."""
    filled = targets.filter(F.col("weight") > 0)
    return (
        filled.join(days.select("rebalance_no", "security_id", "date", "growth"), ["rebalance_no", "security_id"])
        .groupBy("strategy_id", "rebalance_no", "date")
        .agg((1.0 + F.sum(F.col("weight") * (F.col("growth") - 1.0))).alias("growth"))
    )


def trades(targets: DataFrame, days: DataFrame, growth: DataFrame) -> DataFrame:
    """Target against drifted weight per (strategy, leg, security); the leg before is the strategy's previous one."""
    order = Window.partitionBy("strategy_id").orderBy("rebalance_no")
    following = targets.select("strategy_id", "rebalance_no").distinct().withColumn(
        "next_no", F.lead("rebalance_no").over(order)
    )
    ends = days.groupBy("rebalance_no", "security_id").agg(
        F.max_by("growth", "date").alias("g"), F.max_by("exit_date", "date").alias("exit_date")
    )
    total = growth.groupBy("strategy_id", "rebalance_no").agg(F.max_by("growth", "date").alias("total"))
    keys = ["strategy_id", "rebalance_no"]
    drifted = (
        targets.filter(F.col("weight") > 0)
        .join(ends, ["rebalance_no", "security_id"], "left")
        .join(total, keys, "left")
        .join(following, keys)
        .filter(F.col("next_no").isNotNull() & F.col("exit_date").isNull())
        .select(
            "strategy_id", F.col("next_no").alias("rebalance_no"), "security_id",
            (F.col("weight") * F.coalesce("g", F.lit(1.0)) / F.coalesce("total", F.lit(1.0))).alias("current_weight"),
        )
    )
    both = targets.select(*keys, "security_id", F.col("weight").alias("target_weight")).join(
        drifted, [*keys, "security_id"], "full_outer"
    ).fillna(0.0, ["target_weight", "current_weight"])
    return both.withColumn("delta", F.col("target_weight") - F.col("current_weight")).filter(
        F.abs("delta") >= MIN_TRADE_WEIGHT
    )


def leg_values(strategies: DataFrame, trade_rows: DataFrame, growth: DataFrame, legs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per (strategy, leg): value before, turnover, costs and their running sum."""
    keys = ["strategy_id", "rebalance_no"]
    turnover = trade_rows.groupBy(*keys).agg(F.sum(F.abs("delta")).alias("turnover"))
    ends = growth.groupBy(*keys).agg(F.max_by("growth", "date").alias("leg_growth"))
    rows = (
        targets.select(*keys).distinct()
        .join(turnover, keys, "left").join(ends, keys, "left")
        .join(F.broadcast(legs.select("rebalance_no", "signal_date", "as_of_date", "execution_date", "period_end")), "rebalance_no")
        .join(strategies, "strategy_id")
        .fillna({"turnover": 0.0, "leg_growth": 1.0})
        .withColumn("rate", (F.col("cost_bps") + F.col("slippage_bps")) / 10000.0)
    )
    order = Window.partitionBy("strategy_id").orderBy("rebalance_no")
    net = F.col("leg_growth") - F.col("rate") * F.col("turnover")
    before = F.coalesce(
        F.product(net).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)
    ) * F.col("capital")
    return (
        rows.withColumn("value_before", before)
        .withColumn("costs", F.col("value_before") * F.col("rate") * F.col("turnover"))
        .withColumn("cum_costs", F.sum("costs").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )


def equity_curve(values: DataFrame, growth: DataFrame, strategies: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Net and gross value on the start, on every execution date and on every day of every leg, then on the end date.

    Without ``start`` and ``end`` each strategy has its own start_date and end_date.

    Where an execution falls on the last day of the leg before, the earlier leg's mark stands.
    """
    cost_share = F.col("rate") * F.col("turnover")
    executed = values.select(
        "strategy_id", "rebalance_no", F.col("execution_date").alias("date"),
        (F.col("value_before") * (1.0 - cost_share)).alias("nav"), "cum_costs",
    )
    marked = growth.join(
        values.select("strategy_id", "rebalance_no", "value_before", "rate", "turnover", "cum_costs"),
        ["strategy_id", "rebalance_no"],
    ).select(
        "strategy_id", "rebalance_no", "date",
        (F.col("value_before") * (F.col("growth") - cost_share)).alias("nav"), "cum_costs",
    )
    opening = strategies.select(
        "strategy_id", F.lit(-1).alias("rebalance_no"), (F.lit(start).cast("date") if start else F.col("start_date")).alias("date"),
        F.col("capital").alias("nav"), F.lit(0.0).alias("cum_costs"),
    )
    points = opening.unionByName(executed).unionByName(marked)
    curve = points.groupBy("strategy_id", "date").agg(
        F.min_by("nav", "rebalance_no").alias("nav"), F.min_by("cum_costs", "rebalance_no").alias("cum_costs")
    )
    last = curve.groupBy("strategy_id").agg(
        F.max("date").alias("_d"), F.max_by("nav", "date").alias("nav"), F.max_by("cum_costs", "date").alias("cum_costs")
    )
    ends = strategies.select("strategy_id", (F.lit(end).cast("date") if end else F.col("end_date")).alias("date"))
    close = last.join(ends, "strategy_id").filter(F.col("_d") < F.col("date")).select("strategy_id", "date", "nav", "cum_costs")
    return curve.unionByName(close).withColumn("gross_nav", F.col("nav") + F.col("cum_costs"))


def rebalance_log(values: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per (strategy, leg): value, costs, turnover, cash and its holdings as JSON (at most the positions held)."""
    held = targets.filter(F.col("weight") > 0).groupBy("strategy_id", "rebalance_no").agg(
        F.count(F.lit(1)).alias("n_holdings"), F.sum("weight").alias("invested"),
        F.to_json(F.sort_array(F.collect_list(F.struct("security_id", "fill_date")))).alias("holdings_json"),
    )
    after = F.col("value_before") * (1.0 - F.col("rate") * F.col("turnover"))
    return values.join(held, ["strategy_id", "rebalance_no"], "left").select(
        "strategy_id", "rebalance_no", F.col("as_of_date").alias("signal_date"), "execution_date", "costs", "turnover",
        after.alias("value_after"),
        (F.col("value_before") * (1.0 - F.coalesce("invested", F.lit(0.0)) - F.col("rate") * F.col("turnover"))).alias("cash_after"),
        F.coalesce("n_holdings", F.lit(0)).alias("n_holdings"), "holdings_json",
    )
