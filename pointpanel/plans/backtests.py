"""Registered queries: portfolios rebalanced over the pooled dense bars."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointpanel.fixtures import Fixtures
from pointpanel.functions.rounding import half_up
from pointpanel.operators import actions as act
from pointpanel.operators import backtest as bt
from pointpanel.operators import calendar, concepts, definitions, identity, metrics, screen
from pointpanel.operators.asof import panel_as_of
from pointpanel.plans.oracle_views import VIEWS, actions_view, factors_view, rnd, rounded, with_views
from pointpanel.session import stored

START, END, CAPITAL = "1998-01-02", "2001-06-30", 300000.0
# strategy_id, rule, positions, cost bps, slippage bps, capital
STRATEGIES = [(1, "low_price", 5, 23.0, 5.0, CAPITAL), (2, "volume", 3, 23.0, 5.0, CAPITAL), (3, "high_price", 4, 23.0, 5.0, CAPITAL)]
_SCHEMA = "strategy_id long, rule string, positions int, cost_bps double, slippage_bps double, capital double"


class Run:
    """The stages of one backtest job as lazily built DataFrames."""

    def __init__(self, spark, sf, strategies=STRATEGIES, carry=bt.MAX_CARRY_DAYS):
        self.fx = Fixtures(spark, sf)
        self.definitions = strategies
        self.carry = carry
        self.strategies = spark.createDataFrame(strategies, _SCHEMA)

    @cached_property
    def raw(self) -> DataFrame:
        return stored(self.fx.bars_dense, "bars")

    @cached_property
    def bars(self) -> DataFrame:
        """Traded closes; lock flags come from the raw bar."""
        locked = identity.with_lock_flag(self.raw).select("security_id", "date", "close", "volume", "is_circuit_locked")
        return stored(self.fx.traded(locked), "traded")

    @property
    def held_bars(self) -> DataFrame:
        """Bars of all securities that may be held, at least."""
        return self.bars

    @cached_property
    def days(self) -> DataFrame:
        return stored(calendar.trading_days(self.bars), "days")

    @cached_property
    def legs(self) -> DataFrame:
        legs = calendar.execution_legs(self.fx.rebalance, self.fx._snapshots(self.bars), self.days, END)
        return stored(legs, "legs")

    @cached_property
    def securities(self) -> DataFrame:
        """Pooled securities with their delisting, detected on the bars."""
        known = self.bars.select("security_id").distinct().withColumn("is_active", F.lit(True))
        return identity.detect_delistings(known, self.bars)

    @cached_property
    def signals(self) -> DataFrame:
        """Each strategy's screen at each leg's snapshot date, best ``positions`` only."""
        panel = panel_as_of(self.bars, self.legs, ["close", "volume"], slot_date="as_of_date")
        key = (
            F.when(F.col("rule") == "low_price", F.col("close"))
            .when(F.col("rule") == "high_price", -F.col("close"))
            .otherwise(-F.col("volume").cast("double"))
        )
        rows = panel.filter(F.col("close") > 0).join(
            F.broadcast(self.legs.select("as_of_date", "rebalance_no")), "as_of_date"
        )
        # rows are ranked once per distinct rule, up to the largest number of positions; strategies then take their share of the ranks
        most = {rule: max(n for _, r, n, *_ in self.definitions if r == rule) for _, rule, *_ in self.definitions}
        rules = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(n).alias("most")) for rule, n in most.items()])
        rows = rows.withColumn("_s", F.explode(rules)).select("*", "_s.*").drop("_s").withColumn("_key", key)
        ranked = screen.top_per_group(rows, ["rule", "rebalance_no"], ["_key", "security_id"], F.col("most"), at_most=max(most.values()))
        wanted = F.array(*[
            F.struct(F.lit(i).cast("long").alias("strategy_id"), F.lit(rule).alias("rule"), F.lit(n).alias("positions"))
            for i, rule, n, *_ in self.definitions
        ])
        own = F.filter(wanted, lambda s: (s["rule"] == F.col("rule")) & (F.col("rank") <= s["positions"]))
        return ranked.withColumn("strategy_id", F.explode(F.transform(own, lambda s: s["strategy_id"]))).select(
            "strategy_id", "rebalance_no", "security_id", F.col("rank").cast("long").alias("rank"))

    @cached_property
    def fills(self) -> DataFrame:
        return calendar.first_fillable(self.bars, self.legs)

    @cached_property
    def targets(self) -> DataFrame:
        return stored(bt.targets_with_fills(self.signals, self.fills), "targets")

    @cached_property
    def factors(self) -> DataFrame:
        return act.resolve_factors(self.fx.actions_of(self.held_bars), self.held_bars)

    @cached_property
    def held(self) -> DataFrame:
        return self.targets.filter(F.col("weight") > 0).select("rebalance_no", "security_id", "fill_price").distinct()

    @cached_property
    def holding_days(self) -> DataFrame:
        rows = bt.holding_days(self.held, self.legs, self.days, self.held_bars, self.factors, self.securities, self.carry)
        return stored(rows, "holding-days")

    @cached_property
    def growth(self) -> DataFrame:
        return bt.leg_growth(self.targets, self.holding_days)

    @cached_property
    def trades(self) -> DataFrame:
        return bt.trades(self.targets, self.holding_days, self.growth)

    @cached_property
    def values(self) -> DataFrame:
        rows = bt.leg_values(self.strategies, self.trades, self.growth, self.legs, self.targets)
        return stored(rows, "leg-values")

    @cached_property
    def curve(self) -> DataFrame:
        return bt.equity_curve(self.values, self.growth, self.strategies, START, END)


_DEF_CLOSE, _DEF_VOLUME = "k % 4 * 0.01", "k % 3 * 4000"
_DEFINITIONS = [
    "k + 1 AS strategy_id", "CASE k % 3 WHEN 0 THEN 'Monthly' WHEN 1 THEN 'Quarterly' ELSE 'Annual' END AS frequency",
    "CASE k % 2 WHEN 0 THEN DATE '1998-01-02' ELSE DATE '1998-03-31' END AS start_date",
    "CASE k % 5 WHEN 0 THEN DATE '2000-12-29' ELSE DATE '2001-06-30' END AS end_date",
    "CASE k % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 23.0 ELSE 95.0 END AS cost_bps", "2 + k % 5 AS positions", "k",
]


class Defined(Run):
    """A run over the bars of every supplier, with a definition for each nation: criteria, dates, frequency, positions and costs of its own."""

    def __init__(self, spark, sf):
        self.fx = Fixtures(spark, sf)
        self.carry = bt.MAX_CARRY_DAYS
        rows = self.fx.table("nation").selectExpr("CAST(n_nationkey AS BIGINT) AS k").selectExpr(*_DEFINITIONS)
        one = "{\"kind\":\"comparison\",\"field\":\"%s\",\"operator\":\"GreaterThan\",\"value\":"
        text = F.concat(
            F.lit("{\"root\":{\"kind\":\"group\",\"op\":\"And\",\"children\":[" + one % "ClosePrice"), F.expr(f"CAST({_DEF_CLOSE} AS STRING)"),
            F.lit("}," + one % "Volume"), F.expr(f"CAST({_DEF_VOLUME} AS STRING)"),
            F.lit("}]},\"sort\":{\"field\":\""), F.expr("CASE k % 4 WHEN 0 THEN 'Volume' ELSE 'ClosePrice' END"),
            F.lit("\",\"direction\":\""), F.expr("CASE k % 4 WHEN 1 THEN 'Asc' ELSE 'Desc' END"), F.lit("\"}}"))
        rows = rows.withColumn("criteria_json", text).withColumn("criteria_key", F.sha2("criteria_json", 256))
        self.strategies = stored(rows.select(
            "strategy_id", "frequency", "start_date", "end_date", "criteria_key", "criteria_json", F.col("positions").cast("int").alias("positions"),
            F.col("cost_bps").cast("double").alias("cost_bps"), F.lit(5.0).alias("slippage_bps"), F.lit(CAPITAL).alias("capital"),
            definitions.rebalances_per_year().alias("per_year")), "definitions")

    @cached_property
    def raw(self) -> DataFrame:
        return self.fx.bars

    @cached_property
    def held_bars(self) -> DataFrame:
        """The bars of securities that some definition picked, however many there are: few beside all suppliers."""
        picked = stored(self.signals.select("security_id").distinct(), "picked")
        return stored(self.bars.join(picked, "security_id", "left_semi"), "held-bars")

    @cached_property
    def own_legs(self) -> DataFrame:
        return stored(definitions.legs(self.strategies, self.fx._snapshots(self.bars), self.days), "own-legs")

    @cached_property
    def legs(self) -> DataFrame:
        return stored(self.own_legs.groupBy("rebalance_no", "as_of_date", "execution_date", "period_end").agg(
            F.min("signal_date").alias("signal_date")), "legs")

    @cached_property
    def signals(self) -> DataFrame:
        own = self.strategies.select(F.col("criteria_key").alias("strategy_id"), "criteria_json").distinct()
        criteria = stored(concepts.parsed_criteria(own).withColumnRenamed("strategy_id", "criteria_key"), "criteria")
        return stored(definitions.signals(self.strategies, criteria, self.own_legs, self.bars, ["ClosePrice", "Volume"]), "signals")

    @cached_property
    def fills(self) -> DataFrame:
        return definitions.fills(self.signals, self.legs, self.held_bars)

    @cached_property
    def securities(self) -> DataFrame:
        """Every twentieth supplier that stops has gone bankrupt."""
        known = self.held_bars.select("security_id").distinct().withColumn("is_active", F.lit(True))
        reason = F.when(F.col("delisted_date").isNotNull() & (F.col("security_id") % 20 == 3), "Bankruptcy").otherwise(F.col("delisting_reason"))
        return identity.detect_delistings(known, self.held_bars, days=self.days).withColumn("delisting_reason", reason)

    @cached_property
    def curve(self) -> DataFrame:
        return bt.equity_curve(self.values, self.growth, self.strategies)


def q_signals(spark, sf):
    """Each definition's own screen at each of its own rebalances."""
    return Defined(spark, sf).signals


def q_fills(spark, sf):
    return Run(spark, sf).targets.select("strategy_id", "rebalance_no", "security_id", "weight", "fill_date", half_up("fill_price", 8).alias("fill_price"))


def _days(spark, sf, *cols):
    return Run(spark, sf).holding_days.select("rebalance_no", "security_id", "date", *cols)


def q_share_adjust(spark, sf):
    return _days(spark, sf, half_up("share_factor", 6).alias("share_factor"))


def q_dividends(spark, sf):
    return _days(spark, sf, half_up("dividends", 4).alias("dividends"))


def _exits(spark, sf, reason):
    rows = Defined(spark, sf).holding_days.filter((F.col("exit_reason") == reason) & (F.col("exit_date") == F.col("date")))
    return rows.select("rebalance_no", "security_id", "exit_date", half_up("growth", 4).alias("exit_growth"))


def q_delist_exit(spark, sf):
    return _exits(spark, sf, "delisted")


def q_missing_exit(spark, sf):
    return _exits(spark, sf, "missing")


def q_carry_forward_cap(spark, sf):
    return _days(spark, sf, half_up("price", 8).alias("price"), F.col("gap").cast("long").alias("gap"), (F.col("gap") > bt.MAX_CARRY_DAYS).alias("forced_out"))


def q_holding_growth(spark, sf):
    return Run(spark, sf).holding_days.groupBy("rebalance_no", "security_id").agg(
        F.max("date").alias("date"), half_up(F.max_by("growth", "date"), 4).alias("growth")
    )


def q_trades(spark, sf):
    run = Run(spark, sf)
    v = run.values.select("strategy_id", "rebalance_no", "value_before")
    t = run.trades.join(v, ["strategy_id", "rebalance_no"])
    notional = F.abs("delta") * F.col("value_before")
    return t.select(
        "strategy_id", "rebalance_no", "security_id",
        *[half_up(c, 6).alias(c) for c in ("current_weight", "target_weight", "delta")],
        half_up(notional, 2).alias("notional"), half_up(bt.transaction_cost(notional), 2).alias("cost"),
    )


def q_equity_curve(spark, sf):
    return Run(spark, sf).curve.select("strategy_id", "date", half_up("nav", 2).alias("nav"), half_up("gross_nav", 2).alias("gross_nav"))


def q_cum_costs(spark, sf):
    return Run(spark, sf).values.select(
        "strategy_id", "rebalance_no", half_up("value_before", 2).alias("net_nav"),
        half_up("cum_costs", 2).alias("cum_costs"),
        half_up(F.col("value_before") + F.col("cum_costs"), 2).alias("gross_nav"),
    )


def q_rebalance_log(spark, sf):
    run = Run(spark, sf)
    return bt.rebalance_log(run.values, run.targets).select(
        "strategy_id", "rebalance_no", "signal_date", "execution_date", "n_holdings", "holdings_json",
        *[half_up(c, 2).alias(c) for c in ("costs", "value_after", "cash_after")], half_up("turnover", 6).alias("turnover"),
    )


METRIC_COLUMNS = ["cagr_net", "cagr_gross", "max_drawdown", "sharpe", "sortino", "win_rate", "annual_turnover"]


def _metrics(run: Run, per_year: int | str = metrics.REBALANCES_PER_YEAR["Quarterly"]) -> DataFrame:
    out = metrics.summary(run.curve, run.values, per_year)
    return out.select(
        "strategy_id", *[half_up(c, 4).alias(c) for c in METRIC_COLUMNS], half_up("total_costs", 2).alias("total_costs")
    )


def q_metrics(spark, sf):
    return _metrics(Run(spark, sf))


def q_sweep(spark, sf):
    """Monthly, quarterly and annual definitions with their own criteria in one job; the growth of a holding is shared by all of them."""
    run = Defined(spark, sf)
    # A day on which nothing moves must not count as a gain for a last bit of its sum.
    run.curve = run.curve.withColumns({c: half_up(c, 6) for c in ("nav", "gross_nav")})
    return _metrics(run, "per_year")


def q_benchmark(spark, sf):
    return metrics.rebase(Fixtures(spark, sf).benchmark, CAPITAL, START, END).select(
        "ticker", "date", half_up("nav", 2).alias("nav"), half_up("cagr", 6).alias("cagr")
    )


def security_curves(fx: Fixtures) -> DataFrame:
    """Each security's own closes as a value curve, so the figures run over the whole bar table."""
    return fx.bars.select(F.col("security_id").alias("strategy_id"), "date", F.col("close").alias("nav"))


def q_cagr(spark, sf):
    s = metrics.span("nav")
    return security_curves(Fixtures(spark, sf)).groupBy(F.col("strategy_id").alias("security_id")).agg(
        half_up(metrics.cagr(s["begin"], s["end"], s["days"]), 6).alias("cagr")
    )


def _returns_stat(spark, sf, stat, name):
    rows = metrics.with_returns(security_curves(Fixtures(spark, sf)))
    return rows.groupBy(F.col("strategy_id").alias("security_id")).agg(half_up(stat(F.col("ret")), 6).alias(name))


def q_sharpe(spark, sf):
    return _returns_stat(spark, sf, metrics.sharpe, "sharpe")


def q_sortino(spark, sf):
    return _returns_stat(spark, sf, metrics.sortino, "sortino")


def q_win_rate(spark, sf):
    return _returns_stat(spark, sf, metrics.win_rate, "win_rate")


def q_max_drawdown(spark, sf):
    rows = metrics.with_drawdown(security_curves(Fixtures(spark, sf)))
    return rows.groupBy(F.col("strategy_id").alias("security_id")).agg(
        half_up(F.least(F.lit(0.0), F.min("drawdown")), 6).alias("max_drawdown")
    )


def q_annual_turnover(spark, sf):
    per_year = F.create_map(*[x for k, n in metrics.REBALANCES_PER_YEAR.items() for x in (F.lit(k), F.lit(n))])
    per = Run(spark, sf).values.groupBy("strategy_id").agg(F.avg("turnover").alias("t"))
    return per.select(
        "strategy_id", F.explode(per_year).alias("frequency", "n")
    ).join(per, "strategy_id").select("strategy_id", "frequency", half_up(F.col("t") * F.col("n"), 4).alias("annual_turnover"))


QUERIES = {
    "bt_signals": q_signals, "bt_fills": q_fills, "bt_share_adjust": q_share_adjust, "bt_dividends": q_dividends,
    "bt_delist_exit": q_delist_exit, "bt_missing_exit": q_missing_exit, "carry_forward_cap": q_carry_forward_cap,
    "holding_growth": q_holding_growth, "bt_trades": q_trades, "bt_equity_curve": q_equity_curve,
    "cum_costs_gross_nav": q_cum_costs, "bt_rebalance_log": q_rebalance_log, "bt_metrics": q_metrics,
    "bt_sweep": q_sweep, "bt_benchmark": q_benchmark, "cagr": q_cagr, "sharpe": q_sharpe, "sortino": q_sortino,
    "win_rate": q_win_rate, "max_drawdown": q_max_drawdown, "annual_turnover": q_annual_turnover,
    "rebase_benchmark": q_benchmark,
}


def _values(rows) -> str:
    return ", ".join(f"({i}, '{r}', {n}, {c}::DOUBLE, {s}::DOUBLE, {k}::DOUBLE)" for i, r, n, c, s, k in rows)


def _stages(rows, carry: int = 5) -> dict[str, str]:
    """The same convention in plain SQL, stage by stage."""
    return {
        "bt_str": f"SELECT CAST(strategy_id AS BIGINT) AS strategy_id, rule, positions, cost_bps, slippage_bps, capital FROM (VALUES {_values(rows)}) "
                  "t(strategy_id, rule, positions, cost_bps, slippage_bps, capital)",
        "bt_day": "SELECT DISTINCT date FROM fx_bars_dense",
        "bt_leg": f"""
SELECT * FROM (SELECT r.rebalance_no, r.signal_date, s.as_of_date, (SELECT min(date) FROM bt_day b WHERE b.date > s.as_of_date) AS execution_date, r.period_end
  FROM (SELECT *, coalesce(lead(signal_date) OVER (ORDER BY signal_date), DATE '{END}') AS period_end FROM fx_rebalance) r
  ASOF JOIN (SELECT * FROM fx_snapshots_dense WHERE sealed_at IS NOT NULL) s ON r.signal_date >= s.as_of_date) t
WHERE execution_date <= DATE '{END}'""",
        "bt_sig": """
SELECT strategy_id, rebalance_no, security_id, row_number() OVER (PARTITION BY strategy_id, rebalance_no ORDER BY k, security_id) AS rank
FROM (SELECT t.strategy_id, t.positions, l.rebalance_no, s.security_id,
             CASE t.rule WHEN 'low_price' THEN b.close WHEN 'high_price' THEN -b.close ELSE -b.volume END AS k
      FROM bt_leg l CROSS JOIN (SELECT DISTINCT security_id FROM fx_bars_dense) s
      ASOF JOIN fx_traded b ON b.security_id = s.security_id AND l.as_of_date >= b.date CROSS JOIN bt_str t) x
QUALIFY rank <= positions""",
        "bt_lock": """
SELECT t.security_id, t.date, x.close, coalesce(t.open = t.high AND t.high = t.low AND t.low = t.close AND t.prev > 0 AND abs((t.close - t.prev) / t.prev) >= 0.019, false) AS locked
FROM (SELECT *, lag(close) OVER (PARTITION BY security_id ORDER BY date) AS prev FROM fx_bars_dense) t JOIN fx_traded x USING (security_id, date)""",
        "bt_fill": """
SELECT rebalance_no, security_id, min(date) AS fill_date, min_by(close, date) AS fill_price FROM (
  SELECT l.rebalance_no, b.* FROM bt_leg l JOIN bt_lock b ON b.date BETWEEN l.execution_date AND l.period_end
  QUALIFY row_number() OVER (PARTITION BY l.rebalance_no, b.security_id ORDER BY b.date) <= 5) t
WHERE NOT locked GROUP BY 1, 2""",
        "bt_tgt": """
SELECT s.strategy_id, s.rebalance_no, s.security_id, f.fill_date, f.fill_price,
       CASE WHEN f.fill_price > 0 THEN 1.0::DOUBLE / count(*) OVER (PARTITION BY s.strategy_id, s.rebalance_no) ELSE 0 END AS weight
FROM bt_sig s LEFT JOIN bt_fill f USING (rebalance_no, security_id)""",
        "bt_gone": """
SELECT security_id, max(date) AS delisted_date FROM fx_bars_dense GROUP BY 1
HAVING max(date) < (SELECT max(date) FROM fx_bars_dense) - 60""",
        "bt_grid": """
SELECT h.rebalance_no, h.security_id, h.fill_price, d.date, b.close, g.delisted_date,
       coalesce((SELECT product(1 / f.factor) FROM fx_factors_traded f WHERE f.security_id = h.security_id
         AND f.effective_date > l.execution_date AND f.effective_date <= d.date AND f.factor > 0), 1) AS share_factor,
       row_number() OVER w AS n, row_number() OVER w - coalesce(max(CASE WHEN b.close IS NOT NULL THEN d.date END) OVER w - l.execution_date, 0) AS unused,
       last_value(b.close IGNORE NULLS) OVER w AS last_close
FROM (SELECT DISTINCT rebalance_no, security_id, fill_price FROM bt_tgt WHERE weight > 0) h JOIN bt_leg l USING (rebalance_no)
JOIN bt_day d ON d.date > l.execution_date AND d.date <= l.period_end
LEFT JOIN fx_traded b ON b.security_id = h.security_id AND b.date = d.date
LEFT JOIN bt_gone g ON g.security_id = h.security_id
WINDOW w AS (PARTITION BY h.rebalance_no, h.security_id ORDER BY d.date)""",
        "bt_held": f"""
SELECT *, CASE WHEN date = delisted_date THEN 'delisted' WHEN gap > {carry} THEN 'missing' END AS reason, share_factor * price + dividends AS worth
FROM (SELECT g.*, coalesce(last_close, fill_price) AS price,
             n - coalesce(max(CASE WHEN close IS NOT NULL THEN n END) OVER w, 0) AS gap,
             sum(coalesce(a.dividend, 0) * share_factor) OVER w AS dividends
      FROM bt_grid g LEFT JOIN (SELECT security_id, effective_date AS date, sum(dividend_amount) AS dividend FROM fx_factors_traded
                                WHERE action_type = 'Dividend' GROUP BY 1, 2) a USING (security_id, date)
      WINDOW w AS (PARTITION BY rebalance_no, security_id ORDER BY date)) t""",
        "bt_hd": """
SELECT h.*, e.exit_date, e.exit_reason, coalesce(e.exit_worth, h.worth) / h.fill_price AS growth
FROM bt_held h LEFT JOIN (SELECT rebalance_no, security_id, min(date) AS exit_date, min_by(reason, date) AS exit_reason, min_by(worth, date) AS exit_worth
                          FROM bt_held WHERE reason IS NOT NULL GROUP BY 1, 2) e
ON e.rebalance_no = h.rebalance_no AND e.security_id = h.security_id AND e.exit_date <= h.date""",
        "bt_grow": """
SELECT t.strategy_id, t.rebalance_no, h.date, 1 - sum(t.weight) + sum(t.weight * h.growth) AS growth
FROM bt_tgt t JOIN bt_hd h USING (rebalance_no, security_id) WHERE t.weight > 0 GROUP BY 1, 2, 3""",
        "bt_end": "SELECT rebalance_no, security_id, max_by(growth, date) AS g, max(exit_date) AS exit_date FROM bt_hd GROUP BY 1, 2",
        "bt_tot": "SELECT strategy_id, rebalance_no, max_by(growth, date) AS total FROM bt_grow GROUP BY 1, 2",
        "bt_drift": """
SELECT t.strategy_id, n.next_no AS rebalance_no, t.security_id, t.weight * coalesce(e.g, 1) / coalesce(o.total, 1) AS current_weight
FROM bt_tgt t LEFT JOIN bt_end e USING (rebalance_no, security_id) LEFT JOIN bt_tot o USING (strategy_id, rebalance_no)
JOIN (SELECT strategy_id, rebalance_no, lead(rebalance_no) OVER (PARTITION BY strategy_id ORDER BY rebalance_no) AS next_no
      FROM (SELECT DISTINCT strategy_id, rebalance_no FROM bt_tgt) z) n USING (strategy_id, rebalance_no)
WHERE t.weight > 0 AND e.exit_date IS NULL AND n.next_no IS NOT NULL""",
        "bt_trd": """
SELECT *, target_weight - current_weight AS delta FROM (
  SELECT coalesce(t.strategy_id, d.strategy_id) AS strategy_id, coalesce(t.rebalance_no, d.rebalance_no) AS rebalance_no,
         coalesce(t.security_id, d.security_id) AS security_id, coalesce(t.weight, 0) AS target_weight, coalesce(d.current_weight, 0) AS current_weight
  FROM bt_tgt t FULL OUTER JOIN bt_drift d ON t.strategy_id = d.strategy_id AND t.rebalance_no = d.rebalance_no AND t.security_id = d.security_id) x
WHERE abs(target_weight - current_weight) >= 0.0001""",
        "bt_val": """
SELECT *, value_before * rate * turnover AS costs, sum(value_before * rate * turnover) OVER (PARTITION BY strategy_id ORDER BY rebalance_no) AS cum_costs
FROM (SELECT *, capital * coalesce(product(leg_growth - rate * turnover) OVER (PARTITION BY strategy_id ORDER BY rebalance_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS value_before
      FROM (SELECT k.strategy_id, k.rebalance_no, l.as_of_date, l.execution_date, s.capital, (s.cost_bps + s.slippage_bps) / 10000 AS rate,
                   coalesce(v.turnover, 0) AS turnover, coalesce(o.total, 1) AS leg_growth
            FROM (SELECT DISTINCT strategy_id, rebalance_no FROM bt_tgt) k JOIN bt_str s USING (strategy_id) JOIN bt_leg l USING (rebalance_no)
            LEFT JOIN (SELECT strategy_id, rebalance_no, sum(abs(delta)) AS turnover FROM bt_trd GROUP BY 1, 2) v USING (strategy_id, rebalance_no)
            LEFT JOIN bt_tot o USING (strategy_id, rebalance_no)) a) b""",
        "bt_pts": f"""
SELECT strategy_id, date, min_by(nav, k) AS nav, min_by(cum_costs, k) AS cum_costs FROM (
  SELECT strategy_id, -1 AS k, DATE '{START}' AS date, capital AS nav, 0 AS cum_costs FROM bt_str
  UNION ALL SELECT strategy_id, rebalance_no, execution_date, value_before * (1 - rate * turnover), cum_costs FROM bt_val
  UNION ALL SELECT g.strategy_id, g.rebalance_no, g.date, v.value_before * (g.growth - v.rate * v.turnover), v.cum_costs
            FROM bt_grow g JOIN bt_val v USING (strategy_id, rebalance_no)) p GROUP BY 1, 2""",
        "bt_crv": f"""
SELECT *, nav + cum_costs AS gross_nav FROM (
  SELECT strategy_id, date, nav, cum_costs FROM bt_pts
  UNION ALL SELECT strategy_id, DATE '{END}', max_by(nav, date), max_by(cum_costs, date) FROM bt_pts GROUP BY 1 HAVING max(date) < DATE '{END}') q""",
    }


def v(body: str, rows=STRATEGIES, carry: int = 5) -> str:
    return with_views(body, **_stages(rows, carry))


def _of_suppliers(text: str) -> str:
    return (text.replace("fx_bars_dense", "fx_bars").replace("fx_snapshots_dense", "fx_snapshots").replace("fx_actions_dense", "fx_actions")
            .replace("fx_traded", "fx_own_traded").replace("fx_factors_traded", "fx_own_factors"))


_DAYS = "CAST({} - DATE '1970-01-01' AS BIGINT)"


def defined(body: str) -> str:
    """The stages for definitions with their own dates, over the bars of every supplier."""
    stages = {k: _of_suppliers(text) for k, text in _stages(STRATEGIES).items()}
    stages |= {
        "fx_own_traded": _of_suppliers(VIEWS["fx_traded"]), "fx_own_actions": actions_view("fx_own_traded"),
        "fx_own_factors": factors_view("fx_own_actions", "fx_own_traded"),
        "bt_str": f"SELECT *, 5.0::DOUBLE AS slippage_bps, {CAPITAL}::DOUBLE AS capital, CASE frequency WHEN 'Monthly' THEN 12 WHEN 'Quarterly' THEN 4 ELSE 1 END AS per_year "
                  f"FROM (SELECT {', '.join(_DEFINITIONS)} FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation) a) b",
        "bt_dates": "SELECT strategy_id, start_date AS d, 12 // per_year AS months, end_date FROM bt_str UNION ALL "
                    "SELECT strategy_id, CAST(d + to_months(months) AS DATE), months, end_date FROM bt_dates WHERE CAST(d + to_months(months) AS DATE) <= end_date",
        "bt_own": f"""
SELECT *, {_DAYS.format('as_of_date')} * 100000 + {_DAYS.format('period_end')} AS rebalance_no FROM (
  SELECT r.strategy_id, s.as_of_date, (SELECT min(date) FROM bt_day b WHERE b.date > s.as_of_date) AS execution_date, r.period_end, r.end_date
  FROM (SELECT *, coalesce(lead(d) OVER (PARTITION BY strategy_id ORDER BY d), end_date) AS period_end FROM bt_dates) r
  ASOF JOIN (SELECT * FROM fx_snapshots WHERE sealed_at IS NOT NULL) s ON r.d >= s.as_of_date) t WHERE execution_date <= end_date""",
        "bt_leg": "SELECT DISTINCT rebalance_no, as_of_date, execution_date, period_end FROM bt_own",
        "bt_asof": "SELECT x.as_of_date, s.security_id, b.close, b.volume FROM (SELECT DISTINCT as_of_date FROM bt_leg) x "
                   "CROSS JOIN (SELECT DISTINCT security_id FROM fx_bars) s ASOF JOIN fx_own_traded b ON b.security_id = s.security_id AND x.as_of_date >= b.date",
        "bt_sig": f"""
SELECT o.strategy_id, o.rebalance_no, p.security_id, row_number() OVER (PARTITION BY o.strategy_id, o.rebalance_no ORDER BY
  CASE k % 4 WHEN 0 THEN -p.volume WHEN 1 THEN p.close ELSE -p.close END, p.security_id) AS rank
FROM bt_own o JOIN bt_str t USING (strategy_id) JOIN bt_asof p USING (as_of_date)
WHERE p.close > {_DEF_CLOSE} AND p.volume > {_DEF_VOLUME} QUALIFY rank <= positions""",
    }
    stages["bt_held"] = stages["bt_held"].replace(
        "share_factor * price + dividends AS worth", "CASE WHEN date = delisted_date AND security_id % 20 = 3 THEN 0 ELSE share_factor * price END + dividends AS worth")
    stages["bt_pts"] = stages["bt_pts"].replace(f"DATE '{START}'", "start_date")
    stages["bt_crv"] = """
SELECT *, nav + cum_costs AS gross_nav FROM (
  SELECT strategy_id, date, nav, cum_costs FROM bt_pts
  UNION ALL SELECT strategy_id, end_date, max_by(nav, date), max_by(cum_costs, date) FROM bt_pts JOIN bt_str USING (strategy_id) GROUP BY 1, 2 HAVING max(date) < end_date) q"""
    return with_views(body, **stages).replace("WITH ", "WITH RECURSIVE ", 1)


def _ratio(b: str, e: str, d: str) -> str:
    return f"CASE WHEN {b} <= 0 OR {d} <= 0 THEN 0 WHEN {e} / {b} <= 0 THEN -1 ELSE pow({e} / {b}, 365.0::DOUBLE / {d}) - 1 END"


_SHARPE = "CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) * sqrt(252) ELSE 0 END"
_DOWN = "sqrt(avg(pow(least(ret, 0), 2)))"
_SORTINO = f"CASE WHEN {_DOWN} > 0 THEN avg(ret) / {_DOWN} * sqrt(252) ELSE 0 END"
_WIN = "CAST(count(*) FILTER (ret > 0) AS DOUBLE) / count(ret)"


def _with_ret(src: str, key: str, value: str) -> str:
    p = f"lag({value}) OVER (PARTITION BY {key} ORDER BY date)"
    peak = f"max({value}) OVER (PARTITION BY {key} ORDER BY date)"
    return f"(SELECT *, CASE WHEN {p} = 0 THEN 0 ELSE {value} / {p} - 1 END AS ret, CASE WHEN {peak} > 0 THEN {value} / {peak} - 1 END AS dd FROM {src}) r"


def _metrics_sql(views, per_year: str, curve: str = "bt_crv") -> str:
    net = _ratio("min_by(nav, date)", "max_by(nav, date)", "(max(date) - min(date))")
    gross = _ratio("min_by(gross_nav, date)", "max_by(gross_nav, date)", "(max(date) - min(date))")
    return views(
        f"SELECT m.strategy_id, {rounded(*METRIC_COLUMNS, digits=4)}, {rnd('total_costs', 2)} AS total_costs FROM ("
        f"SELECT strategy_id, {net} AS cagr_net, {gross} AS cagr_gross, least(0, min(dd)) AS max_drawdown, {_SHARPE} AS sharpe, "
        f"{_SORTINO} AS sortino, {_WIN} AS win_rate FROM {_with_ret(curve, 'strategy_id', 'nav')} GROUP BY 1) m "
        f"LEFT JOIN (SELECT strategy_id, avg(turnover) * {per_year} AS annual_turnover, sum(costs) AS total_costs FROM bt_val JOIN bt_str USING (strategy_id) GROUP BY 1) t USING (strategy_id)",
    )


def _sec(expr: str, name: str) -> str:
    return v(f"SELECT security_id, {rnd(expr)} AS {name} FROM {_with_ret('fx_bars', 'security_id', 'close')} GROUP BY 1")


_BENCH = v(
    f"SELECT b.ticker, b.date, {rnd('b.total_return_index_value / e.b0 * ' + str(CAPITAL) + '::DOUBLE', 2)} AS nav, "
    f"{rnd(_ratio('e.b0', 'e.b1', 'e.days'))} AS cagr FROM fx_benchmark b JOIN (SELECT ticker, min_by(total_return_index_value, date) AS b0, "
    f"max_by(total_return_index_value, date) AS b1, max(date) - min(date) AS days FROM fx_benchmark WHERE date BETWEEN DATE '{START}' AND DATE '{END}' "
    f"GROUP BY 1 HAVING count(*) >= 2) e USING (ticker) WHERE b.date BETWEEN DATE '{START}' AND DATE '{END}'"
)
_EXIT = "SELECT rebalance_no, security_id, exit_date, " + rnd("growth", 4) + " AS exit_growth FROM bt_hd WHERE exit_date = date AND exit_reason = '{}'"

ORACLES = {
    "bt_signals": defined("SELECT * FROM bt_sig"),
    "bt_fills": v("SELECT strategy_id, rebalance_no, security_id, weight, fill_date, " + rnd("fill_price", 8) + " AS fill_price FROM bt_tgt"),
    "bt_share_adjust": v(f"SELECT rebalance_no, security_id, date, {rnd('share_factor')} AS share_factor FROM bt_hd"),
    "bt_dividends": v(f"SELECT rebalance_no, security_id, date, {rnd('dividends', 4)} AS dividends FROM bt_hd"),
    "bt_delist_exit": defined(_EXIT.format("delisted")),
    "bt_missing_exit": defined(_EXIT.format("missing")),
    "carry_forward_cap": v("SELECT rebalance_no, security_id, date, " + rnd("price", 8) + " AS price, gap, gap > 5 AS forced_out FROM bt_hd"),
    "holding_growth": v(f"SELECT rebalance_no, security_id, max(date) AS date, {rnd('max_by(growth, date)', 4)} AS growth FROM bt_hd GROUP BY 1, 2"),
    "bt_trades": v(
        f"SELECT strategy_id, rebalance_no, security_id, {rounded('current_weight', 'target_weight', 'delta')}, "
        f"{rnd('abs(delta) * value_before', 2)} AS notional, {rnd('abs(delta) * value_before * 28.0::DOUBLE / 10000', 2)} AS cost "
        "FROM bt_trd JOIN bt_val USING (strategy_id, rebalance_no)"),
    "bt_equity_curve": v(f"SELECT strategy_id, date, {rounded('nav', 'gross_nav', digits=2)} FROM bt_crv"),
    "cum_costs_gross_nav": v(
        f"SELECT strategy_id, rebalance_no, {rnd('value_before', 2)} AS net_nav, {rnd('cum_costs', 2)} AS cum_costs, "
        f"{rnd('value_before + cum_costs', 2)} AS gross_nav FROM bt_val"),
    "bt_rebalance_log": v(
        f"SELECT x.strategy_id, x.rebalance_no, x.as_of_date AS signal_date, x.execution_date, h.n AS n_holdings, h.js AS holdings_json, "
        f"{rnd('x.costs', 2)} AS costs, {rnd('value_before * (1 - rate * turnover)', 2)} AS value_after, "
        f"{rnd('value_before * (1 - h.inv - rate * turnover)', 2)} AS cash_after, {rnd('turnover')} AS turnover FROM bt_val x JOIN ("
        "SELECT strategy_id, rebalance_no, count(*) AS n, sum(weight) AS inv, concat('[', string_agg(concat('{\"security_id\":', security_id, "
        "',\"fill_date\":\"', strftime(fill_date, '%Y-%m-%d'), '\"}'), ',' ORDER BY security_id), ']') AS js FROM bt_tgt WHERE weight > 0 GROUP BY 1, 2) h "
        "USING (strategy_id, rebalance_no)"),
    "bt_metrics": _metrics_sql(v, "4"),
    "bt_sweep": _metrics_sql(defined, "max(per_year)", f"(SELECT strategy_id, date, {rounded('nav', 'gross_nav')} FROM bt_crv)"),
    "bt_benchmark": _BENCH,
    "rebase_benchmark": _BENCH,
    "cagr": _sec(_ratio("min_by(close, date)", "max_by(close, date)", "(max(date) - min(date))"), "cagr"),
    "sharpe": _sec(_SHARPE, "sharpe"),
    "sortino": _sec(_SORTINO, "sortino"),
    "win_rate": _sec(_WIN, "win_rate"),
    "max_drawdown": _sec("least(0, min(dd))", "max_drawdown"),
    "annual_turnover": v(
        f"SELECT strategy_id, frequency, {rnd('t * n', 4)} AS annual_turnover FROM (SELECT strategy_id, avg(turnover) AS t FROM bt_val GROUP BY 1) x "
        "CROSS JOIN (VALUES ('Monthly', 12), ('Quarterly', 4), ('Annual', 1)) f(frequency, n)"),
}
