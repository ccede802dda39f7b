from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pointpanel.operators import backtest as bt
from pointpanel.operators import calendar, definitions, identity, metrics

DATES = [dt.date(2024, *d) for d in ((1, 2), (1, 3), (2, 1), (3, 15), (4, 10), (5, 20), (6, 28))]


def run(spark, closes, capital, factors=(), exits=(), cost=0.0, carry=5):
    """One strategy, one rebalance: signal on the first date, execution on the second."""
    bars = spark.createDataFrame(
        [(s, d, float(c), False) for s, cs in closes.items() for d, c in zip(DATES, cs) if c is not None],
        "security_id long, date date, close double, is_circuit_locked boolean",
    )
    legs = spark.createDataFrame([(0, DATES[0], DATES[0], DATES[1], DATES[-1])],
                                 "rebalance_no int, signal_date date, as_of_date date, execution_date date, period_end date")
    signals = spark.createDataFrame([(1, 0, s) for s in closes], "strategy_id long, rebalance_no int, security_id long")
    f = spark.createDataFrame(list(factors), "security_id long, effective_date date, action_type string, factor double, dividend_amount double")
    x = spark.createDataFrame(list(exits), "security_id long, delisted_date date, delisting_reason string")
    strategies = spark.createDataFrame([(1, cost, 0.0, capital)], "strategy_id long, cost_bps double, slippage_bps double, capital double")
    targets = bt.targets_with_fills(signals, calendar.first_fillable(bars, legs))
    held = targets.filter("weight > 0").select("rebalance_no", "security_id", "fill_price")
    days = bt.holding_days(held, legs, calendar.trading_days(bars), bars, f, x, carry)
    growth = bt.leg_growth(targets, days)
    values = bt.leg_values(strategies, bt.trades(targets, days, growth), growth, legs, targets)
    curve = bt.equity_curve(values, growth, strategies, str(DATES[0]), str(DATES[-1]))
    return {r.date: (r.nav, r.gross_nav) for r in curve.collect()}, days


MARKET = {1: [100, 100, 120, 60, 65, 70, 80], 2: [50, 50, 55, 55, 53, 54, 56], 3: [25, 25, 27, 27, 27, None, None]}
EVENTS = [(1, DATES[3], "Split", 0.5, None), (2, DATES[4], "Dividend", None, 2.0)]
BANKRUPT = [(3, DATES[5], "Bankruptcy")]


def test_synthetic_market(spark):
    curve, _ = run(spark, MARKET, 300000.0, EVENTS, BANKRUPT)
    assert curve[DATES[0]][0] == curve[DATES[1]][0] == 300000.0
    assert curve[DATES[2]][0] == pytest.approx(338000.0)
    assert curve[DATES[3]][0] == pytest.approx(338000.0)  # the split moves no value
    assert curve[DATES[6]][0] == pytest.approx(276000.0)
    assert all(n == g for n, g in curve.values())


def test_costs_come_off_once_and_gross_adds_them_back(spark):
    curve, _ = run(spark, MARKET, 300000.0, EVENTS, BANKRUPT, cost=100.0)
    assert curve[DATES[1]][0] == pytest.approx(297000.0)
    assert curve[DATES[6]] == (pytest.approx(273000.0), pytest.approx(276000.0))


def test_basket_without_edge(spark):
    n = len(DATES)
    flat = {i: [100, 100] + [end] * (n - 2) for i, end in enumerate((125, 115, 80, 88), 1)}
    curve, _ = run(spark, flat, 200000.0)
    assert curve[DATES[-1]][0] == pytest.approx(204000.0)


def test_forced_exit_freezes_the_value(spark):
    gap = {1: [10, 10, 20, None, None, None, 90], 2: [5] * 7}
    curve, days = run(spark, gap, 100.0, carry=2)
    row = days.filter((F.col("security_id") == 1) & (F.col("date") == DATES[-1])).head()
    assert row.exit_reason == "missing" and row.exit_date == DATES[5] and row.growth == 2.0
    assert curve[DATES[-1]][0] == pytest.approx(150.0)


def test_locked_bars_are_not_filled(spark):
    bars = spark.createDataFrame([(1, DATES[i], float(i), i < 6) for i in range(7)], "security_id long, date date, close double, is_circuit_locked boolean")
    leg = spark.createDataFrame([(0, DATES[0], DATES[-1])], "rebalance_no int, execution_date date, period_end date")
    assert calendar.first_fillable(bars, leg).collect() == []  # the open bar is the seventh
    got = calendar.first_fillable(bars, leg, attempts=7).head()
    assert (got.fill_date, got.fill_price) == (DATES[6], 6.0)


@pytest.mark.parametrize("b,e,d,want", [(100.0, 121.0, 730, 0.1), (0.0, 5.0, 10, 0.0), (5.0, 6.0, 0, 0.0), (5.0, -1.0, 10, -1.0)])
def test_cagr_edges(spark, b, e, d, want):
    df = spark.createDataFrame([(b, e, d)], "b double, e double, d int")
    assert df.select(metrics.cagr(F.col("b"), F.col("e"), F.col("d")).alias("c")).head().c == pytest.approx(want)


def test_flat_curve_has_no_risk_figures(spark):
    df = metrics.with_drawdown(metrics.with_returns(spark.createDataFrame([(1, d, 5.0) for d in DATES], "strategy_id long, date date, nav double")))
    r = df.agg(metrics.sharpe(F.col("ret")).alias("a"), metrics.sortino(F.col("ret")).alias("b"), metrics.win_rate(F.col("ret")).alias("c"), F.min("drawdown").alias("d")).head()
    assert tuple(r) == (0.0, 0.0, 0.0, 0.0)


def test_signals_test_rows_against_their_own_snapshot_and_agree_with_the_index(spark):
    """Six criteria on three snapshots: the same picks by testing each row, through the index, and by hand; one criteria has a universe."""
    days = [dt.date(2024, 1, d) for d in (2, 9, 16)]
    bars = {(s, d): (float((s * 7 + k * 3) % 11), (s * 5 + k) % 6 * 1000) for s in range(40) for k, d in enumerate(days)}
    rows = spark.createDataFrame([(s, d, c, v) for (s, d), (c, v) in bars.items()], "security_id long, date date, close double, volume long")
    asked = [(k, f"c{k}", 2 + k % 3, "NYSE" if k == 5 else None, k % 4, 1000.0 * k, k % 2 == 0) for k in range(6)]
    defined = spark.createDataFrame([a[:3] for a in asked], "strategy_id long, criteria_key string, positions int")
    criteria = spark.createDataFrame(
        [(c, x, None, [("ClosePrice", "GreaterThan", float(low)), ("Volume", "LessThanOrEqual", top)], "ClosePrice", desc) for _, c, _, x, low, top, desc in asked],
        "criteria_key string, exchange string, sector string, comparisons array<struct<field: string, operator: string, value: double>>, sort_field string, descending boolean")
    legs = spark.createDataFrame([(k, 10 * k + j, d) for k in range(6) for j, d in enumerate(days) if (j + k) % 2 == 0], "strategy_id long, rebalance_no long, as_of_date date")
    want = set()
    for k, _, n, place, low, top, desc in asked:
        for j, d in enumerate(days):
            if (j + k) % 2 == 0 and place is None:
                held = sorted(((-c if desc else c), s) for (s, x), (c, v) in bars.items() if x == d and c > low and v <= top)
                want |= {(k, 10 * k + j, s, r) for r, (_, s) in enumerate(held[:n], 1)}
    for direct in (100, 0):
        got = definitions.signals(defined, criteria, legs, rows, ["ClosePrice", "Volume"], direct=direct)
        assert {tuple(r) for r in got.collect()} == want


def test_delistings_of_some_securities_use_the_whole_calendar(spark):
    bars = spark.createDataFrame([(1, DATES[0]), (2, DATES[-1])], "security_id long, date date")
    some = bars.where("security_id = 1")
    known = some.select("security_id", F.lit(True).alias("is_active"))
    assert identity.detect_delistings(known, some, days=bars.select("date")).head().delisted_date == DATES[0]
