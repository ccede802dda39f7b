"""Registered queries: window derivations, corporate actions and valuation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointpanel.fixtures import Fixtures
from pointpanel.functions.rounding import half_up
from pointpanel.operators import actions as act
from pointpanel.operators import series, valuation
from pointpanel.plans.oracle_views import rnd, rounded, with_views


def _bars(spark, sf):
    return series.numbered(Fixtures(spark, sf).bars)


def factors(fx: Fixtures):
    return act.resolve_factors(fx.actions, fx.bars)


def adjusted(fx: Fixtures):
    return act.adjusted_by_actions(fx.bars, fx.actions)


def _out(df, *cols, digits=4):
    return df.select("security_id", "date", *[half_up(c, digits).alias(c) for c in cols])


def q_sma(spark, sf):
    df = series.rolling_mean(series.rolling_mean(_bars(spark, sf), "close", 50, "sma50"), "close", 200, "sma200")
    return _out(df, "sma50", "sma200")


def q_ema(spark, sf):
    return _out(series.ema(_bars(spark, sf), "close", 50, "ema50"), "ema50")


def q_rsi(spark, sf):
    return _out(series.rsi(_bars(spark, sf), "close"), "rsi14")


def q_macd(spark, sf):
    return _out(series.macd(_bars(spark, sf), "close"), "macd")


def q_macd_signal(spark, sf):
    return _out(series.macd(_bars(spark, sf), "close"), "macd_signal")


def q_true_range(spark, sf):
    return series.true_range(_bars(spark, sf)).select("security_id", "date", "true_range")


def q_atr(spark, sf):
    return _out(series.atr(_bars(spark, sf)), "atr14")


def q_realised_vol(spark, sf):
    return _out(series.realised_vol(_bars(spark, sf), "close"), "vol30")


def q_daily_returns(spark, sf):
    return _out(series.daily_returns(_bars(spark, sf), "close"), "ret")


def q_adj_close(spark, sf):
    return _out(adjusted(Fixtures(spark, sf).with_stored_bars()), "adj_close", digits=6)


INDICATOR_COLUMNS = ["sma50", "sma200", "rsi14", "macd", "macd_signal", "atr14", "vol30"]


def q_indicators_all(spark, sf):
    df = series.indicators(adjusted(Fixtures(spark, sf).with_stored_bars()))
    return _out(df, *INDICATOR_COLUMNS)


def q_asof_price_at_report(spark, sf):
    fx = Fixtures(spark, sf)
    return valuation.price_at_report(fx.fundamentals_v2, fx.bars).select(
        "security_id", "fiscal_period_end", "reported_date", "price", "price_date"
    )


def q_asof_strictly_before(spark, sf):
    fx = Fixtures(spark, sf).with_stored_bars()
    return act.with_cum_close(fx.actions, fx.bars).select("security_id", "effective_date", "action_type", "cum_close")


def q_asof_bounded_window(spark, sf):
    fx = Fixtures(spark, sf).with_stored_bars()
    df = act.surrounding_prices(fx.actions, fx.bars.withColumn("adj_close", F.col("close")))
    return df.select("security_id", "effective_date", "action_type", "close_before", "close_after")


def q_ratios(spark, sf):
    fx = Fixtures(spark, sf)
    df = valuation.ratios(fx.fundamentals_v2, fx.bars)
    cols = ["price", "market_cap", "pe", "pb", "ps", "roe", "debt_to_equity", "gross_margin", "roic", "fcf_yield"]
    return df.select("security_id", "reported_date", *[half_up(c, 6).alias(c) for c in cols])


def q_market_cap(spark, sf):
    fx = Fixtures(spark, sf)
    return valuation.ratios(fx.fundamentals_v2, fx.bars).select(
        "security_id", "reported_date", "market_cap"
    )


def q_factor_product(spark, sf):
    return act.factor_per_date(factors(Fixtures(spark, sf).with_stored_bars())).select(
        "security_id", "effective_date", "n_actions", half_up("factor", 6).alias("factor")
    )


def q_actions_sharing_date(spark, sf):
    fx = Fixtures(spark, sf).with_stored_bars()
    return act.reconcile(fx.actions, fx.bars).select("security_id", "effective_date", "action_type", "actions_sharing_date")


def q_action_reconcile(spark, sf):
    fx = Fixtures(spark, sf).with_stored_bars()
    return act.reconcile(fx.actions, fx.bars)


def q_reconcile_report(spark, sf):
    return act.reconcile_report(q_action_reconcile(spark, sf))


def q_reconcile_worst(spark, sf):
    """The sixty worst deviations, ties by security, date and type."""
    return (
        q_action_reconcile(spark, sf)
        .filter(F.col("deviation").isNotNull())
        .orderBy(F.desc("deviation"), "security_id", "effective_date", "action_type")
        .limit(60)
    )


QUERIES = {
    "sma": q_sma, "ema": q_ema, "rsi": q_rsi, "macd": q_macd, "macd_signal": q_macd_signal,
    "true_range": q_true_range, "atr": q_atr, "realised_vol": q_realised_vol, "daily_returns": q_daily_returns,
    "adj_close": q_adj_close, "indicators_all": q_indicators_all,
    "asof_price_at_report": q_asof_price_at_report, "asof_strictly_before": q_asof_strictly_before,
    "asof_bounded_window": q_asof_bounded_window, "ratios": q_ratios, "market_cap": q_market_cap,
    "factor_product": q_factor_product, "actions_sharing_date": q_actions_sharing_date,
    "action_reconcile": q_action_reconcile, "reconcile_report": q_reconcile_report,
    "reconcile_worst": q_reconcile_worst,
}

_W = "OVER (PARTITION BY security_id ORDER BY date)"


def _roll(fn: str, n: int) -> str:
    return f"{fn} OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _numbered(src: str, close: str = "close") -> str:
    return (
        f"SELECT security_id, date, high, low, {close} AS x, lag({close}) {_W} AS px, row_number() {_W} AS rn FROM {src}"
    )


def _recursion(name: str, src: str, seeds: str, steps: str, cols: str, first: int) -> str:
    """A recursive walk: seeds at row ``first``, one step per following row."""
    return f"""
{name} AS (
  SELECT s.security_id, s.rn, {seeds} FROM {src} s WHERE s.rn = {first}
  UNION ALL
  SELECT s.security_id, s.rn, {steps} FROM {name} p JOIN {src} s ON s.security_id = p.security_id AND s.rn = p.rn + 1
)"""


def indicator_ctes(src: str, close: str = "close") -> str:
    """CTE list computing every smoother of ``src`` by plain recursion; ends in view ``ind``."""
    return f"""
nb AS ({_numbered(src, close)}),
ch AS (SELECT *, greatest(coalesce(x - px, 0), 0) AS g, greatest(coalesce(px - x, 0), 0) AS l,
         CASE WHEN px IS NULL THEN high - low ELSE greatest(high - low, abs(high - px), abs(low - px)) END AS tr,
         CASE WHEN rn > 1 THEN CASE WHEN x > 0 AND px > 0 THEN ln(x / px) ELSE 0 END END AS lr FROM nb),
seed AS (SELECT *, {_roll('avg(x)', 12)} AS a12, {_roll('avg(x)', 26)} AS a26, {_roll('avg(x)', 50)} AS a50,
         {_roll('avg(x)', 200)} AS a200, {_roll('avg(g)', 14)} AS ag, {_roll('avg(l)', 14)} AS al,
         {_roll('avg(tr)', 14)} AS atr, {_roll('stddev_pop(lr)', 30)} AS sd FROM ch),
{_recursion('e12', 'seed', 's.a12 AS e', 'p.e + (s.x - p.e) * 2.0 / 13', 'e', 12)},
{_recursion('e26', 'seed', 's.a26 AS e', 'p.e + (s.x - p.e) * 2.0 / 27', 'e', 26)},
{_recursion('e50', 'seed', 's.a50 AS e', 'p.e + (s.x - p.e) * 2.0 / 51', 'e', 50)},
{_recursion('wil', 'seed', 's.ag AS g, s.al AS l, s.atr AS t',
            '(p.g * 13 + s.g) / 14, (p.l * 13 + s.l) / 14, (p.t * 13 + s.tr) / 14', 'g, l, t', 15)},
mc AS (SELECT e26.security_id, e26.rn, e12.e - e26.e AS x FROM e26 JOIN e12 USING (security_id, rn)),
ms AS (SELECT *, avg(x) OVER (PARTITION BY security_id ORDER BY rn ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS a9 FROM mc),
{_recursion('sig', 'ms', 's.a9 AS e', 'p.e + (s.x - p.e) * 2.0 / 10', 'e', 34)},
ind AS (SELECT d.security_id, d.date, d.rn, CASE WHEN d.rn >= 50 THEN a50 END AS sma50, CASE WHEN d.rn >= 200 THEN a200 END AS sma200,
          e50.e AS ema50, CASE WHEN wil.l = 0 THEN 100 ELSE 100 - 100 / (1 + wil.g / wil.l) END AS rsi14,
          mc.x AS macd, sig.e AS macd_signal, wil.t AS atr14, CASE WHEN d.rn > 30 THEN sd * sqrt(252) END AS vol30,
          d.tr AS true_range, wil.rn AS wil_rn
        FROM seed d LEFT JOIN e50 USING (security_id, rn) LEFT JOIN wil USING (security_id, rn)
        LEFT JOIN mc USING (security_id, rn) LEFT JOIN sig USING (security_id, rn))"""


def _indicator_sql(select: str, src: str = "fx_bars", close: str = "close") -> str:
    sql = with_views(f"SELECT * FROM {src}")
    head = sql[len("WITH "): sql.rindex("SELECT * FROM " + src)].rstrip()
    return f"WITH RECURSIVE {head},{indicator_ctes(src, close)}\nSELECT security_id, date, {select} FROM ind"


_RSI = "CASE WHEN wil_rn IS NOT NULL THEN " + rnd("rsi14", 4) + " END AS rsi14"
_RATIO_COLS = ["price", "market_cap", "pe", "pb", "ps", "roe", "debt_to_equity", "gross_margin", "roic", "fcf_yield"]

_RECONCILE = """
SELECT security_id, effective_date, action_type, actions_sharing_date, round_even(cmp, 4) AS comparison_factor,
       round_even(implied, 4) AS implied_factor, round_even(deviation, 4) AS deviation,
       round_even(CASE WHEN implied IS NOT NULL AND adj_before > 0 AND adj_after > 0
                  THEN abs(adj_after - adj_before) / adj_before END, 4) AS adjusted_step,
       CASE WHEN implied IS NULL THEN 'Skipped' WHEN deviation <= 0.05 THEN 'Agrees'
            WHEN deviation IS NOT NULL THEN 'Disagrees' WHEN action_type = 'Dividend' THEN 'NotApplicable'
            ELSE 'Unadjusted' END AS status
FROM (SELECT *, CASE WHEN cmp > 0 THEN abs(implied - cmp) / cmp END AS deviation
  FROM (SELECT *, CASE WHEN close_before > 0 AND close_after > 0 THEN close_after / close_before END AS implied,
               CASE WHEN actions_sharing_date > 1 THEN coalesce(combined, factor) ELSE factor END AS cmp
    FROM (SELECT f.*,
            count(CASE WHEN f.action_type IN ('Split','Bonus','Rights') THEN 1 END)
              OVER (PARTITION BY f.security_id, f.effective_date) AS actions_sharing_date,
            (SELECT product(g.factor) FROM fx_factors g WHERE g.security_id = f.security_id
               AND g.effective_date = f.effective_date AND g.factor > 0) AS combined,
            CASE WHEN a.date <= f.effective_date + 10 THEN a.close END AS close_after,
            CASE WHEN a.date <= f.effective_date + 10 THEN a.adj_close END AS adj_after,
            CASE WHEN b.date >= f.effective_date - 10 THEN b.close END AS close_before,
            CASE WHEN b.date >= f.effective_date - 10 THEN b.adj_close END AS adj_before
          FROM fx_factors f
          ASOF LEFT JOIN fx_adjusted a ON f.security_id = a.security_id AND f.effective_date <= a.date
          ASOF LEFT JOIN fx_adjusted b ON f.security_id = b.security_id AND f.effective_date > b.date) x) y) z"""

ORACLES = {
    "sma": with_views(
        f"SELECT security_id, date, CASE WHEN rn >= 50 THEN {rnd('a', 4)} END AS sma50, "
        f"CASE WHEN rn >= 200 THEN {rnd('b', 4)} END AS sma200 FROM (SELECT security_id, date, row_number() {_W} AS rn, "
        f"{_roll('avg(close)', 50)} AS a, {_roll('avg(close)', 200)} AS b FROM fx_bars) t"
    ),
    "ema": _indicator_sql(rounded("ema50", digits=4)),
    "rsi": _indicator_sql(_RSI),
    "macd": _indicator_sql(rounded("macd", digits=4)),
    "macd_signal": _indicator_sql(rounded("macd_signal", digits=4)),
    "true_range": _indicator_sql("true_range"),
    "atr": _indicator_sql(rounded("atr14", digits=4)),
    "realised_vol": _indicator_sql(rounded("vol30", digits=4)),
    "daily_returns": with_views(
        f"SELECT security_id, date, {rnd('CASE WHEN p = 0 THEN 0 ELSE close / p - 1 END', 4)} AS ret "
        f"FROM (SELECT *, lag(close) {_W} AS p FROM fx_bars) t"
    ),
    "adj_close": with_views(f"SELECT security_id, date, {rnd('adj_close')} AS adj_close FROM fx_adjusted"),
    "indicators_all": _indicator_sql(
        rounded("sma50", "sma200", digits=4) + ", " + _RSI + ", " + rounded("macd", "macd_signal", "atr14", "vol30", digits=4),
        "fx_adjusted", "adj_close",
    ),
    "asof_price_at_report": with_views(
        "SELECT f.security_id, f.fiscal_period_end, f.reported_date, b.close AS price, b.date AS price_date "
        "FROM fx_fundamentals_v2 f ASOF LEFT JOIN fx_bars b "
        "ON f.security_id = b.security_id AND f.reported_date >= b.date"
    ),
    "asof_strictly_before": with_views(
        "SELECT security_id, effective_date, action_type, cum_close FROM fx_factors"
    ),
    "asof_bounded_window": with_views(
        "SELECT f.security_id, f.effective_date, f.action_type, "
        "CASE WHEN b.date >= f.effective_date - 10 THEN b.close END AS close_before, "
        "CASE WHEN a.date <= f.effective_date + 10 THEN a.close END AS close_after FROM fx_actions f "
        "ASOF LEFT JOIN fx_bars a ON f.security_id = a.security_id AND f.effective_date <= a.date "
        "ASOF LEFT JOIN fx_bars b ON f.security_id = b.security_id AND f.effective_date > b.date"
    ),
    "ratios": with_views(f"SELECT security_id, reported_date, {rounded(*_RATIO_COLS)} FROM fx_ratios"),
    "market_cap": with_views(
        "SELECT security_id, reported_date, market_cap FROM fx_ratios"
    ),
    "factor_product": with_views(
        "SELECT security_id, effective_date, count(*) AS n_actions, " + rnd("product(factor)") + " AS factor "
        "FROM fx_factors WHERE factor > 0 GROUP BY 1, 2"
    ),
    "actions_sharing_date": with_views(
        "SELECT a.security_id, a.effective_date, a.action_type, (SELECT count(*) FROM fx_actions x "
        "WHERE x.security_id = a.security_id AND x.effective_date = a.effective_date "
        "AND x.action_type IN ('Split', 'Bonus', 'Rights')) AS actions_sharing_date FROM fx_actions a"
    ),
    "action_reconcile": with_views("SELECT * FROM fx_checks", fx_checks=_RECONCILE),
    "reconcile_report": with_views(
        "SELECT count(*) FILTER (status = 'Agrees') AS agrees, count(*) FILTER (status = 'Disagrees') AS disagrees, "
        "count(*) FILTER (status = 'Unadjusted') AS unadjusted, "
        "count(*) FILTER (status = 'NotApplicable') AS notapplicable, count(*) FILTER (status = 'Skipped') AS skipped, "
        "count(DISTINCT security_id) FILTER (status <> 'Skipped') AS distinct_securities, "
        "count(DISTINCT security_id) FILTER (status <> 'Skipped') >= 20 AS meets_sample FROM fx_checks",
        fx_checks=_RECONCILE,
    ),
    "reconcile_worst": with_views(
        "SELECT * FROM fx_checks WHERE deviation IS NOT NULL "
        "ORDER BY deviation DESC, security_id, effective_date, action_type LIMIT 60",
        fx_checks=_RECONCILE,
    ),
}
