"""Registered queries: screens, their joins, ranking and set comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointpanel.fixtures import Fixtures
from pointpanel.functions.rounding import half_up
from pointpanel.functions.text import content_key
from pointpanel.operators import alerts, calendar, concepts, identity, screen, series, valuation
from pointpanel.operators.asof import latest_as_of, panel_as_of
from pointpanel.plans.oracle_views import rnd, rounded, with_views
from pointpanel.plans.series import adjusted, indicator_ctes
from pointpanel.session import stored

AS_OF = "2001-01-01"


def ratios_of(fx: Fixtures) -> DataFrame:
    return valuation.ratios(fx.fundamentals_v2, fx.bars)


def _raw(fx: Fixtures) -> DataFrame:
    """Bars whose adjusted close is the traded one: for screens that test neither."""
    return fx.bars.withColumn("adj_close", F.col("close"))


def base(fx: Fixtures) -> DataFrame:
    return screen.panel_frame(fx.securities, _raw(fx), AS_OF, ratios=ratios_of(fx))


def _cmp(field, op, value):
    return {"kind": "comparison", "field": field, "operator": op, "value": value}


def _and(*children):
    return {"kind": "group", "op": "And", "children": list(children)}


def _ids(df: DataFrame) -> DataFrame:
    return df.select("security_id", "ticker", "close")


def q_screen_predicate(spark, sf):
    """All six comparison operators of the filter language on one frame, as flags."""
    frame = base(Fixtures(spark, sf))
    tests = [("LessThan", 2000), ("LessThanOrEqual", 2000), ("GreaterThan", 2000), ("GreaterThanOrEqual", 2000),
             ("Equal", 2000), ("NotEqual", 2000)]
    flags = [screen.comparison("ClosePrice", o, v).alias(o.lower()) for o, v in tests]
    return frame.filter(screen.predicate(_cmp("ClosePrice", "GreaterThan", 500))).select("security_id", *flags)


def q_screen_group_and(spark, sf):
    tree = _and(_cmp("ClosePrice", "GreaterThan", 500), _and(_cmp("PbRatio", "LessThan", 15), _cmp("Volume", "GreaterThan", 5000)))
    return _ids(base(Fixtures(spark, sf)).filter(screen.predicate(tree)))


def q_screen_null_semantics(spark, sf):
    """Neither a comparison nor its complement selects a security whose ratio is null."""
    frame = base(Fixtures(spark, sf))
    low, high = screen.comparison("PeRatio", "LessThan", 20), screen.comparison("PeRatio", "GreaterThanOrEqual", 20)
    return frame.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(low).alias("below"), F.count_if(high).alias("at_or_above"),
        F.count_if(F.col("pe").isNull()).alias("unknown"),
    )


def q_screen_universe(spark, sf):
    frame = base(Fixtures(spark, sf))
    return _ids(frame.filter(screen.in_universe({"exchange": "ASIA"}) | screen.in_universe({"exchange": "EUROPE", "sector": "NATION_3"})))


def q_screen_projection(spark, sf):
    fx = Fixtures(spark, sf)
    return screen.panel_frame(fx.securities, _raw(fx), AS_OF).select(*screen.PROJECTION)


def q_screen_survivorship(spark, sf):
    """Securities that stopped trading before the date are still screened, at their last price."""
    fx = Fixtures(spark, sf)
    frame = screen.panel_frame(fx.securities, _raw(fx), AS_OF)
    return frame.filter(F.col("price_date") < F.lit("2000-07-01").cast("date")).select("security_id", "price_date", "close")


def q_asof_latest_bar(spark, sf):
    return latest_as_of(Fixtures(spark, sf).bars, AS_OF, ["open", "high", "low", "close", "volume"])


def q_asof_latest_ratio(spark, sf):
    out = latest_as_of(ratios_of(Fixtures(spark, sf)), AS_OF, ["pe", "pb", "roe"], date="reported_date")
    return out.select("security_id", "reported_date", *[half_up(c, 6).alias(c) for c in ("pe", "pb", "roe")])


def q_join_indicator_same_day(spark, sf):
    fx = Fixtures(spark, sf)
    ind = series.rolling_mean(series.numbered(fx.bars), "close", 50, "sma50").select("security_id", "date", "sma50")
    frame = screen.join_indicators(screen.panel_frame(fx.securities, _raw(fx), AS_OF), ind)
    return frame.select("security_id", "price_date", "close", half_up("sma50", 4).alias("sma50"))


def q_bitemporal_read(spark, sf):
    """What a reader on the date could know: the version current then, of filings published by then."""
    d = F.lit(AS_OF).cast("date")
    rows = Fixtures(spark, sf).fundamentals_scd2.filter(
        (F.col("valid_from") <= d) & (d < F.col("valid_to")) & (F.col("reported_date") <= d)
    )
    keep = ["reported_date", "revenue", "net_income", "valid_from"]
    return rows.groupBy("security_id").agg(
        F.max("fiscal_period_end").alias("fiscal_period_end"),
        *[F.max_by(c, F.struct("fiscal_period_end", "valid_from")).alias(c) for c in keep],
    )


def q_next_trading_date(spark, sf):
    fx = Fixtures(spark, sf)
    return calendar.next_trading_dates(calendar.trading_days(fx.bars), fx.orders_dates, "order_date")


def q_circuit_lock_flag(spark, sf):
    return identity.with_lock_flag(Fixtures(spark, sf).bars).select("security_id", "date", "is_circuit_locked")


END = "2001-06-30"


def legs(fx: Fixtures) -> DataFrame:
    return calendar.execution_legs(fx.rebalance, fx.snapshots, calendar.trading_days(fx.bars), END)


def q_execution_legs(spark, sf):
    return legs(Fixtures(spark, sf).with_stored_bars())


def q_first_fillable_bar(spark, sf):
    fx = Fixtures(spark, sf).with_stored_bars()
    return calendar.first_fillable(identity.with_lock_flag(fx.bars), legs(fx))


def q_semi_holdings(spark, sf):
    fx = Fixtures(spark, sf)
    held = fx.securities.filter(F.col("exchange") == "ASIA").select("security_id")
    lo, hi = F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date")
    return fx.bars.filter(F.col("date").between(lo, hi)).join(held, "security_id", "left_semi").select(
        "security_id", "date", "close"
    )


def panel(fx: Fixtures) -> DataFrame:
    """(signal_date, security_id, close, volume, pb) at every rebalance date."""
    prices = panel_as_of(fx.bars, fx.rebalance, ["close", "volume"])
    known = panel_as_of(
        ratios_of(fx), fx.rebalance, ["pb"], date="reported_date", date_alias="reported_date"
    )
    return prices.join(known, ["security_id", "signal_date"], "left")


def selection(fx: Fixtures, n: int = 5) -> DataFrame:
    """The screen at every rebalance date, cheapest ``n`` by price-to-book."""
    hits = panel(fx).filter((F.col("close") > 500) & (F.col("pb") < 15))
    return screen.top_per_group(hits, ["signal_date"], ["pb", "security_id"], n)


def q_screen_panel(spark, sf):
    hits = panel(Fixtures(spark, sf).with_stored_bars()).filter((F.col("close") > 500) & (F.col("pb") < 15))
    return hits.select("signal_date", "security_id", "close", "volume", "price_date", half_up("pb", 6).alias("pb"))


def q_max_positions(spark, sf):
    return selection(Fixtures(spark, sf).with_stored_bars()).select("signal_date", "security_id", F.col("rank").cast("long").alias("rank"))


def equal_weights(chosen: DataFrame) -> DataFrame:
    return chosen.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("rebalance_no")))


def numbered_selection(fx: Fixtures) -> DataFrame:
    return selection(fx).join(F.broadcast(fx.rebalance), "signal_date").select("rebalance_no", "security_id")


def q_equal_weight(spark, sf):
    return equal_weights(numbered_selection(Fixtures(spark, sf).with_stored_bars()))


# Fixed value: smaller differences in weight are not traded.
MIN_DELTA = 0.0001


def trade_list(current: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Target against current weights; differences below the threshold are not traded."""
    c = current.select(*keys, F.col("weight").alias("current_weight"))
    t = target.select(*keys, F.col("weight").alias("target_weight"))
    both = c.join(t, keys, "full_outer").fillna(0.0, ["current_weight", "target_weight"])
    return both.withColumn("delta", F.col("target_weight") - F.col("current_weight")).filter(
        F.abs("delta") >= MIN_DELTA
    )


def q_trade_list_diff(spark, sf):
    now = stored(equal_weights(numbered_selection(Fixtures(spark, sf).with_stored_bars())), "weights")
    before = now.withColumn("rebalance_no", F.col("rebalance_no") + 1)
    trades = trade_list(before, now, ["rebalance_no", "security_id"])
    return trades.withColumn("notional", F.abs("delta") * 100000.0)


def q_keys_union(spark, sf):
    """Securities held before or wanted now, per rebalance."""
    now = stored(numbered_selection(Fixtures(spark, sf).with_stored_bars()), "selection")
    before = now.withColumn("rebalance_no", F.col("rebalance_no") + 1)
    return now.union(before).distinct()


def q_trading_calendar(spark, sf):
    fx = Fixtures(spark, sf).with_stored_bars()
    held = selection(fx).select("security_id").distinct()
    return calendar.trading_days(fx.bars.join(held, "security_id", "left_semi"))


FLAGSHIP = {
    "universe": {},
    "root": _and(
        _cmp("ClosePrice", "GreaterThan", 0), _cmp("PbRatio", "LessThan", 15), _cmp("Rsi14", "LessThan", 60),
        _cmp("Volatility30", "GreaterThan", 0),
    ),
    "sort": {"field": "PbRatio", "direction": "Asc"},
    "limit": 200,
}


def q_screen_full(spark, sf):
    """The composed screen. Indicators and prices come from one pass over the bars, so nothing is joined back."""
    fx = Fixtures(spark, sf).with_stored_bars()
    # an indicator looks back only, so bars after the date are dropped before the windows; later actions still adjust
    known_bars = adjusted(fx).filter(F.col("date") <= F.lit(AS_OF).cast("date"))
    rows = series.indicators(known_bars, keep=("close", "adj_close", "volume"))
    latest = latest_as_of(
        rows, AS_OF, ["close", "adj_close", "volume", *screen.INDICATOR_COLUMNS], date_alias="price_date"
    )
    known = latest_as_of(ratios_of(fx), AS_OF, screen.RATIO_COLUMNS, date="reported_date")
    frame = fx.securities.join(latest, "security_id").join(known, "security_id", "left")
    out = screen.screen(frame, FLAGSHIP)
    return out.select(
        *[c for c in screen.PROJECTION if c != "adj_close"],
        *[half_up(c, 4).alias(c) for c in ("adj_close", "pb", "sma50", "rsi14", "vol30")],
    )


def q_screen_sort_limit(spark, sf):
    fx = Fixtures(spark, sf)
    criteria = {"root": _cmp("ClosePrice", "GreaterThan", 0), "sort": {"field": "PeRatio", "direction": "Asc"}, "limit": 40}
    return screen.screen(base(fx), criteria).select("security_id", "ticker", half_up("pe", 6).alias("pe"))


def q_screen_default_sort(spark, sf):
    return _ids(screen.screen(base(Fixtures(spark, sf)), {"root": _cmp("ClosePrice", "GreaterThan", 0)}))


def q_top1_per_key(spark, sf):
    """The most expensive bar of each security; ties go to the earlier day."""
    return Fixtures(spark, sf).bars.groupBy("security_id").agg(
        F.max("close").alias("close"), F.min_by("date", F.struct(-F.col("close"), F.col("date"))).alias("date")
    )


def q_fetch_priority(spark, sf):
    """Securities never fetched come first, then by ticker."""
    fx = Fixtures(spark, sf)
    fetched = (
        fx.fundamentals_v1.filter(F.col("revenue") > 750000).select("security_id").distinct()
        .withColumn("was_fetched", F.lit(1))
    )
    return (
        fx.securities.filter("is_active").join(fetched, "security_id", "left")
        .select("security_id", "ticker", F.coalesce("was_fetched", F.lit(0)).alias("was_fetched"))
        .orderBy("was_fetched", "ticker").limit(30)
    )


# --- many saved criteria ---------------------------------------------------------------------------------------------

_FIRST = (
    "CASE k % 5 WHEN 0 THEN 'PeRatio' WHEN 1 THEN 'PbRatio' WHEN 2 THEN 'ClosePrice' WHEN 3 THEN 'Volume' "
    "ELSE 'DebtToEquity' END"
)
_FIRST_VALUE = (
    "(k % 12) * CASE k % 5 WHEN 0 THEN 5 WHEN 1 THEN 2 WHEN 2 THEN 400 WHEN 3 THEN 5000 ELSE 1 END"
)
_FIRST_OP = (
    "CASE k % 4 WHEN 0 THEN 'LessThan' WHEN 1 THEN 'LessThanOrEqual' WHEN 2 THEN 'GreaterThan' "
    "ELSE 'GreaterThanOrEqual' END"
)
_SECOND = "CASE k % 3 WHEN 0 THEN 'GrossMargin' WHEN 1 THEN 'ReturnOnEquity' ELSE 'PsRatio' END"
_SECOND_VALUE = "k % 10"


def _strategy_json(cast: str) -> str:
    return (
        "concat('{\"universe\":{},\"root\":{\"kind\":\"group\",\"op\":\"And\",\"children\":["
        "{\"kind\":\"comparison\",\"field\":\"', f1, '\",\"operator\":\"', o1, '\",\"value\":', "
        f"CAST(v1 AS {cast}), '}},{{\"kind\":\"comparison\",\"field\":\"', f2, "
        f"'\",\"operator\":\"GreaterThan\",\"value\":', CAST(v2 AS {cast}), '}}]}},\"limit\":20}}')"
    )


def strategies(fx: Fixtures) -> DataFrame:
    """One saved strategy per customer as criteria JSON; many customers save the same definition."""
    return (
        fx.table("customer")
        .selectExpr("c_custkey AS strategy_id", "c_custkey % 60 AS k")
        .selectExpr("strategy_id", f"{_FIRST} AS f1", f"{_FIRST_OP} AS o1", f"{_FIRST_VALUE} AS v1", f"{_SECOND} AS f2",
                    f"{_SECOND_VALUE} AS v2")
        .selectExpr("strategy_id", _strategy_json("STRING") + " AS criteria_json")
    )


_BULK_FIELD = (
    "CASE k % 6 WHEN 0 THEN 'PeRatio' WHEN 1 THEN 'PbRatio' WHEN 2 THEN 'ClosePrice' WHEN 3 THEN 'Volume' WHEN 4 THEN 'DebtToEquity' "
    "ELSE 'Sma50' END"
)
_BULK_VALUE = "k % 7000"
_BULK_SCALE = "CASE k % 6 WHEN 0 THEN 'e-2' WHEN 1 THEN 'e-3' WHEN 2 THEN 'e0' WHEN 3 THEN 'e1' WHEN 4 THEN 'e-3' ELSE 'e0' END"
_BULK_SHAPE = "CASE WHEN k % 50 = 9 THEN 'bare' WHEN k % 10 = 7 THEN 'or' WHEN k % 10 = 3 THEN 'nested' ELSE 'flat' END"
_BULK_PLACE = "CASE k % 4 WHEN 1 THEN 'ASIA' WHEN 3 THEN 'EUROPE' ELSE '' END"
_BULK_SORT = "CASE k % 3 WHEN 1 THEN 'PeRatio' WHEN 2 THEN 'ClosePrice' ELSE '' END"
_BULK_LIMIT = "CASE WHEN k % 5 = 0 THEN NULL ELSE 20 END"


def _bulk_columns(text: str) -> list[str]:
    """The parts of a saved criteria and its JSON, in SQL that both engines read."""
    one = (f"concat('{{\"kind\":\"comparison\",\"field\":\"', f1, '\",\"operator\":\"', o1, '\",\"value\":', CAST(n1 AS {text}), e1, '}}')")
    two = (f"concat('{{\"kind\":\"comparison\",\"field\":\"', f2, '\",\"operator\":\"GreaterThan\",\"value\":', CAST(v2 AS {text}), '}}')")
    group = "concat('{\"kind\":\"group\",\"op\":\"', CASE shape WHEN 'or' THEN 'Or' ELSE 'And' END, '\",\"children\":[', {}, ']}}')"
    nested = "concat('{\"kind\":\"group\",\"op\":\"And\",\"children\":[', two, ']}')"
    return [
        f"{one} AS one", f"{two} AS two", nested + " AS inner_group",
        "concat('{\"universe\":{', CASE place WHEN '' THEN '' ELSE concat('\"exchange\":\"', place, '\"') END, '},\"root\":', "
        "CASE shape WHEN 'bare' THEN one WHEN 'nested' THEN " + group.replace("{}", "concat(one, ',', inner_group)", 1).replace("}}", "}")
        + " ELSE " + group.replace("{}", "concat(one, ',', two)", 1).replace("}}", "}") + " END, "
        "CASE sort_field WHEN '' THEN '' ELSE concat(',\"sort\":{\"field\":\"', sort_field, '\",\"direction\":\"', "
        "CASE sort_field WHEN 'PeRatio' THEN 'Desc' ELSE 'Asc' END, '\"}') END, "
        f"CASE WHEN lim IS NULL THEN '' ELSE concat(',\"limit\":', CAST(lim AS {text})) END, '}}') AS criteria_json",
    ]


_BULK_PARTS = [
    "strategy_id", f"{_BULK_FIELD} AS f1", f"{_FIRST_OP} AS o1", f"{_BULK_VALUE} AS n1", f"{_BULK_SCALE} AS e1", f"{_SECOND} AS f2",
    f"{_SECOND_VALUE} AS v2", f"{_BULK_SHAPE} AS shape", f"{_BULK_PLACE} AS place", f"{_BULK_SORT} AS sort_field", f"{_BULK_LIMIT} AS lim",
]


def saved_criteria(fx: Fixtures) -> DataFrame:
    """One saved criteria per customer: universes, nested, bare and Or roots, own sorts, missing limits, thousands of definitions."""
    one, two, inner, text = _bulk_columns("STRING")
    parts = fx.table("customer").selectExpr("c_custkey AS strategy_id", "c_custkey AS k").selectExpr(*_BULK_PARTS)
    return parts.selectExpr("*", one, two).selectExpr("*", inner).selectExpr("strategy_id", text)


def distinct_criteria(saved: DataFrame) -> DataFrame:
    return saved.groupBy(F.substring(F.sha2("criteria_json", 256), 1, 32).alias("criteria_key")).agg(
        F.min("criteria_json").alias("criteria_json"), F.count(F.lit(1)).alias("n_strategies")
    )


def bulk_frame(fx: Fixtures) -> DataFrame:
    """The panel as of one date with ratios and a technical metric. Later bars have no part in it, so they leave before the bars are written for
    both uses and before the windows."""
    known = stored(fx.bars.where(F.col("date") <= F.lit(AS_OF).cast("date")).select("security_id", "date", "close", "volume"), "bars")
    bars = series.rolling_mean(series.numbered(known.withColumn("adj_close", F.col("close"))), "close", 50, "sma50")
    latest = latest_as_of(bars, AS_OF, ["close", "adj_close", "volume", "sma50"], date_alias="price_date")
    filed = fx.fundamentals_v2.where(F.col("reported_date") <= F.lit(AS_OF).cast("date"))
    ratios = latest_as_of(valuation.ratios(filed, known), AS_OF, screen.RATIO_COLUMNS, date="reported_date")
    return fx.securities.join(latest, "security_id").join(ratios, "security_id", "left")


def q_screen_bulk(spark, sf):
    """Hits of every valid criteria, ranked by its own order, and a row for each rule that keeps one from running."""
    fx = Fixtures(spark, sf)
    keyed = stored(distinct_criteria(saved_criteria(fx)), "criteria")
    own = keyed.select(F.col("criteria_key").alias("strategy_id"), "criteria_json")
    read = stored(concepts.read_criteria(own), "read")
    valid = stored(concepts.runnable(read).withColumnRenamed("strategy_id", "criteria_key"), "valid")
    hits = screen.screen_many(bulk_frame(fx), valid, ["security_id"]).select(
        "criteria_key", F.lit("hit").alias("kind"), F.lit("").alias("code"), "security_id", F.col("rank").cast("long").alias("rank"))
    refused = concepts.refused(read).select(
        F.col("strategy_id").alias("criteria_key"), F.lit("refused").alias("kind"), "code", F.lit(None).cast("long").alias("security_id"),
        F.lit(None).cast("long").alias("rank"))
    return hits.union(refused).join(keyed.select("criteria_key", "n_strategies"), "criteria_key")


# --- membership over time --------------------------------------------------------------------------------------------

RULES = [(1, "close", 2000.0), (2, "close", 3500.0), (3, "volume", 20000.0)]


def membership(fx: Fixtures) -> DataFrame:
    """(strategy_id, as_of_date, security_id) of three standing screens at every rebalance date."""
    rows = panel_as_of(fx.bars, fx.rebalance, ["close", "volume"])
    ids = F.array_compact(F.array(*[F.when(F.col(c) < v, F.lit(i).cast("long")) for i, c, v in RULES]))
    return rows.select(F.explode(ids).alias("strategy_id"), F.col("signal_date").alias("as_of_date"), "security_id")


def runs(fx: Fixtures) -> DataFrame:
    """Every run that took place, also those nobody passed."""
    return fx.rebalance.select(
        F.explode(F.array(*[F.lit(i).cast("long") for i, _, _ in RULES])).alias("strategy_id"),
        F.col("signal_date").alias("as_of_date"),
    )


def q_alert_diff(spark, sf):
    fx = Fixtures(spark, sf)
    m = membership(fx)
    day = lambda d: F.col("as_of_date") == F.lit(d).cast("date")
    return alerts.diff_runs(m.filter(day("2000-07-02")), m.filter(day("2000-10-02")), runs(fx).filter(day("2000-07-02")))


def q_alert_diff_history(spark, sf):
    fx = Fixtures(spark, sf)
    return alerts.diff_history(membership(fx), runs(fx))


def q_alerts_latest_n(spark, sf):
    fx = Fixtures(spark, sf)
    return alerts.latest_events(alerts.diff_history(membership(fx), runs(fx)), 1, 100)


def q_content_key(spark, sf):
    fx = Fixtures(spark, sf)
    return strategies(fx).select(
        "strategy_id", content_key(F.col("criteria_json"), F.col("strategy_id") % 7).alias("content_key")
    )


QUERIES = {
    "screen_full": q_screen_full, "screen_predicate": q_screen_predicate, "screen_group_and": q_screen_group_and,
    "screen_null_semantics": q_screen_null_semantics, "screen_universe": q_screen_universe,
    "screen_projection": q_screen_projection, "screen_survivorship": q_screen_survivorship,
    "asof_latest_bar": q_asof_latest_bar, "asof_latest_ratio": q_asof_latest_ratio,
    "join_indicator_same_day": q_join_indicator_same_day, "bitemporal_read": q_bitemporal_read,
    "next_trading_date": q_next_trading_date, "circuit_lock_flag": q_circuit_lock_flag,
    "bt_execution_dates": q_execution_legs, "first_fillable_bar": q_first_fillable_bar,
    "semi_holdings": q_semi_holdings, "screen_panel": q_screen_panel, "max_positions": q_max_positions,
    "equal_weight": q_equal_weight, "trade_list_diff": q_trade_list_diff, "keys_union": q_keys_union,
    "trading_calendar": q_trading_calendar, "screen_sort_limit": q_screen_sort_limit,
    "screen_default_sort": q_screen_default_sort, "top1_per_key": q_top1_per_key, "fetch_priority": q_fetch_priority,
    "screen_bulk": q_screen_bulk, "alert_diff": q_alert_diff, "alert_diff_history": q_alert_diff_history,
    "alerts_latest_n": q_alerts_latest_n, "content_key": q_content_key,
}

_LATEST_BAR = f"""
SELECT security_id, date AS price_date, open, high, low, close, volume FROM fx_bars WHERE date <= DATE '{AS_OF}'
QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY date DESC) = 1"""
_LATEST_RATIO = f"""
SELECT * EXCLUDE (price) FROM fx_ratios WHERE reported_date <= DATE '{AS_OF}'
QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY reported_date DESC) = 1"""
_BASE = """
SELECT s.*, b.price_date, b.close, b.volume, r.* EXCLUDE (security_id)
FROM fx_securities s JOIN fx_latest_bar b USING (security_id) LEFT JOIN fx_latest_ratio r USING (security_id)"""
_PANEL = """
SELECT r.rebalance_no, r.signal_date, s.security_id, b.date AS price_date, b.close, b.volume, q.pb
FROM fx_rebalance r CROSS JOIN (SELECT DISTINCT security_id FROM fx_bars) s
ASOF JOIN fx_bars b ON b.security_id = s.security_id AND r.signal_date >= b.date
ASOF LEFT JOIN fx_ratios q ON q.security_id = s.security_id AND r.signal_date >= q.reported_date"""
_SELECTED = """
SELECT rebalance_no, signal_date, security_id, row_number() OVER (PARTITION BY signal_date ORDER BY pb, security_id) AS rank
FROM fx_panel WHERE close > 500 AND pb < 15 QUALIFY rank <= 5"""
_WEIGHTS = """
SELECT rebalance_no, security_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY rebalance_no) AS weight FROM fx_selected"""
_MEMBERS = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS strategy_id, signal_date AS as_of_date, security_id FROM fx_panel WHERE {c} < {v}"
    for i, c, v in RULES
)
_STRATEGIES = f"""
SELECT strategy_id, {_strategy_json('VARCHAR')} AS criteria_json, f1, o1, v1, f2, v2
FROM (SELECT strategy_id, {_FIRST} AS f1, {_FIRST_OP} AS o1, {_FIRST_VALUE} AS v1, {_SECOND} AS f2, {_SECOND_VALUE} AS v2
      FROM (SELECT c_custkey AS strategy_id, c_custkey % 60 AS k FROM customer) a) b"""


def _bulk_view() -> str:
    one, two, inner, text = _bulk_columns("VARCHAR")
    return f"""
SELECT substr(sha256(criteria_json), 1, 32) AS criteria_key, count(*) AS n_strategies, any_value(f1) AS f1, any_value(o1) AS o1,
  any_value(CAST(concat(CAST(n1 AS VARCHAR), e1) AS DOUBLE)) AS v1, any_value(f2) AS f2, any_value(v2) AS v2, any_value(shape) AS shape,
  any_value(place) AS place, any_value(sort_field) AS sort_field, any_value(lim) AS lim,
  any_value(f1 = 'DebtToEquity' AND CAST(concat(CAST(n1 AS VARCHAR), e1) AS DOUBLE) > 50) AS out_of_range
FROM (SELECT *, {text} FROM (SELECT *, {inner} FROM (SELECT *, {one}, {two} FROM (
  SELECT {', '.join(_BULK_PARTS)} FROM (SELECT c_custkey AS strategy_id, c_custkey AS k FROM customer) a) b) c) d) e
GROUP BY 1"""


_LOCKED = """
SELECT *, coalesce(open = high AND high = low AND low = close AND prev > 0 AND abs((close - prev) / prev) >= 0.019, false)
       AS is_circuit_locked
FROM (SELECT *, lag(close) OVER (PARTITION BY security_id ORDER BY date) AS prev FROM fx_bars) t"""
_LEGS = f"""
SELECT r.rebalance_no, r.signal_date, s.snapshot_id, s.as_of_date,
       (SELECT min(date) FROM fx_bars b WHERE b.date > s.as_of_date) AS execution_date, r.period_end
FROM (SELECT *, coalesce(lead(signal_date) OVER (ORDER BY signal_date), DATE '{END}') AS period_end FROM fx_rebalance) r
ASOF JOIN (SELECT * FROM fx_snapshots WHERE sealed_at IS NOT NULL) s ON r.signal_date >= s.as_of_date"""

X = {
    "fx_latest_bar": _LATEST_BAR, "fx_latest_ratio": _LATEST_RATIO, "fx_base": _BASE, "fx_panel": _PANEL,
    "fx_selected": _SELECTED, "fx_weights": _WEIGHTS, "fx_members": _MEMBERS, "fx_strategies": _STRATEGIES,
    "fx_locked": _LOCKED, "fx_legs": _LEGS,
    "fx_runs": "SELECT s.strategy_id, r.signal_date AS as_of_date, r.rebalance_no FROM fx_rebalance r "
               "CROSS JOIN (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS strategy_id) s",
    "fx_events": """
SELECT coalesce(c.strategy_id, p.strategy_id) AS strategy_id, coalesce(c.security_id, p.security_id) AS security_id,
       CASE WHEN p.security_id IS NULL THEN 'Entered' ELSE 'Exited' END AS event_type, coalesce(c.as_of_date, p.next_date) AS as_of_date
FROM (SELECT m.*, r.rebalance_no FROM fx_members m JOIN fx_runs r USING (strategy_id, as_of_date) WHERE r.rebalance_no > 0) c
FULL OUTER JOIN (SELECT m.*, n.rebalance_no, n.as_of_date AS next_date FROM fx_members m JOIN fx_runs r USING (strategy_id, as_of_date)
                 JOIN fx_runs n ON n.strategy_id = r.strategy_id AND n.rebalance_no = r.rebalance_no + 1) p
ON p.strategy_id = c.strategy_id AND p.security_id = c.security_id AND p.rebalance_no = c.rebalance_no
WHERE p.security_id IS NULL OR c.security_id IS NULL""",
    "fx_bulk": _bulk_view(),
    "fx_sma_panel": """
SELECT security_id, date, CASE WHEN count(*) OVER w >= 50 THEN avg(close) OVER w END AS sma50 FROM fx_bars
WINDOW w AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
    "fx_bulk_base": "SELECT b.*, s.sma50 FROM fx_base b LEFT JOIN fx_sma_panel s ON s.security_id = b.security_id AND s.date = b.price_date",
    "fx_long": " UNION ALL ".join(
        f"SELECT security_id, ticker, exchange, '{f}' AS field, CAST({screen.METRIC_COLUMN[f]} AS DOUBLE) AS v FROM fx_bulk_base"
        for f in ["PeRatio", "PbRatio", "ClosePrice", "Volume", "DebtToEquity", "Sma50", "GrossMargin", "ReturnOnEquity", "PsRatio"]
    ),
    "fx_bulk_hits": """
SELECT c.criteria_key, 'hit' AS kind, '' AS code, a.security_id, row_number() OVER (PARTITION BY c.criteria_key ORDER BY
  CASE WHEN sort_field = '' THEN 0 WHEN sort_field = 'PeRatio' THEN CASE WHEN s.v IS NULL THEN 1 ELSE 0 END ELSE CASE WHEN s.v IS NULL THEN 0 ELSE 1 END END,
  CASE WHEN sort_field = 'PeRatio' THEN -s.v ELSE s.v END NULLS FIRST, CASE WHEN sort_field = '' THEN a.ticker END, a.security_id) AS rank, n_strategies
FROM fx_bulk c JOIN fx_long a ON a.field = c.f1
LEFT JOIN fx_long b ON b.field = c.f2 AND b.security_id = a.security_id AND c.shape <> 'bare'
LEFT JOIN fx_long s ON s.field = c.sort_field AND s.security_id = a.security_id
WHERE c.shape <> 'or' AND (c.shape = 'bare' OR b.v > v2) AND (place = '' OR a.exchange = place) AND NOT out_of_range
  AND CASE o1 WHEN 'LessThan' THEN a.v < v1 WHEN 'LessThanOrEqual' THEN a.v <= v1 WHEN 'GreaterThan' THEN a.v > v1 ELSE a.v >= v1 END
QUALIFY rank <= coalesce(lim, 200)""",
    "fx_bulk_refused": """
SELECT criteria_key, 'refused' AS kind, 'OperatorNotSupportedInV1' AS code, CAST(NULL AS BIGINT) AS security_id, CAST(NULL AS BIGINT) AS rank,
  n_strategies FROM fx_bulk WHERE shape = 'or'
UNION ALL SELECT criteria_key, 'refused', 'ValueOutOfRange', NULL, NULL, n_strategies FROM fx_bulk WHERE out_of_range""",
}


def v(body: str, **more: str) -> str:
    return with_views(body, **X, **more)


def _full_sql() -> str:
    body = (
        f"SELECT s.security_id, s.ticker, s.name, s.exchange, s.sector, s.industry, b.close, b.price_date, "
        f"{rnd('b.adj_close', 4)} AS adj_close, {rnd('r.pb', 4)} AS pb, {rnd('i.sma50', 4)} AS sma50, "
        f"{rnd('i.rsi14', 4)} AS rsi14, {rnd('i.vol30', 4)} AS vol30 "
        f"FROM fx_securities s JOIN (SELECT security_id, date AS price_date, close, adj_close FROM fx_adjusted "
        f"WHERE date <= DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY date DESC) = 1) b "
        f"USING (security_id) JOIN ind i ON i.security_id = b.security_id AND i.date = b.price_date "
        f"JOIN fx_latest_ratio r ON r.security_id = s.security_id WHERE b.close > 0 AND r.pb < 15 "
        f"AND i.wil_rn IS NOT NULL AND i.rsi14 < 60 AND i.vol30 > 0 ORDER BY r.pb, s.security_id LIMIT 200"
    )
    sql = v(body)
    head = sql[len("WITH "):sql.rindex(body)].rstrip()
    return f"WITH RECURSIVE {head},{indicator_ctes('fx_adjusted', 'adj_close')}\n{body}"


ORACLES = {
    "screen_full": _full_sql(),
    "screen_predicate": v("SELECT security_id, close < 2000 AS lessthan, close <= 2000 AS lessthanorequal, "
                          "close > 2000 AS greaterthan, close >= 2000 AS greaterthanorequal, close = 2000 AS equal, close <> 2000 AS notequal FROM fx_base WHERE close > 500"),
    "screen_group_and": v("SELECT security_id, ticker, close FROM fx_base WHERE close > 500 AND pb < 15 AND volume > 5000"),
    "screen_null_semantics": v("SELECT count(*) AS n, count(*) FILTER (pe < 20) AS below, "
                               "count(*) FILTER (pe >= 20) AS at_or_above, count(*) FILTER (pe IS NULL) AS unknown FROM fx_base"),
    "screen_universe": v("SELECT security_id, ticker, close FROM fx_base WHERE exchange = 'ASIA' "
                         "OR (exchange = 'EUROPE' AND sector = 'NATION_3')"),
    "screen_projection": v("SELECT security_id, ticker, name, exchange, sector, industry, close, close AS adj_close, price_date FROM fx_base"),
    "screen_survivorship": v("SELECT security_id, price_date, close FROM fx_base WHERE price_date < DATE '2000-07-01'"),
    "asof_latest_bar": v("SELECT security_id, price_date AS date, open, high, low, close, volume FROM fx_latest_bar"),
    "asof_latest_ratio": v(f"SELECT security_id, reported_date, {rounded('pe', 'pb', 'roe')} FROM fx_latest_ratio"),
    "join_indicator_same_day": v(
        f"SELECT b.security_id, b.price_date, b.close, {rnd('s.a', 4)} AS sma50 FROM fx_latest_bar b LEFT JOIN ("
        "SELECT security_id, date, CASE WHEN row_number() OVER (PARTITION BY security_id ORDER BY date) >= 50 THEN "
        "avg(close) OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS a "
        "FROM fx_bars) s ON s.security_id = b.security_id AND s.date = b.price_date"),
    "bitemporal_read": v(
        f"SELECT security_id, fiscal_period_end, reported_date, revenue, net_income, valid_from FROM fx_fundamentals_scd2 "
        f"WHERE valid_from <= DATE '{AS_OF}' AND DATE '{AS_OF}' < valid_to AND reported_date <= DATE '{AS_OF}' "
        "QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY fiscal_period_end DESC, valid_from DESC) = 1"),
    "next_trading_date": v(
        "SELECT o.order_date, (SELECT min(date) FROM fx_days b WHERE b.date > o.order_date) AS next_date "
        "FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS order_date FROM orders) o",
        fx_days="SELECT DISTINCT date FROM fx_bars"),
    "circuit_lock_flag": v("SELECT security_id, date, is_circuit_locked FROM fx_locked"),
    "bt_execution_dates": v(f"SELECT * FROM fx_legs WHERE execution_date <= DATE '{END}'"),
    "first_fillable_bar": v(
        "SELECT rebalance_no, security_id, min(date) AS fill_date, min_by(close, date) AS fill_price FROM ("
        "SELECT l.rebalance_no, b.* FROM fx_legs l JOIN fx_locked b ON b.date BETWEEN l.execution_date AND l.period_end "
        "QUALIFY row_number() OVER (PARTITION BY l.rebalance_no, b.security_id ORDER BY b.date) <= 5) t "
        "WHERE NOT is_circuit_locked GROUP BY 1, 2"),
    "semi_holdings": v("SELECT security_id, date, close FROM fx_bars WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' "
                       "AND security_id IN (SELECT security_id FROM fx_securities WHERE exchange = 'ASIA')"),
    "screen_panel": v(f"SELECT signal_date, security_id, close, volume, price_date, {rnd('pb')} AS pb FROM fx_panel WHERE close > 500 AND pb < 15"),
    "max_positions": v("SELECT signal_date, security_id, rank FROM fx_selected"),
    "equal_weight": v("SELECT * FROM fx_weights"),
    "trade_list_diff": v(
        "SELECT rebalance_no, security_id, current_weight, target_weight, delta, abs(delta) * 100000 AS notional FROM ("
        "SELECT coalesce(c.rebalance_no, t.rebalance_no) AS rebalance_no, coalesce(c.security_id, t.security_id) AS security_id, "
        "coalesce(c.weight, 0) AS current_weight, coalesce(t.weight, 0) AS target_weight, "
        "coalesce(t.weight, 0) - coalesce(c.weight, 0) AS delta "
        "FROM (SELECT rebalance_no + 1 AS rebalance_no, security_id, weight FROM fx_weights) c "
        "FULL OUTER JOIN fx_weights t ON c.rebalance_no = t.rebalance_no AND c.security_id = t.security_id) x "
        "WHERE abs(delta) >= 0.0001"),
    "keys_union": v("SELECT rebalance_no, security_id FROM fx_selected UNION SELECT rebalance_no + 1, security_id FROM fx_selected"),
    "trading_calendar": v("SELECT DISTINCT date FROM fx_bars WHERE security_id IN (SELECT security_id FROM fx_selected)"),
    "screen_sort_limit": v(f"SELECT security_id, ticker, {rnd('pe')} AS pe FROM fx_base WHERE close > 0 ORDER BY fx_base.pe ASC NULLS FIRST, security_id LIMIT 40"),
    "screen_default_sort": v("SELECT security_id, ticker, close FROM fx_base WHERE close > 0 ORDER BY ticker, security_id LIMIT 200"),
    "top1_per_key": v("SELECT security_id, close, date FROM fx_bars QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY close DESC, date) = 1"),
    "fetch_priority": v(
        "SELECT security_id, ticker, CAST(CASE WHEN security_id IN (SELECT security_id FROM fx_fundamentals_v1 WHERE revenue > 750000) "
        "THEN 1 ELSE 0 END AS INT) AS was_fetched FROM fx_securities ORDER BY 3, 2 LIMIT 30"),
    "screen_bulk": v("SELECT * FROM fx_bulk_hits UNION ALL SELECT * FROM fx_bulk_refused"),
    "alert_diff": v("SELECT strategy_id, security_id, event_type FROM fx_events WHERE as_of_date = DATE '2000-10-02'"),
    "alert_diff_history": v("SELECT * FROM fx_events"),
    "alerts_latest_n": v("SELECT * FROM fx_events WHERE strategy_id = 1 ORDER BY as_of_date DESC, security_id, event_type LIMIT 100"),
    "content_key": v("SELECT strategy_id, concat(substr(sha256(criteria_json), 1, 32), ':', CAST(strategy_id % 7 AS VARCHAR)) AS content_key FROM fx_strategies"),
}
