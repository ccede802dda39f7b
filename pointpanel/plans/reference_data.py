"""Registered queries: identity, calendars, scalar functions, aggregates and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointpanel.fixtures import Fixtures
from pointpanel.functions import corporate, dates
from pointpanel.functions.rounding import half_even, half_up
from pointpanel.functions.text import concept_key, prompt_key
from pointpanel.operators import actions as act
from pointpanel.operators import backtest, calendar, identity, quality
from pointpanel.operators.asof import latest_as_of
from pointpanel.plans import screens
from pointpanel.plans.oracle_views import rnd, with_views
from pointpanel.session import stored

D = "2000-03-01"


def _date(text):
    return F.lit(text).cast("date")


# --- identity --------------------------------------------------------------------------------------------------------


def q_equity_series_filter(spark, sf):
    li = Fixtures(spark, sf).table("lineitem")
    series = F.when(F.col("l_returnflag") == "A", " eq ").when(F.col("l_returnflag") == "N", "BE").otherwise("GB")
    return (
        li.withColumn("series", series).filter(identity.is_equity(F.col("series")))
        .groupBy(F.upper(F.trim("series")).alias("series"), F.col("l_suppkey").alias("security_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def q_symbol_isin_learn(spark, sf):
    return identity.learn_isins(Fixtures(spark, sf).symbols)


def resolved(fx: Fixtures) -> DataFrame:
    return identity.resolve_identity(fx.symbols, identity.learn_isins(fx.symbols))


def q_identity_resolve(spark, sf):
    return resolved(Fixtures(spark, sf)).select("security_id", "date", "symbol", "provider_id")


def known_securities(fx: Fixtures) -> DataFrame:
    """A securities table with real ids, placeholders, inactive rows and gaps."""
    sid = F.col("s_suppkey")
    return fx.table("supplier").filter(sid % 4 != 2).select(
        F.concat(F.when(sid % 4 == 1, "NSE:S").otherwise("INE"), sid.cast("string")).alias("provider_id"),
        F.concat(F.lit("S"), sid.cast("string")).alias("ticker"),
        F.col("s_name").alias("name"), F.lit("NSE").alias("exchange"), (sid % 10 != 3).alias("is_active"),
    )


def _reused(text: str) -> tuple[str, str]:
    """Symbols and identifiers with takeovers: every fifth company leaves its symbol, and a year later its neighbour takes it."""
    s = f"CAST({{}} AS {text})"
    taken = "security_id % 5 = 1 AND date >= DATE '2000-01-01'"
    symbol = (f"CASE WHEN security_id % 5 = 0 AND date >= DATE '1999-01-01' THEN concat('N', {s.format('security_id')}) "
              f"WHEN {taken} THEN concat('S', {s.format('security_id - 1')}) ELSE concat('S', {s.format('security_id')}) END AS symbol")
    isin = (f"CASE WHEN date < DATE '1998-01-01' OR ({taken} AND day(date) <= 15) THEN concat('INE', {s.format('security_id')}) ELSE '' END AS isin")
    return symbol, isin


def q_security_reconcile(spark, sf):
    """Securities and TickerChange rows after all daily files, with symbols that other companies take over and delistings that end."""
    fx = Fixtures(spark, sf)
    rows = stored(fx.bars.selectExpr("date", *_reused("STRING")), "symbols")
    intervals = stored(identity.symbol_intervals(rows), "intervals")
    resolved = stored(identity.resolve_over_time(rows, intervals).select("provider_id", "symbol", "date"), "resolved")
    k = F.substring_index("ticker", "S", -1).cast("int")
    gone = ~F.col("is_active")
    known = known_securities(fx).withColumns({
        "delisted_date": F.when(gone, F.when(k % 20 == 3, _date("1997-06-30")).otherwise(_date("2000-06-30"))),
        "delisting_reason": F.when(gone, F.lit("Unknown"))})
    securities = identity.reconcile_securities(known, resolved, intervals)
    actions = identity.ticker_change_rows(identity.ticker_history(resolved))
    return securities.withColumn("kind", F.lit("security")).unionByName(
        actions.withColumn("kind", F.lit("action")), allowMissingColumns=True)


def q_ticker_change_events(spark, sf):
    return identity.ticker_changes(Fixtures(spark, sf).symbols)


def q_synthetic_id_upgrade(spark, sf):
    fx = Fixtures(spark, sf)
    return identity.upgrade_synthetic_ids(known_securities(fx), identity.learn_isins(fx.symbols)).select(
        "ticker", "provider_id"
    )


def detected(fx: Fixtures) -> DataFrame:
    return identity.detect_delistings(fx.securities, fx.bars)


def q_delisting_detect(spark, sf):
    return detected(Fixtures(spark, sf)).select("security_id", "is_active", "delisted_date", "delisting_reason")


def q_active_count(spark, sf):
    return detected(Fixtures(spark, sf)).agg(
        F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive")
    )


# --- aggregates ------------------------------------------------------------------------------------------------------


def q_agg_last_date(spark, sf):
    return Fixtures(spark, sf).bars.groupBy("security_id").agg(F.max("date").alias("last_date"))


def q_agg_bars_per_day(spark, sf):
    return Fixtures(spark, sf).bars.groupBy("date").agg(F.count(F.lit(1)).alias("n_bars"))


def q_distinct_benchmarks(spark, sf):
    """Benchmarks per exchange: the distinct tickers an index table of the market would offer."""
    fx = Fixtures(spark, sf)
    index = fx.bars.join(fx.securities.select("security_id", "exchange"), "security_id")
    return index.select(F.col("exchange").alias("ticker")).union(fx.benchmark.select("ticker")).distinct().orderBy("ticker")


def q_portfolio_value(spark, sf):
    """Each customer's bought quantities at the last close, plus the account balance as cash, and the weights."""
    fx = Fixtures(spark, sf)
    lots = (
        fx.table("lineitem").join(fx.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("portfolio_id"), F.col("l_suppkey").alias("security_id"))
        .agg(F.sum("l_quantity").alias("shares"))
    )
    marks = latest_as_of(fx.bars, screens.AS_OF, ["close"], date_alias="price_date")
    worth = lots.join(marks, "security_id").select(
        "portfolio_id", "security_id", (F.col("shares") * F.col("close")).alias("value")
    )
    # totals are an aggregate joined back, not a window: no task holds a whole portfolio
    total = worth.groupBy("portfolio_id").agg(F.sum("value").alias("invested")).join(
        fx.table("customer").select(F.col("c_custkey").alias("portfolio_id"), F.col("c_acctbal").alias("cash")), "portfolio_id"
    )
    return worth.join(total, "portfolio_id").select(
        "portfolio_id", "security_id", half_up("value", 2).alias("value"),
        half_up(F.col("invested") + F.col("cash"), 2).alias("total"),
        half_up(F.col("value") / (F.col("invested") + F.col("cash")), 6).alias("weight"),
    )


def q_latest_per_group(spark, sf):
    """The latest order of each customer, ties by order key."""
    o = Fixtures(spark, sf).table("orders")
    when = F.struct("o_orderdate", "o_orderkey")
    return o.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.max_by("o_orderkey", when).alias("order_id"), F.to_date(F.max("o_orderdate")).alias("order_date")
    )


# --- scalars ---------------------------------------------------------------------------------------------------------


def _actions(spark, sf, **cols):
    df = Fixtures(spark, sf).actions
    return df.select("security_id", "effective_date", "action_type", *[c.alias(n) for n, c in cols.items()])


def q_parse_bonus_ratio(spark, sf):
    return _actions(spark, sf, factor=corporate.bonus_from_remark(F.col("raw_description")))


def q_parse_split_face(spark, sf):
    return _actions(spark, sf, factor=corporate.split_from_remark(F.col("raw_description")))


def q_parse_rights_terms(spark, sf):
    return _actions(spark, sf, **corporate.rights_terms(F.col("raw_description")))


def q_factor_split(spark, sf):
    """Old over new share count, here line number over quantity of every trade."""
    li = Fixtures(spark, sf).table("lineitem")
    f = corporate.split_factor(F.col("l_linenumber").cast("double"), F.col("l_quantity"))
    return li.groupBy(F.col("l_suppkey").alias("security_id")).agg(
        half_up(F.min(f), 6).alias("lowest"), half_up(F.max(f), 6).alias("highest"), F.count(f).alias("n")
    )


def q_factor_bonus(spark, sf):
    li = Fixtures(spark, sf).table("lineitem")
    f = corporate.bonus_factor(F.col("l_linenumber").cast("double"), F.col("l_quantity") - 5)
    return li.groupBy(F.col("l_suppkey").alias("security_id")).agg(
        half_up(F.min(f), 6).alias("lowest"), half_up(F.max(f), 6).alias("highest"), F.count(f).alias("n")
    )


def q_factor_rights(spark, sf):
    fx = Fixtures(spark, sf)
    rows = act.resolve_factors(fx.actions.filter(F.col("action_type") == "Rights"), fx.bars)
    return rows.select("security_id", "effective_date", half_up("factor", 6).alias("factor"))


def q_factor_dividend(spark, sf):
    fx = Fixtures(spark, sf)
    rows = act.with_cum_close(fx.actions.filter(F.col("action_type") == "Dividend"), fx.bars)
    f = corporate.dividend_factor(F.col("cum_close"), F.col("dividend_amount"))
    return rows.select("security_id", "effective_date", half_up(f, 6).alias("factor"))


def q_reported_date_estimate(spark, sf):
    rows = Fixtures(spark, sf).fundamentals_v2
    annual = F.col("security_id") % 2 == 0
    return rows.select(
        "security_id", "fiscal_period_end", annual.alias("is_annual"),
        dates.estimated_report_date(F.col("fiscal_period_end"), annual).alias("reported_date"),
    )


def q_parse_date_multi(spark, sf):
    fx = Fixtures(spark, sf)
    formats = [*dates.DATE_FORMATS, None]
    text = F.lit(None).cast("string")
    for i, f in enumerate(formats):
        hit = (F.col("security_id") + F.dayofmonth("date")) % 7 == i
        text = F.when(hit, F.date_format("date", f) if f else F.lit("31-31-31")).otherwise(text)
    rows = fx.bars.select("security_id", "date", text.alias("text"))
    return rows.select("security_id", "date", dates.parse_date(F.col("text")).alias("parsed"))


def q_normalise_concept(spark, sf):
    return Fixtures(spark, sf).table("documents").select("doc_id", F.md5(concept_key(F.col("text"))).alias("key_md5"))


def q_normalise_prompt(spark, sf):
    return Fixtures(spark, sf).table("conversations").select(
        "conv_id", "turn", F.md5(prompt_key(F.concat(F.lit("  \t"), F.col("text"), F.lit("\n ")))).alias("key_md5")
    )


def q_transaction_cost(spark, sf):
    return Fixtures(spark, sf).table("orders").select(
        "o_orderkey", backtest.transaction_cost(F.col("o_totalprice")).alias("cost")
    )


def q_rebalance_dates(spark, sf):
    """Every security's own schedule: from the month end of its first bar to its last bar."""
    spans = Fixtures(spark, sf).bars.groupBy("security_id").agg(
        F.last_day(F.min("date")).alias("start"), F.max("date").alias("end")
    )
    months = F.element_at(F.array(F.lit(1), F.lit(3), F.lit(12)), (F.col("security_id") % 3 + 1).cast("int"))
    return spans.select(
        "security_id", F.posexplode(dates.rebalance_dates(F.col("start"), F.col("end"), months)).alias("no", "signal_date")
    ).select("security_id", F.col("no").cast("long").alias("no"), "signal_date")


def q_weekday_filter(spark, sf):
    return Fixtures(spark, sf).bars.filter(dates.is_weekday(F.col("date"))).groupBy("security_id").agg(
        F.count(F.lit(1)).alias("n")
    )


def q_rounding(spark, sf):
    """Half to even at four places: quarters of a basis point end in exact ties."""
    li = Fixtures(spark, sf).table("lineitem")
    x = (F.col("l_linenumber") + F.col("l_quantity")) / 32.0
    return li.select(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), half_even(x, 4).alias("rounded"))


# --- guards ----------------------------------------------------------------------------------------------------------


def q_dq_unsealed(spark, sf):
    fx = Fixtures(spark, sf)
    reads = fx.orders_dates.join(
        F.broadcast(fx.snapshots.select("snapshot_id", F.col("as_of_date").alias("order_date"))), "order_date"
    )
    return quality.unsealed_reads(reads, fx.snapshots)


def q_dq_after_asof(spark, sf):
    """A read by calendar month instead of by date looks ahead within its month."""
    fx = Fixtures(spark, sf)
    d = _date("2001-01-15")
    rows = fx.bars.filter(F.trunc("date", "MM") == F.trunc(d, "MM")).withColumn("as_of", d)
    return quality.after_as_of(rows, "date", "as_of").select("security_id", "date", "as_of")


def q_dq_reported_late(spark, sf):
    """A read by fiscal period sees filings nobody had yet."""
    rows = Fixtures(spark, sf).fundamentals_v2.withColumn("as_of", F.date_add("fiscal_period_end", 30))
    return quality.after_as_of(rows, "reported_date", "as_of").select("security_id", "fiscal_period_end", "reported_date")


def q_dq_exec_not_after_signal(spark, sf):
    """Execution at the signal's own close, on the legs whose signal day traded."""
    fx = Fixtures(spark, sf)
    days = calendar.trading_days(fx.bars).select(F.col("date").alias("executed"))
    naive = fx.rebalance.join(F.broadcast(days), F.col("executed") == F.col("signal_date"))
    right = screens.legs(fx).select("rebalance_no", F.col("as_of_date").alias("signal_date"), F.col("execution_date").alias("executed"))
    both = naive.select("rebalance_no", "signal_date", "executed").unionByName(right)
    return quality.executed_too_early(both, "executed", "signal_date")


def q_dq_survivorship(spark, sf):
    """The screen's own universe on the date; nothing may be missing from it."""
    fx = Fixtures(spark, sf)
    universe = fx.bars.filter(F.col("date") <= _date(D)).select("security_id").distinct()
    return quality.missing_from_universe(universe, detected(fx), fx.bars, D).select("security_id", "delisted_date")


def q_universe_survivorship_check(spark, sf):
    """A universe of today's active securities, checked for the past: it misses those delisted since."""
    fx = Fixtures(spark, sf)
    known = detected(fx)
    return quality.missing_from_universe(known.filter("is_active"), known, fx.bars, D).select("security_id", "delisted_date")


def q_dq_locked_fill(spark, sf):
    """Fills taken at the first bar whatever its state, checked against the locks."""
    fx = Fixtures(spark, sf)
    bars = identity.with_lock_flag(fx.bars)
    naive = calendar.first_fillable(bars.withColumn("is_circuit_locked", F.lit(False)), screens.legs(fx))
    return quality.locked_fills(naive, bars).select("rebalance_no", "security_id", "fill_date")


RETAIN_FROM = "2001-01-01"


def _retained(fx: Fixtures):
    sound = fx.fundamentals_v1.filter(F.col("shareholders_equity") > 400000)
    return quality.retained(fx.bars, RETAIN_FROM), sound, quality.retained(fx.actions, "2000-10-01", "effective_date")


def q_retention_purge(spark, sf):
    fx = Fixtures(spark, sf)
    bars, sound, actions = _retained(fx)
    gone = quality.orphans(fx.securities, bars, sound, actions).select("security_id", F.lit("security").alias("kind"), F.lit(1).cast("long").alias("n"))
    kept = bars.groupBy("security_id").agg(F.lit("bars").alias("kind"), F.count(F.lit(1)).alias("n"))
    return gone.unionByName(kept)


def q_anti_orphans(spark, sf):
    fx = Fixtures(spark, sf)
    return quality.orphans(fx.securities, *_retained(fx)).select("security_id", "ticker")


QUERIES = {
    "equity_series_filter": q_equity_series_filter, "symbol_isin_learn": q_symbol_isin_learn,
    "identity_resolve": q_identity_resolve, "security_reconcile": q_security_reconcile,
    "ticker_change_events": q_ticker_change_events, "synthetic_id_upgrade": q_synthetic_id_upgrade,
    "delisting_detect": q_delisting_detect, "active_count": q_active_count, "agg_last_date": q_agg_last_date,
    "agg_bars_per_day": q_agg_bars_per_day, "distinct_benchmarks": q_distinct_benchmarks,
    "portfolio_value": q_portfolio_value, "latest_per_group": q_latest_per_group,
    "parse_bonus_ratio": q_parse_bonus_ratio, "parse_split_face": q_parse_split_face,
    "parse_rights_terms": q_parse_rights_terms, "factor_split": q_factor_split, "factor_bonus": q_factor_bonus,
    "factor_rights": q_factor_rights, "factor_dividend": q_factor_dividend,
    "reported_date_estimate": q_reported_date_estimate, "parse_date_multi": q_parse_date_multi,
    "normalise_concept": q_normalise_concept, "normalise_prompt": q_normalise_prompt,
    "transaction_cost": q_transaction_cost, "rebalance_dates": q_rebalance_dates, "weekday_filter": q_weekday_filter,
    "rounding": q_rounding, "dq_unsealed": q_dq_unsealed, "dq_after_asof": q_dq_after_asof,
    "dq_reported_late": q_dq_reported_late, "dq_exec_not_after_signal": q_dq_exec_not_after_signal,
    "dq_survivorship": q_dq_survivorship, "universe_survivorship_check": q_universe_survivorship_check,
    "dq_locked_fill": q_dq_locked_fill, "retention_purge": q_retention_purge, "anti_orphans": q_anti_orphans,
}

_LEARN = "SELECT symbol, max_by(isin, date) AS learned_isin FROM fx_symbols WHERE isin <> '' GROUP BY 1"
_KNOWN = """
SELECT concat(CASE WHEN s_suppkey % 4 = 1 THEN 'NSE:S' ELSE 'INE' END, CAST(s_suppkey AS VARCHAR)) AS provider_id,
       concat('S', CAST(s_suppkey AS VARCHAR)) AS ticker, s_name AS name, 'NSE' AS exchange, s_suppkey % 10 <> 3 AS is_active
FROM supplier WHERE s_suppkey % 4 <> 2"""
_DETECTED = """
SELECT s.*  EXCLUDE (is_active), NOT coalesce(l.d < m.d - 60, false) AS is_active, CASE WHEN l.d < m.d - 60 THEN l.d END AS delisted_date,
       CASE WHEN l.d < m.d - 60 THEN 'Unknown' END AS delisting_reason
FROM fx_securities s LEFT JOIN (SELECT security_id, max(date) AS d FROM fx_bars GROUP BY 1) l USING (security_id)
CROSS JOIN (SELECT max(date) AS d FROM fx_bars) m"""
_TRADEABLE = f"""
SELECT security_id, is_active, delisted_date FROM fx_detected WHERE (is_active OR delisted_date > DATE '{D}')
AND security_id IN (SELECT security_id FROM fx_bars WHERE date <= DATE '{D}')"""
X = {
    **screens.X, "fx_learned": _LEARN, "fx_known": _KNOWN,
    "fx_detected": _DETECTED, "fx_tradeable": _TRADEABLE,
    "fx_orphan": f"""
SELECT security_id, ticker FROM fx_securities s WHERE NOT EXISTS (SELECT 1 FROM fx_bars b WHERE b.security_id = s.security_id AND b.date >= DATE '{RETAIN_FROM}')
AND NOT EXISTS (SELECT 1 FROM fx_fundamentals_v1 f WHERE f.security_id = s.security_id AND f.shareholders_equity > 400000)
AND NOT EXISTS (SELECT 1 FROM fx_actions a WHERE a.security_id = s.security_id AND a.effective_date >= DATE '2000-10-01')""",
}


def v(body: str, **more: str) -> str:
    return with_views(body, **X, **more)


_A = "SELECT security_id, effective_date, action_type, "
_RA = "TRY_CAST(regexp_extract(raw_description, 'ratio of ([0-9]+) ?: ?([0-9]+)', 1) AS DOUBLE)"
_RB = "TRY_CAST(regexp_extract(raw_description, 'ratio of ([0-9]+) ?: ?([0-9]+)', 2) AS DOUBLE)"

ORACLES = {
    "equity_series_filter": "SELECT CASE l_returnflag WHEN 'A' THEN 'EQ' ELSE 'BE' END AS series, l_suppkey AS security_id, count(*) AS n "
                            "FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2",
    "symbol_isin_learn": v("SELECT * FROM fx_learned"),
    "identity_resolve": v("SELECT s.security_id, s.date, s.symbol, coalesce(nullif(s.isin, ''), l.learned_isin, 'NSE:' || s.symbol) AS provider_id "
                          "FROM fx_symbols s LEFT JOIN fx_learned l USING (symbol)"),
    "security_reconcile": v(
        "SELECT 'security' AS kind, provider_id, ticker, name, exchange, is_active, delisted_date, delisting_reason, change, CAST(NULL AS DATE) AS effective_date, "
        "CAST(NULL AS VARCHAR) AS action_type, CAST(NULL AS VARCHAR) AS new_ticker, CAST(NULL AS VARCHAR) AS raw_description FROM ("
        "SELECT CASE WHEN s.id IS NULL THEN k.provider_id ELSE s.id END AS provider_id, coalesce(s.symbol, k.ticker) AS ticker, coalesce(k.name, s.symbol) AS name, "
        "coalesce(k.exchange, 'NSE') AS exchange, k.id IS NULL OR k.is_active OR (s.id IS NOT NULL AND s.last > k.delisted_date) AS is_active, "
        "CASE WHEN s.id IS NULL OR k.is_active OR s.last <= k.delisted_date THEN k.delisted_date END AS delisted_date, "
        "CASE WHEN s.id IS NULL OR k.is_active OR s.last <= k.delisted_date THEN k.delisting_reason END AS delisting_reason, "
        "CASE WHEN k.id IS NULL THEN 'inserted' WHEN s.id IS NULL THEN 'untouched' WHEN NOT k.is_active AND s.last > k.delisted_date THEN 'reactivated' "
        "WHEN s.symbol <> k.ticker THEN 'renamed' WHEN k.provider_id LIKE 'NSE:%' AND k.id <> k.provider_id THEN 'identified' ELSE 'seen' END AS change "
        "FROM fx_known_ids k FULL OUTER JOIN (SELECT provider_id AS id, max_by(symbol, date) AS symbol, max(date) AS last FROM fx_over_time GROUP BY 1) s ON s.id = k.id) t "
        "UNION ALL SELECT 'action', provider_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, date, 'TickerChange', symbol, concat('Symbol changed from ', p, ' to ', symbol) FROM ("
        "SELECT *, lag(symbol) OVER (PARTITION BY provider_id ORDER BY date) AS p FROM (SELECT provider_id, date, max(symbol) AS symbol FROM fx_over_time GROUP BY 1, 2) d) e "
        "WHERE p <> symbol",
        fx_reused=f"SELECT date, {', '.join(_reused('VARCHAR'))} FROM fx_bars",
        fx_held="SELECT symbol, isin, date FROM (SELECT *, lag(isin) OVER (PARTITION BY symbol ORDER BY date) AS p FROM ("
                "SELECT symbol, date, max(isin) AS isin FROM fx_reused WHERE isin <> '' GROUP BY 1, 2) a) b WHERE p IS NULL OR p <> isin",
        fx_over_time="SELECT r.symbol, r.date, coalesce(nullif(r.isin, ''), h.isin, f.isin, concat('NSE:', r.symbol)) AS provider_id FROM fx_reused r "
                     "ASOF LEFT JOIN fx_held h ON h.symbol = r.symbol AND r.date >= h.date LEFT JOIN (SELECT symbol, min_by(isin, date) AS isin FROM fx_held GROUP BY 1) f ON f.symbol = r.symbol",
        fx_known_ids="SELECT k.*, CASE WHEN k.provider_id LIKE 'NSE:%' THEN coalesce(f.isin, k.provider_id) ELSE k.provider_id END AS id, "
                     "CASE WHEN NOT is_active THEN CASE WHEN CAST(substr(ticker, 2) AS INT) % 20 = 3 THEN DATE '1997-06-30' ELSE DATE '2000-06-30' END END AS delisted_date, "
                     "CASE WHEN NOT is_active THEN 'Unknown' END AS delisting_reason "
                     "FROM fx_known k LEFT JOIN (SELECT symbol, min_by(isin, date) AS isin FROM fx_held GROUP BY 1) f ON f.symbol = k.ticker"),
    "ticker_change_events": v(
        "SELECT security_id, date AS effective_date, 'TickerChange' AS action_type, symbol AS new_ticker, "
        "concat('Symbol changed from ', p, ' to ', symbol) AS raw_description FROM (SELECT *, lag(symbol) OVER (PARTITION BY security_id ORDER BY date) AS p "
        "FROM fx_symbols) t WHERE p <> symbol"),
    "synthetic_id_upgrade": v(
        "SELECT k.ticker, CASE WHEN k.provider_id LIKE 'NSE:%' AND l.learned_isin IS NOT NULL THEN l.learned_isin ELSE k.provider_id END AS provider_id "
        "FROM fx_known k LEFT JOIN fx_learned l ON l.symbol = k.ticker"),
    "delisting_detect": v("SELECT security_id, is_active, delisted_date, delisting_reason FROM fx_detected"),
    "active_count": v("SELECT count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS inactive FROM fx_detected"),
    "agg_last_date": v("SELECT security_id, max(date) AS last_date FROM fx_bars GROUP BY 1"),
    "agg_bars_per_day": v("SELECT date, count(*) AS n_bars FROM fx_bars GROUP BY 1"),
    "distinct_benchmarks": v("SELECT DISTINCT exchange AS ticker FROM fx_securities JOIN fx_bars USING (security_id) UNION SELECT ticker FROM fx_benchmark"),
    "portfolio_value": v(
        f"SELECT portfolio_id, security_id, {rnd('value', 2)} AS value, {rnd('total', 2)} AS total, {rnd('value / total')} AS weight FROM ("
        "SELECT w.*, sum(value) OVER (PARTITION BY portfolio_id) + c_acctbal AS total FROM (SELECT o_custkey AS portfolio_id, l_suppkey AS security_id, "
        "sum(l_quantity) * any_value(b.close) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN fx_latest_bar b ON b.security_id = l_suppkey "
        "GROUP BY 1, 2) w JOIN customer ON c_custkey = portfolio_id) t"),
    "latest_per_group": "SELECT o_custkey AS customer_id, o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date FROM orders "
                        "QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "parse_bonus_ratio": v(f"{_A} {_RB} / ({_RA} + {_RB}) AS factor FROM fx_actions"),
    "parse_split_face": v(f"{_A} CASE WHEN action_type = 'Split' THEN (1 + security_id % 5) / 10::DOUBLE END AS factor FROM fx_actions"),
    "parse_rights_terms": v(
        f"{_A} {_RA} AS offered, {_RB} AS held, CASE action_type WHEN 'Rights' THEN 310 + security_id % 7 END::DOUBLE AS subscription "
        "FROM fx_actions"),
    "factor_split": f"SELECT l_suppkey AS security_id, {rnd('min(l_linenumber / l_quantity)')} AS lowest, {rnd('max(l_linenumber / l_quantity)')} AS highest, "
                    "count(*) AS n FROM lineitem GROUP BY 1",
    "factor_bonus": f"SELECT l_suppkey AS security_id, {rnd('min(f)')} AS lowest, {rnd('max(f)')} AS highest, count(f) AS n FROM (SELECT l_suppkey, "
                    "CASE WHEN l_quantity > 5 AND l_linenumber > 0 THEN (l_quantity - 5) / (l_linenumber + l_quantity - 5) END AS f FROM lineitem) t GROUP BY 1",
    "factor_rights": v(f"SELECT security_id, effective_date, {rnd('factor')} AS factor FROM fx_factors WHERE action_type = 'Rights'"),
    "factor_dividend": v(
        f"SELECT security_id, effective_date, CASE WHEN dividend_amount < cum_close THEN {rnd('(cum_close - dividend_amount) / cum_close')} END AS factor "
        "FROM fx_factors WHERE action_type = 'Dividend'"),
    "reported_date_estimate": v("SELECT security_id, fiscal_period_end, security_id % 2 = 0 AS is_annual, fiscal_period_end + "
                                "CASE WHEN security_id % 2 = 0 THEN 60 ELSE 45 END AS reported_date FROM fx_fundamentals_v2"),
    "parse_date_multi": v("SELECT security_id, date, CASE WHEN (security_id + day(date)) % 7 <> 6 THEN date END AS parsed FROM fx_bars"),
    "normalise_concept": "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]+', '_', 'g'), '_')) AS key_md5 FROM documents",
    "normalise_prompt": "SELECT conv_id, turn, md5(lower(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'))) AS key_md5 FROM conversations",
    "transaction_cost": "SELECT o_orderkey, o_totalprice * 28.0::DOUBLE / 10000.0::DOUBLE AS cost FROM orders",
    "rebalance_dates": "WITH RECURSIVE " + v("SELECT 1 FROM fx_bars")[5:].rsplit("SELECT 1 FROM fx_bars", 1)[0].rstrip() + """,
sp AS (SELECT security_id, last_day(min(date)) AS s, max(date) AS e, CASE security_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 12 END AS m FROM fx_bars GROUP BY 1),
ch AS (SELECT security_id, 0::BIGINT AS no, s AS signal_date, e, m FROM sp WHERE s <= e
       UNION ALL SELECT security_id, no + 1, CAST(signal_date + to_months(m) AS DATE), e, m FROM ch WHERE CAST(signal_date + to_months(m) AS DATE) <= e)
SELECT security_id, no, signal_date FROM ch""",
    "weekday_filter": v("SELECT security_id, count(*) AS n FROM fx_bars WHERE isodow(date) < 6 GROUP BY 1"),
    "rounding": "SELECT l_orderkey, l_linenumber, l_partkey, round_even((l_linenumber + l_quantity) / 32, 4) AS rounded FROM lineitem",
    "dq_unsealed": v("SELECT DISTINCT CAST(o_orderdate AS DATE) AS order_date, snapshot_id FROM orders JOIN fx_snapshots ON as_of_date = CAST(o_orderdate AS DATE) "
                     "WHERE sealed_at IS NULL"),
    "dq_after_asof": v("SELECT security_id, date, DATE '2001-01-15' AS as_of FROM fx_bars WHERE date > DATE '2001-01-15' AND date < DATE '2001-02-01'"),
    "dq_reported_late": v("SELECT security_id, fiscal_period_end, reported_date FROM fx_fundamentals_v2 WHERE reported_date > fiscal_period_end + 30"),
    "dq_exec_not_after_signal": v("SELECT rebalance_no, signal_date, signal_date AS executed FROM fx_rebalance WHERE signal_date IN (SELECT date FROM fx_bars)"),
    "dq_survivorship": v(f"SELECT security_id, delisted_date FROM fx_tradeable WHERE security_id NOT IN (SELECT security_id FROM fx_bars WHERE date <= DATE '{D}')"),
    "universe_survivorship_check": v("SELECT security_id, delisted_date FROM fx_tradeable WHERE NOT is_active"),
    "dq_locked_fill": v(
        "SELECT rebalance_no, security_id, date AS fill_date FROM (SELECT l.rebalance_no, b.* FROM fx_legs l JOIN fx_locked b "
        "ON b.date BETWEEN l.execution_date AND l.period_end QUALIFY row_number() OVER (PARTITION BY l.rebalance_no, b.security_id ORDER BY b.date) = 1) t "
        "WHERE is_circuit_locked"),
    "retention_purge": v(f"SELECT security_id, 'security' AS kind, 1::BIGINT AS n FROM fx_orphan UNION ALL "
                         f"SELECT security_id, 'bars', count(*) FROM fx_bars WHERE date >= DATE '{RETAIN_FROM}' GROUP BY 1"),
    "anti_orphans": v("SELECT * FROM fx_orphan"),
}
