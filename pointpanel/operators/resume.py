"""Indicators that continue from a stored state, one row per security, instead of the whole history.

The state holds the averages as they stand, running sums and the last 200 closes and 30 returns. A fold over the new bars, in their order,
moves it on and gives their indicator rows. The fold from the empty state is the whole derivation, so a rebuild and a nightly load are one
piece of code. A new factor changes every earlier adjusted close, and with raw highs and lows the true ranges by other amounts than its own;
such a security starts from the empty state again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointpanel.operators.series import TRADING_DAYS

LONG, RETURNS = 200, 30
ROW = ("struct<date:date,close:double,adj_close:double,volume:bigint,sma50:double,sma200:double,rsi14:double,macd:double,macd_signal:double,"
       "atr14:double,vol30:double>")
STATE = ("struct<n:bigint,last_date:date,x:double,closes:array<double>,returns:array<double>,s50:double,s200:double,e12:double,e26:double,"
         "signal:double,gain:double,loss:double,strength:double,spread:double>")
MEASURES = ["sma50", "sma200", "rsi14", "macd", "macd_signal", "atr14", "vol30"]


def empty_state() -> Column:
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    doubles = F.array().cast("array<double>")
    return F.struct(
        F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("date").alias("last_date"), none.alias("x"), doubles.alias("closes"),
        doubles.alias("returns"), *(zero.alias(c) for c in ("s50", "s200", "e12", "e26", "signal", "gain", "loss")), none.alias("strength"),
        zero.alias("spread")).cast(STATE)


def _pushed(values: Column, x: Column, most: int) -> Column:
    return F.array_append(F.when(F.size(values) < most, values).otherwise(F.slice(values, 2, most - 1)), x)


def _smoothed(average: Column, x: Column, n: Column, start: int, count: int, weight: float) -> Column:
    """A running sum until ``count`` values from row ``start`` on are in, their mean then, and a moving average after that."""
    seed = start + count - 1
    return F.when(n < start, average).when(n < seed, average + x).when(n == seed, (average + x) / count).otherwise(average + (x - average) * weight)


def moved_on(state: Column, bar: Column) -> tuple[Column, Column]:
    """The state after one more bar (date, close, adj_close, high, low, volume), and the bar's indicator row."""
    n, x, before = state["n"] + 1, bar["adj_close"], state["x"]
    change = F.when(before.isNull(), 0.0).otherwise(x - before)
    gain, loss = F.greatest(change, F.lit(0.0)), F.greatest(-change, F.lit(0.0))
    high, low = bar["high"], bar["low"]
    spread = F.when(before.isNull(), high - low).otherwise(F.greatest(high - low, F.abs(high - before), F.abs(low - before)))
    move = F.when((before > 0) & (x > 0), F.ln(x / before)).otherwise(0.0)
    old = lambda k: F.when(n > k, F.try_element_at(state["closes"], F.lit(-k))).otherwise(0.0)
    s50, s200 = state["s50"] + x - old(50), state["s200"] + x - old(LONG)
    e12, e26 = _smoothed(state["e12"], x, n, 1, 12, 2 / 13), _smoothed(state["e26"], x, n, 1, 26, 2 / 27)
    macd = F.when(n >= 26, e12 - e26)
    signal = F.when(n < 26, state["signal"]).otherwise(_smoothed(state["signal"], e12 - e26, n, 26, 9, 2 / 10))
    up, down = _smoothed(state["gain"], gain, n, 2, 14, 1 / 14), _smoothed(state["loss"], loss, n, 2, 14, 1 / 14)
    strength = F.when((n == 15) | ((n > 15) & ((gain != 0) | (loss != 0))), F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down))).otherwise(
        state["strength"])
    true_range = _smoothed(state["spread"], spread, n, 2, 14, 1 / 14)
    returns = F.when(n == 1, state["returns"]).otherwise(_pushed(state["returns"], move, RETURNS))
    after = F.struct(
        n.alias("n"), bar["date"].alias("last_date"), x.alias("x"), _pushed(state["closes"], x, LONG).alias("closes"), returns.alias("returns"),
        s50.alias("s50"), s200.alias("s200"), e12.alias("e12"), e26.alias("e26"), signal.alias("signal"), up.alias("gain"), down.alias("loss"),
        strength.alias("strength"), true_range.alias("spread"))
    mean = F.aggregate(returns, F.lit(0.0), lambda s, r: s + r) / RETURNS
    square = F.aggregate(returns, F.lit(0.0), lambda s, r: s + r * r) / RETURNS
    row = F.struct(
        bar["date"].alias("date"), bar["close"].alias("close"), x.alias("adj_close"), bar["volume"].alias("volume"),
        F.when(n >= 50, s50 / 50).alias("sma50"), F.when(n >= LONG, s200 / LONG).alias("sma200"), strength.alias("rsi14"), macd.alias("macd"),
        F.when(n >= 34, signal).alias("macd_signal"), F.when(n > 14, true_range).alias("atr14"),
        F.when(n > RETURNS, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))) * math.sqrt(TRADING_DAYS)).alias("vol30"))
    return after, row


def _finite(c: str) -> Column:
    return F.col(c).isNull() | (~F.isnan(c) & (F.abs(c) < float("inf")))


def continued(bars: DataFrame, states: DataFrame | None) -> DataFrame:
    """(security_id, state, rows): each security's state after its bars, and their indicator rows.

    ``bars``: security_id, date, close, adj_close, high, low, volume, unique per security and date and later than its state; ``states``:
    security_id, state. A bar whose price is no finite number is no bar. A security's new bars, at most the calendar, meet in one array.
    """
    bar = F.struct("date", "close", "adj_close", "high", "low", "volume")
    grouped = bars.where(_finite("close") & _finite("adj_close")).groupBy("security_id").agg(F.array_sort(F.collect_list(bar)).alias("bars"))
    known = grouped.join(states, "security_id", "left") if states is not None else grouped.withColumn("state", F.lit(None).cast(STATE))
    start = F.struct(F.coalesce("state", empty_state()).alias("state"), F.array().cast(f"array<{ROW}>").alias("rows"))

    def step(acc: Column, one: Column) -> Column:
        # The pair is built first and taken apart then, so each expression is evaluated once a bar.
        pair = F.transform(F.array(F.struct(acc["state"].alias("s"), one.alias("b"))), lambda p: F.struct(
            *(c.alias(k) for c, k in zip(moved_on(p["s"], p["b"]), ("state", "row")))))
        return F.transform(pair, lambda p: F.struct(p["state"].alias("state"), F.array_append(acc["rows"], p["row"]).alias("rows")))[0]

    folded = F.aggregate("bars", start, step)
    return known.select("security_id", folded.alias("f")).select("security_id", "f.state", "f.rows")
