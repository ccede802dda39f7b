"""Window derivations over one security's dated series.

Everything stays in the JVM. A bar is unique per (security, date), so a window partition is bounded by the calendar,
and every window here shares the same partitioning: one shuffle serves them all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252


def by_date():
    return Window.partitionBy("security_id").orderBy("date")


def running():
    return by_date().rowsBetween(Window.unboundedPreceding, 0)


def numbered(bars: DataFrame) -> DataFrame:
    """Rows numbered by date. A bar whose price is not a finite number is no bar: one NaN would spoil every later running sum."""
    prices = [c for c, kind in bars.dtypes if c in ("close", "adj_close") and kind in ("double", "float")]
    for c in prices:
        bars = bars.filter(F.col(c).isNull() | (~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))))
    return bars.withColumn("rn", F.row_number().over(by_date()))


def rolling_mean(bars: DataFrame, value: str, n: int, out: str) -> DataFrame:
    """Mean of the last ``n`` values from two running sums: linear in the rows, whatever ``n`` is."""
    with_sum = bars.withColumn("_s", F.sum(value).over(running()))
    mean = (F.col("_s") - F.coalesce(F.lag("_s", n).over(by_date()), F.lit(0.0))) / n
    return with_sum.withColumn(out, F.when(F.col("rn") >= n, mean)).drop("_s")


def log_returns(bars: DataFrame, value: str, out: str = "log_return") -> DataFrame:
    prev = F.lag(value).over(by_date())
    valid = (prev > 0) & (F.col(value) > 0)
    r = F.when(F.col("rn") > 1, F.when(valid, F.ln(F.col(value) / prev)).otherwise(0.0))
    return bars.withColumn(out, r)


def realised_vol(bars: DataFrame, value: str, n: int = 30, out: str = "vol30") -> DataFrame:
    """Population deviation of the last ``n`` log returns, annualised; first value after ``n`` returns."""
    r = F.coalesce(F.col("_r"), F.lit(0.0))
    df = log_returns(bars, value, "_r").withColumns(
        {"_s1": F.sum(r).over(running()), "_s2": F.sum(r * r).over(running())}
    )
    m1 = (F.col("_s1") - F.lag("_s1", n).over(by_date())) / n
    m2 = (F.col("_s2") - F.lag("_s2", n).over(by_date())) / n
    df = df.withColumns({"_m1": m1, "_m2": m2})
    sd = F.sqrt(F.greatest(F.col("_m2") - F.col("_m1") * F.col("_m1"), F.lit(0.0)))
    return df.withColumn(out, F.when(F.col("rn") > n, sd * math.sqrt(TRADING_DAYS))).drop(
        "_r", "_s1", "_s2", "_m1", "_m2"
    )


def true_range(bars: DataFrame, close: str = "close", out: str = "true_range") -> DataFrame:
    pc = F.lag(close).over(by_date())
    spread = F.col("high") - F.col("low")
    tr = F.greatest(spread, F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
    return bars.withColumn(out, F.when(pc.isNull(), spread).otherwise(tr))


def daily_returns(bars: DataFrame, value: str, out: str = "ret") -> DataFrame:
    prev = F.lag(value).over(by_date())
    return bars.withColumn(out, F.when(prev == 0, 0.0).otherwise(F.col(value) / prev - 1))


# --- recursive smoothing -----------------------------------------------------------------------------------------
#
# y(t) = d*y(t-1) + u(t) is a sum of u(i)*d^(t-i). Within a block of rows that sum is one running window sum over
# u(i)/d^i, scaled back by d^t; the block keeps d^i in range. A power costs more than a window's step, so each is taken once a row. A block hands its last value to the next one. Blocks
# are long enough that what came two blocks earlier is below the last bit of a double (d^block <= 1e-17).


def block_rows(*decays: float) -> int:
    return max(math.ceil(40.0 / -math.log(d)) for d in decays)


def blocked(bars: DataFrame, size: int) -> DataFrame:
    """Adds the block number and the row's place in it. From here on windows order by (block, date): the same order as by
    date, spelled the way the block windows need it, so one sort serves them all."""
    return bars.withColumns({
        "_b": F.floor((F.col("rn") - 1) / size).cast("int"), "_j": ((F.col("rn") - 1) % size).cast("double"),
        "_last": (F.col("rn") % size) == 0,
    })


def by_block():
    return Window.partitionBy("security_id").orderBy("_b", "date")


def decayed_sums(df: DataFrame, drives: dict[str, tuple[Column, float]]) -> DataFrame:
    """Adds y(t) = d*y(t-1) + u(t) for each ``out: (u, d)`` to blocked rows; u is zero before its start."""
    in_block = Window.partitionBy("security_id", "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = by_block().rowsBetween(Window.unboundedPreceding, -1)
    power = {d: f"_d{i}" for i, d in enumerate(sorted({d for _, d in drives.values()}))}
    return df.withColumns(
        {name: F.pow(F.lit(d), F.col("_j")) for d, name in power.items()}
    ).withColumns(
        {f"_u_{o}": u / F.col(power[d]) for o, (u, d) in drives.items()}
    ).withColumns(
        {f"_z_{o}": F.sum(f"_u_{o}").over(in_block) * F.col(power[d]) for o, (_, d) in drives.items()}
    ).withColumns(
        {f"_p_{o}": F.last(F.when(F.col("_last"), F.col(f"_z_{o}")), ignorenulls=True).over(before) for o in drives}
    ).withColumns(
        {
            o: F.col(f"_z_{o}") + F.coalesce(F.col(f"_p_{o}"), F.lit(0.0)) * F.col(power[d]) * d
            for o, (_, d) in drives.items()
        }
    ).drop(*power.values(), *[f"_{k}_{o}" for k in "uzp" for o in drives])


def seeded(value: Column, n: int, start: int, weight: float, over=None) -> Column:
    """The drive of a smoother seeded with the mean of its first ``n`` values, the first one at row ``start``."""
    seed_row = start + n - 1
    total = F.sum(F.when(F.col("rn") >= start, value).otherwise(0.0)).over(over or running())
    return (
        F.when(F.col("rn") < seed_row, 0.0).when(F.col("rn") == seed_row, total / n).otherwise(value * weight)
    )


def running_block():
    return by_block().rowsBetween(Window.unboundedPreceding, 0)


def unblocked(df: DataFrame) -> DataFrame:
    return df.drop("_b", "_j", "_last")


def ema(bars: DataFrame, value: str, n: int, out: str) -> DataFrame:
    """Seed = mean of the first ``n``; then e += (x - e) * 2/(n+1)."""
    w = 2.0 / (n + 1)
    df = bars.withColumn("_d", seeded(F.col(value), n, 1, w))
    df = decayed_sums(blocked(df, block_rows(1 - w)), {out: (F.col("_d"), 1 - w)})
    return unblocked(df).withColumn(out, F.when(F.col("rn") >= n, F.col(out))).drop("_d")


def _macd(df: DataFrame, fast: int, slow: int, signal: int, **also: Column) -> DataFrame:
    """macd and its signal from blocked rows that carry the two averages ``_ef`` and ``_es``. ``also`` names further columns over
    ``by_block``, which the pass of the signal's seed computes along."""
    w = 2.0 / (signal + 1)
    df = df.withColumn("macd", F.when(F.col("rn") >= slow, F.col("_ef") - F.col("_es")))
    df = df.withColumns({"_dm": seeded(F.col("macd"), signal, slow, w, running_block()), **also})
    df = decayed_sums(df, {"_sig": (F.col("_dm"), 1 - w)})
    return df.withColumn("macd_signal", F.when(F.col("rn") >= slow + signal - 1, F.col("_sig"))).drop("_dm", "_sig")


def macd(bars: DataFrame, value: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """EMA(fast) - EMA(slow), and its own EMA over the part where it is defined."""
    wf, ws = 2.0 / (fast + 1), 2.0 / (slow + 1)
    df = bars.withColumns(
        {"_df": seeded(F.col(value), fast, 1, wf), "_ds": seeded(F.col(value), slow, 1, ws)}
    )
    df = decayed_sums(blocked(df, block_rows(1 - ws)), {"_ef": (F.col("_df"), 1 - wf), "_es": (F.col("_ds"), 1 - ws)})
    return unblocked(_macd(df, fast, slow, signal)).drop("_df", "_ds", "_ef", "_es")


def rsi(bars: DataFrame, value: str, n: int = 14, out: str = "rsi14") -> DataFrame:
    """Wilder's index: mean gain and loss of the first ``n`` changes, then (avg*(n-1) + x)/n."""
    df = bars.withColumn("_c", F.col(value) - F.lag(value).over(by_date()))
    df = df.withColumns({
        "_g": F.greatest(F.coalesce(F.col("_c"), F.lit(0.0)), F.lit(0.0)),
        "_l": F.greatest(F.coalesce(-F.col("_c"), F.lit(0.0)), F.lit(0.0)),
    })
    df = df.withColumns({"_dg": seeded(F.col("_g"), n, 2, 1 / n), "_dl": seeded(F.col("_l"), n, 2, 1 / n)})
    d = 1 - 1 / n
    df = unblocked(decayed_sums(blocked(df, block_rows(d)), {"_ag": (F.col("_dg"), d), "_al": (F.col("_dl"), d)}))
    return df.withColumn(out, strength_index(n, running())).drop("_c", "_g", "_l", "_dg", "_dl", "_ag", "_al")


def strength_index(n: int, over) -> Column:
    """Wilder's index from the averages ``_ag`` and ``_al`` and the moves ``_g`` and ``_l``.

    Where the price stands still both averages shrink alike, so the index is that of the last move. It is carried rather than computed
    anew, because the averages themselves vanish on a long flat stretch and their quotient with them.
    """
    index = F.when(F.col("_al") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_ag") / F.col("_al")))
    moved = (F.col("rn") == n + 1) | ((F.col("rn") > n) & ((F.col("_g") != 0) | (F.col("_l") != 0)))
    return F.last(F.when(moved, index), ignorenulls=True).over(over)


def atr(bars: DataFrame, close: str = "close", n: int = 14, out: str = "atr14") -> DataFrame:
    """Wilder average of the true range; the first bar's range is not part of the seed."""
    df = true_range(bars, close, "_tr")
    df = df.withColumn("_dt", seeded(F.col("_tr"), n, 2, 1 / n))
    df = unblocked(decayed_sums(blocked(df, block_rows(1 - 1 / n)), {out: (F.col("_dt"), 1 - 1 / n)}))
    return df.withColumn(out, F.when(F.col("rn") > n, F.col(out))).drop("_tr", "_dt")


def indicators(bars: DataFrame, value: str = "adj_close", keep: tuple[str, ...] = ()) -> DataFrame:
    """The indicator row of every bar: averages, index, convergence, range and volatility of the adjusted series.

    High and low stay raw while the previous close is adjusted, as the derivation defines it. ``keep`` names bar columns
    to carry along, which saves joining them back.
    """
    prev = F.lag(value).over(by_date())
    df = numbered(bars).withColumn("_prev", prev)
    change = F.coalesce(F.col(value) - F.col("_prev"), F.lit(0.0))
    ratio_ok = (F.col("_prev") > 0) & (F.col(value) > 0)
    df = df.withColumns({
        "_g": F.greatest(change, F.lit(0.0)),
        "_l": F.greatest(-change, F.lit(0.0)),
        "_tr": F.when(F.col("_prev").isNull(), F.col("high") - F.col("low")).otherwise(
            F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_prev")),
                       F.abs(F.col("low") - F.col("_prev")))),
        "_r": F.when(ratio_ok, F.ln(F.col(value) / F.col("_prev"))).otherwise(0.0),
    })
    df = df.withColumns({
        "_s": F.sum(value).over(running()),
        "_r1": F.sum("_r").over(running()),
        "_r2": F.sum(F.col("_r") * F.col("_r")).over(running()),
        "_df": seeded(F.col(value), 12, 1, 2 / 13),
        "_ds": seeded(F.col(value), 26, 1, 2 / 27),
        "_dg": seeded(F.col("_g"), 14, 2, 1 / 14),
        "_dl": seeded(F.col("_l"), 14, 2, 1 / 14),
        "_dt": seeded(F.col("_tr"), 14, 2, 1 / 14),
    })
    d14 = 13 / 14
    df = decayed_sums(blocked(df, block_rows(25 / 27)), {
        "_ef": (F.col("_df"), 11 / 13), "_es": (F.col("_ds"), 25 / 27), "_ag": (F.col("_dg"), d14),
        "_al": (F.col("_dl"), d14), "_at": (F.col("_dt"), d14),
    })
    back = {"_s50": ("_s", 50), "_s200": ("_s", 200), "_q1": ("_r1", 30), "_q2": ("_r2", 30)}
    df = _macd(df, 12, 26, 9, _index=strength_index(14, running_block()), **{
        out: F.lag(c, n).over(by_block()) for out, (c, n) in back.items()})
    m1 = (F.col("_r1") - F.col("_q1")) / 30
    m2 = (F.col("_r2") - F.col("_q2")) / 30
    rn = F.col("rn")
    return df.select(
        "security_id", "date", *keep,
        F.when(rn >= 50, (F.col("_s") - F.coalesce("_s50", F.lit(0.0))) / 50).alias("sma50"),
        F.when(rn >= 200, (F.col("_s") - F.coalesce("_s200", F.lit(0.0))) / 200).alias("sma200"),
        F.col("_index").alias("rsi14"),
        "macd",
        "macd_signal",
        F.when(rn > 14, F.col("_at")).alias("atr14"),
        F.when(rn > 30, F.sqrt(F.greatest(m2 - m1 * m1, F.lit(0.0))) * math.sqrt(TRADING_DAYS)).alias("vol30"),
    )
