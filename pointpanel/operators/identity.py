"""Who a row belongs to: stable ids behind changing symbols, listings, locks and delistings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointpanel.operators.asof import asof_join

# Fixed values.
EQUITY_SERIES = ["EQ", "BE"]
LOCK_MOVE = 0.019
SYNTHETIC_PREFIX = "NSE:"
HOME_EXCHANGE = "NSE"
DELISTING_GAP_DAYS = 60


def is_equity(series: Column) -> Column:
    return F.upper(F.trim(series)).isin(EQUITY_SERIES)


def circuit_locked(prev_close: Column) -> Column:
    """One price all day, moved from the close before; without a previous close it is not a lock."""
    flat = (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    moved = F.abs((F.col("close") - prev_close) / F.when(prev_close > 0, prev_close)) >= LOCK_MOVE
    return F.coalesce(flat & moved, F.lit(False))


def with_lock_flag(bars: DataFrame) -> DataFrame:
    prev = F.lag("close").over(Window.partitionBy("security_id").orderBy("date"))
    return bars.withColumn("_prev", prev).withColumn("is_circuit_locked", circuit_locked(F.col("_prev"))).drop("_prev")


def learn_isins(rows: DataFrame) -> DataFrame:
    """symbol -> identifier, the later file wins."""
    return rows.filter(F.col("isin") != "").groupBy("symbol").agg(
        F.max_by("isin", F.struct("date", "isin")).alias("learned_isin")
    )


def resolve_identity(rows: DataFrame, learned: DataFrame) -> DataFrame:
    own = F.when(F.col("isin") != "", F.col("isin"))
    return rows.join(learned, "symbol", "left").withColumn(
        "provider_id",
        F.coalesce(own, F.col("learned_isin"), F.concat(F.lit(SYNTHETIC_PREFIX), F.col("symbol"))),
    ).drop("learned_isin")


def ticker_changes(rows: DataFrame) -> DataFrame:
    """A known security under another symbol than on its previous day."""
    w = Window.partitionBy("security_id").orderBy("date")
    return (
        rows.withColumn("old_symbol", F.lag("symbol").over(w))
        .filter(F.col("old_symbol") != F.col("symbol"))
        .select(
            "security_id", F.col("date").alias("effective_date"), F.lit("TickerChange").alias("action_type"),
            F.col("symbol").alias("new_ticker"),
            F.concat(F.lit("Symbol changed from "), "old_symbol", F.lit(" to "), "symbol").alias("raw_description"),
        )
    )


def upgrade_synthetic_ids(securities: DataFrame, learned: DataFrame) -> DataFrame:
    """A placeholder id gives way to a real one; a real id never goes back."""
    real = learned.withColumnRenamed("symbol", "ticker")
    better = F.col("provider_id").startswith(SYNTHETIC_PREFIX) & ~F.col("learned_isin").startswith(SYNTHETIC_PREFIX)
    return securities.join(real, "ticker", "left").withColumn(
        "provider_id", F.when(better, F.col("learned_isin")).otherwise(F.col("provider_id"))
    ).drop("learned_isin")


# --- identity over time -----------------------------------------------------------------------------------------------


def _islands(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, valid_from, valid_to, before): runs of equal values over the dates of each key; the last one is open."""
    w = Window.partitionBy(key).orderBy("date")
    first = rows.withColumn("before", F.lag(value).over(w)).where(F.col("before").isNull() | (F.col("before") != F.col(value)))
    return first.select(key, value, F.col("date").alias("valid_from"), F.date_sub(F.lead("date").over(w), 1).alias("valid_to"), "before")


def symbol_intervals(rows: DataFrame) -> DataFrame:
    """(symbol, isin, valid_from, valid_to): who held a symbol when, from the rows (symbol, isin, date) that bear an identifier. A symbol that
    another company takes over has an interval for each."""
    known = rows.where("isin != ''").groupBy("symbol", "date").agg(F.max("isin").alias("isin"))
    return _islands(known, "symbol", "isin").drop("before")


def resolve_over_time(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds ``provider_id``: the row's own identifier, else that of the holder of its symbol on its date, else of the first holder, else a
    placeholder."""
    held = asof_join(rows, intervals, "date", "valid_from", {"isin": "_held"}, key="symbol")
    first = intervals.groupBy("symbol").agg(F.min_by("isin", "valid_from").alias("_first"))
    own = F.when(F.col("isin") != "", F.col("isin"))
    return held.join(first, "symbol", "left").withColumn(
        "provider_id", F.coalesce(own, "_held", "_first", F.concat(F.lit(SYNTHETIC_PREFIX), F.col("symbol")))).drop("_held", "_first")


def ticker_history(resolved: DataFrame) -> DataFrame:
    """(provider_id, symbol, valid_from, valid_to, before): the symbols of each company over time; ``before`` is the one it gave up."""
    daily = resolved.groupBy("provider_id", "date").agg(F.max("symbol").alias("symbol"))
    return _islands(daily, "provider_id", "symbol")


def reconcile_securities(existing: DataFrame, resolved: DataFrame, intervals: DataFrame) -> DataFrame:
    """The securities table after rows (symbol, date, provider_id): matched by id, a placeholder by the first holder of its ticker, else inserted.

    ``existing``: provider_id, ticker, name, exchange, is_active, delisted_date, delisting_reason. Companies that used one ticker at different
    times stay apart. One seen after its delisting is active again, and its delisting is cleared. Of several rows that turn out to be one company
    the one with a real id is kept up, the others stay untouched.
    """
    first = intervals.groupBy(F.col("symbol").alias("ticker")).agg(F.min_by("isin", "valid_from").alias("_first"))
    synthetic = F.col("provider_id").startswith(SYNTHETIC_PREFIX)
    known = existing.join(first, "ticker", "left").withColumn("_id", F.coalesce(F.when(synthetic, F.col("_first")), F.col("provider_id")))
    best = Window.partitionBy("_id").orderBy(synthetic.cast("int"), "provider_id")
    known = known.withColumn("_id", F.when(F.row_number().over(best) == 1, F.col("_id")).otherwise(F.concat(F.lit("="), "provider_id")))
    seen = resolved.groupBy(F.col("provider_id").alias("_id")).agg(F.max_by("symbol", "date").alias("_symbol"), F.max("date").alias("_last"))
    both = known.join(seen, "_id", "full_outer")
    new, gone = F.col("provider_id").isNull(), F.col("_symbol").isNull()
    back = ~gone & ~F.col("is_active") & (F.col("_last") > F.coalesce("delisted_date", F.lit("0001-01-01").cast("date")))
    change = (
        F.when(new, "inserted").when(gone, "untouched").when(back, "reactivated").when(F.col("_symbol") != F.col("ticker"), "renamed")
        .when(synthetic & (F.col("_id") != F.col("provider_id")), "identified").otherwise("seen")
    )
    cleared = lambda c: F.when(~new & ~F.coalesce(back, F.lit(False)), F.col(c))
    return both.select(
        F.when(gone, F.col("provider_id")).otherwise(F.col("_id")).alias("provider_id"), F.coalesce("_symbol", "ticker").alias("ticker"),
        F.coalesce("name", "_symbol").alias("name"), F.coalesce("exchange", F.lit(HOME_EXCHANGE)).alias("exchange"),
        (new | F.coalesce(back, F.lit(False)) | F.coalesce("is_active", F.lit(True))).alias("is_active"),
        cleared("delisted_date").alias("delisted_date"), cleared("delisting_reason").alias("delisting_reason"), change.alias("change"))


def ticker_change_rows(history: DataFrame) -> DataFrame:
    """The corporate actions of companies that changed their symbol."""
    return history.where(F.col("before").isNotNull()).select(
        "provider_id", F.col("valid_from").alias("effective_date"), F.lit("TickerChange").alias("action_type"), F.col("symbol").alias("new_ticker"),
        F.concat(F.lit("Symbol changed from "), "before", F.lit(" to "), "symbol").alias("raw_description"))


def detect_delistings(securities: DataFrame, bars: DataFrame, gap_days: int = DELISTING_GAP_DAYS, days: DataFrame | None = None) -> DataFrame:
    """Active securities whose last bar lies more than ``gap_days`` calendar days before the market's last one are delisted.

    Only newly found ones are touched, so a run over its own result changes nothing and earlier dates and reasons stay. ``days`` is the
    market's calendar; it is needed where ``bars`` are those of some securities only.
    """
    last = bars.groupBy("security_id").agg(F.max("date").alias("last_date"))
    market = (bars if days is None else days).agg(F.max("date"))
    gone = F.col("is_active") & (F.col("last_date") < F.date_sub(market.scalar(), gap_days))
    flag = F.coalesce(gone, F.lit(False))
    own = ["is_active", "delisted_date", "delisting_reason"]
    known = {c: F.col(c) if c in securities.columns else F.lit(None) for c in own[1:]}
    return securities.join(last, "security_id", "left").select(
        *[c for c in securities.columns if c not in own],
        (F.col("is_active") & ~flag).alias("is_active"),
        F.when(flag, F.col("last_date")).otherwise(known["delisted_date"].cast("date")).alias("delisted_date"),
        F.when(flag, F.lit("Unknown")).otherwise(known["delisting_reason"].cast("string")).alias("delisting_reason"),
    )
