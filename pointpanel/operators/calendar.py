"""Trading calendar, executions and fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: trading days on which an order may fill.
MAX_FILL_ATTEMPTS = 5


def trading_days(bars: DataFrame) -> DataFrame:
    """Distinct bar dates: deduplicated map-side, then bounded by the calendar."""
    return bars.select("date").distinct()


def next_trading_dates(days: DataFrame, dates: DataFrame, date_col: str) -> DataFrame:
    """For each distinct date the first trading day after it. Both inputs are calendars, so one sort is enough."""
    w = Window.orderBy(F.col("_at").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = days.select(F.col("date").alias("_at"), F.lit(0).alias("_side"), F.col("date").alias("_day")).unionByName(
        dates.select(F.col(date_col).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("date").alias("_day"))
        .distinct()
    )
    # latest first; a trading day on the very date sorts after the probe and so is not "next"
    return both.withColumn("next_date", F.last("_day", ignorenulls=True).over(w)).filter(F.col("_side") == 1).select(
        F.col("_at").alias(date_col), "next_date"
    )


def first_fillable(bars: DataFrame, legs: DataFrame, attempts: int = MAX_FILL_ATTEMPTS, price: str = "close") -> DataFrame:
    """Per (leg, security) the first bar that is not locked, among the first ``attempts`` bars of the leg.

    ``legs``: rebalance_no, execution_date, period_end; legs do not overlap, so a day belongs to one leg at most and the
    range join is an equality on the day. The day map is bounded by the calendar and broadcast.
    """
    days = legs.select("rebalance_no", F.explode(F.sequence("execution_date", "period_end")).alias("date"))
    candidates = bars.join(F.broadcast(days), "date")
    w = Window.partitionBy("security_id", "rebalance_no").orderBy("date")
    early = candidates.withColumn("attempt", F.row_number().over(w)).filter(F.col("attempt") <= attempts)
    return early.filter(~F.col("is_circuit_locked")).groupBy("rebalance_no", "security_id").agg(
        F.min("date").alias("fill_date"), F.min_by(price, "date").alias("fill_price")
    )


def execution_legs(schedule: DataFrame, snapshots: DataFrame, days: DataFrame, end: str) -> DataFrame:
    """Signal date -> latest sealed snapshot -> next trading day; legs that cannot execute by ``end`` drop out.

    All three inputs are calendars.
    """
    ends = schedule.select(
        "rebalance_no", "signal_date",
        F.coalesce(F.lead("signal_date").over(Window.orderBy("signal_date")), F.lit(end).cast("date")).alias("period_end"),
    )
    sealed = latest_sealed(snapshots, ends, "signal_date")
    nxt = next_trading_dates(days, sealed.filter(F.col("as_of_date").isNotNull()), "as_of_date")
    return (
        sealed.join(F.broadcast(nxt), "as_of_date")
        .filter(F.col("next_date") <= F.lit(end).cast("date"))
        .select(
            "rebalance_no", "signal_date", "snapshot_id", "as_of_date", F.col("next_date").alias("execution_date"),
            "period_end",
        )
    )


def latest_sealed(snapshots: DataFrame, dates: DataFrame, date_col: str) -> DataFrame:
    """Newest sealed snapshot at or before each date; of several on one day the highest id. Unsealed ones never count."""
    per_day = snapshots.filter(F.col("sealed_at").isNotNull()).groupBy("as_of_date").agg(
        F.max("snapshot_id").alias("snapshot_id")
    )
    w = Window.orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    facts = per_day.select(
        F.col("as_of_date").alias("_at"), F.lit(0).alias("_side"), F.struct("as_of_date", "snapshot_id").alias("_s")
    )
    probes = dates.select("*", F.col(date_col).alias("_at"), F.lit(1).alias("_side"))
    return (
        probes.unionByName(facts, allowMissingColumns=True)
        .withColumn("_m", F.last("_s", ignorenulls=True).over(w))
        .filter(F.col("_side") == 1)
        .select(*dates.columns, "_m.as_of_date", "_m.snapshot_id")
    )
