"""As-of joins: the row of one side that was current on the other side's date.

Three shapes, none of which expands a range:

* one date for all keys: a filter and a ``max_by`` aggregate, combined map-side;
* many rows with their own dates: union of both sides, one sort per key, ``last`` over the running frame;
* a schedule of dates for all keys: each fact is assigned to its schedule slot and pre-aggregated before the shuffle.

Facts are unique per (key, date), so a key's group never exceeds the number of calendar days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_as_of(
    facts: DataFrame, as_of: str, values: list[str], key: str = "security_id", date: str = "date",
    date_alias: str | None = None,
) -> DataFrame:
    """The last fact per key dated on or before ``as_of``. Primitive values keep the aggregate hash-based."""
    return (
        facts.filter(F.col(date) <= F.lit(as_of).cast("date"))
        .groupBy(key)
        .agg(F.max(date).alias(date_alias or date), *[F.max_by(v, date).alias(v) for v in values])
    )


def asof_join(
    left: DataFrame, right: DataFrame, left_date: str, right_date: str, values: dict[str, str],
    key: str = "security_id", exact: bool = True, forward: bool = False, max_days: int | None = None,
) -> DataFrame:
    """Each left row with ``values`` (right column -> output name) of the nearest right row.

    ``exact`` lets a right row of the same date match, ``forward`` looks ahead instead of back, ``max_days`` blanks a
    match further away than that. ``right_date`` may be listed in ``values`` too.
    """
    match_cols = [F.col(c).alias(f"v{i}") for i, c in enumerate(values)]
    facts = right.select(
        F.col(key), F.col(right_date).alias("_at"), F.lit(0 if exact else 1).alias("_side"),
        F.struct(F.col(right_date).alias("d"), *match_cols).alias("_fact"),
    )
    probes = left.select("*", F.col(left_date).alias("_at"), F.lit(1 if exact else 0).alias("_side"))
    at = F.col("_at").desc() if forward else F.col("_at").asc()
    running = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = probes.withColumn("_probe", F.lit(True)).unionByName(facts, allowMissingColumns=True)
    found = both.withColumn("_m", F.last("_fact", ignorenulls=True).over(running)).filter(F.col("_probe"))
    near = F.lit(True)
    if max_days is not None:
        near = F.abs(F.datediff(F.col(left_date), F.col("_m.d"))) <= max_days
    out = [F.when(near, F.col(f"_m.v{i}")).alias(name) for i, name in enumerate(values.values())]
    return found.select(*left.columns, *out)


def panel_as_of(
    facts: DataFrame, schedule: DataFrame, values: list[str], key: str = "security_id", date: str = "date",
    slot_date: str = "signal_date", date_alias: str = "price_date",
) -> DataFrame:
    """Every key at every schedule date: the last fact on or before it (none yet: no row).

    ``schedule`` holds distinct calendar dates, so it and the day-to-slot map are bounded by the calendar and may be
    broadcast. Facts collapse to one row per (key, slot) before the only wide shuffle.
    """
    order = Window.orderBy(slot_date)
    slots = schedule.select(slot_date).distinct().select(
        slot_date,
        F.row_number().over(order).alias("_no"),
        F.lag(slot_date).over(order).alias("_prev"),
    )
    days = slots.filter(F.col("_prev").isNotNull()).select(
        F.explode(F.sequence(F.date_add("_prev", 1), F.col(slot_date))).alias("_day"), "_no"
    )
    placed = (
        facts.filter(F.col(date) <= schedule.agg(F.max(slot_date)).scalar())
        .join(F.broadcast(days), F.col(date) == F.col("_day"), "left")
        .withColumn("_no", F.coalesce("_no", F.lit(1)))
    )
    per_slot = placed.groupBy(key, "_no").agg(
        F.max(date).alias(date_alias), *[F.max_by(v, date).alias(v) for v in values]
    )
    following = F.lead("_no").over(Window.partitionBy(key).orderBy("_no"))
    until = F.coalesce(following - 1, slots.agg(F.max("_no")).scalar())
    filled = per_slot.withColumn("_until", until).withColumn(
        "_slot", F.explode(F.sequence("_no", "_until"))
    ).drop("_no", "_until")
    return filled.join(
        F.broadcast(slots.select(slot_date, F.col("_no").alias("_slot"))), "_slot"
    ).drop("_slot")
