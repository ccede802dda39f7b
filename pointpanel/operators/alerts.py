"""Entry and exit events of saved screens, keyed by security id and never by ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff_runs(previous: DataFrame, current: DataFrame, had_previous: DataFrame) -> DataFrame:
    """Events between two runs; a strategy without an earlier run raises none.

    ``previous`` and ``current``: (strategy_id, security_id); ``had_previous``: strategy_id of earlier runs.
    """
    p = previous.select("strategy_id", "security_id", F.lit(True).alias("_was"))
    c = current.select("strategy_id", "security_id", F.lit(True).alias("_is"))
    return (
        p.join(c, ["strategy_id", "security_id"], "full_outer")
        .join(had_previous.distinct(), "strategy_id", "left_semi")
        .filter(F.col("_was").isNull() | F.col("_is").isNull())
        .select(
            "strategy_id", "security_id", F.when(F.col("_was").isNull(), "Entered").otherwise("Exited").alias("event_type")
        )
    )


def diff_history(membership: DataFrame, runs: DataFrame) -> DataFrame:
    """Events between all consecutive runs at once, from one window per (strategy, security).

    ``membership``: (strategy_id, as_of_date, security_id); ``runs``: (strategy_id, as_of_date), also of empty runs.
    A group holds one row per run the security was in, so it is bounded by the number of runs.
    """
    order = Window.partitionBy("strategy_id").orderBy("as_of_date")
    numbered = runs.select(
        "strategy_id", "as_of_date", F.row_number().over(order).alias("seq"),
        F.lead("as_of_date").over(order).alias("next_date"),
    )
    w = Window.partitionBy("strategy_id", "security_id").orderBy("seq")
    rows = membership.join(numbered, ["strategy_id", "as_of_date"]).withColumns(
        {"_prev": F.lag("seq").over(w), "_next": F.lead("seq").over(w)}
    )
    entered = (F.col("seq") > 1) & (F.col("_prev").isNull() | (F.col("_prev") != F.col("seq") - 1))
    exited = F.col("next_date").isNotNull() & (F.col("_next").isNull() | (F.col("_next") != F.col("seq") + 1))
    events = F.array_compact(
        F.array(
            F.when(entered, F.struct(F.lit("Entered").alias("event_type"), F.col("as_of_date").alias("on"))),
            F.when(exited, F.struct(F.lit("Exited").alias("event_type"), F.col("next_date").alias("on"))),
        )
    )
    return rows.select("strategy_id", "security_id", F.explode(events).alias("e")).select(
        "strategy_id", "security_id", "e.event_type", F.col("e.on").alias("as_of_date")
    )


def latest_events(events: DataFrame, strategy_id: int, n: int = 100) -> DataFrame:
    return (
        events.filter(F.col("strategy_id") == strategy_id)
        .orderBy(F.desc("as_of_date"), "security_id", "event_type")
        .limit(n)
    )
