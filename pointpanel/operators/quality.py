"""Guards against lookahead, unsealed reads and survivorship: each returns the rows that break the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unsealed_reads(reads: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Reads of a snapshot that was never sealed, or of none at all."""
    sealed = snapshots.filter(F.col("sealed_at").isNotNull()).select("snapshot_id")
    return reads.join(sealed, "snapshot_id", "left_anti")


def after_as_of(rows: DataFrame, data_date: str, as_of: str) -> DataFrame:
    return rows.filter(F.col(data_date) > F.col(as_of))


def executed_too_early(rows: DataFrame, executed: str, signal: str) -> DataFrame:
    return rows.filter(F.col(executed) <= F.col(signal))


def missing_from_universe(universe: DataFrame, securities: DataFrame, bars: DataFrame, on: str) -> DataFrame:
    """Securities that could be traded on the date and are not in the universe.

    Tradeable: has a bar by then, and is active or was delisted only later.
    """
    d = F.lit(on).cast("date")
    traded = bars.filter(F.col("date") <= d).select("security_id").distinct()
    alive = securities.filter(F.col("is_active") | (F.col("delisted_date") > d))
    return alive.join(traded, "security_id", "left_semi").join(universe, "security_id", "left_anti")


def locked_fills(fills: DataFrame, bars: DataFrame) -> DataFrame:
    locked = bars.filter("is_circuit_locked").select("security_id", F.col("date").alias("fill_date"))
    return fills.join(locked, ["security_id", "fill_date"], "left_semi")


def orphans(securities: DataFrame, *references: DataFrame) -> DataFrame:
    """Securities that no table refers to. Each reference shrinks to its distinct keys before the shuffle."""
    out = securities
    for table in references:
        out = out.join(table.select("security_id").distinct(), "security_id", "left_anti")
    return out


def retained(facts: DataFrame, cutoff: str, date: str = "date") -> DataFrame:
    return facts.filter(F.col(date) >= F.lit(cutoff).cast("date"))
