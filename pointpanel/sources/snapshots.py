"""Dated snapshots: data first, then a manifest row; readers only see what the manifest seals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointpanel.sources.sinks import _exists

MANIFEST = (
    "snapshot_id long, as_of_date date, created_at timestamp, sealed_at timestamp, provider_version string, price_row_count long, "
    "fundamental_row_count long"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    if _exists(spark, path):
        return spark.read.schema(MANIFEST).parquet(path)
    return spark.createDataFrame([], MANIFEST)


def seal(spark: SparkSession, manifest: str, candidates: DataFrame) -> None:
    """Append one manifest row per candidate (snapshot_id, as_of_date, price_row_count, and the other fields where it has them).

    Any number of days is sealed in one write. A snapshot without price rows or one sealed before is refused. A candidate's own time of
    creation is kept, the time of sealing is now.
    """
    empty = candidates.filter(F.coalesce("price_row_count", F.lit(0)) <= 0)
    again = candidates.join(read_manifest(spark, manifest), "snapshot_id", "left_semi")
    if not empty.isEmpty():
        raise ValueError("a snapshot without price rows cannot be sealed")
    if not again.isEmpty():
        raise ValueError("the snapshot is already sealed")
    def given(name: str, kind: str):
        return (F.col(name) if name in candidates.columns else F.lit(None)).cast(kind)

    now = F.current_timestamp()
    candidates.select(
        F.col("snapshot_id").cast("long").alias("snapshot_id"), "as_of_date", F.coalesce(given("created_at", "timestamp"), now).alias("created_at"),
        now.alias("sealed_at"), F.coalesce(given("provider_version", "string"), F.lit("")).alias("provider_version"),
        F.col("price_row_count").cast("long").alias("price_row_count"),
        F.coalesce(given("fundamental_row_count", "long"), F.lit(0).cast("long")).alias("fundamental_row_count"),
    ).coalesce(1).write.mode("append").parquet(manifest)


def sealed_rows(data: DataFrame, manifest: DataFrame) -> DataFrame:
    """What a reader sees: the manifest has one row per snapshot, a calendar-sized table."""
    return data.join(manifest.select("snapshot_id"), "snapshot_id", "left_semi")


def unsealed_days(bars: DataFrame, snapshots: DataFrame, first: str, last: str) -> DataFrame:
    """Days with bars and no sealed snapshot, with their bar counts: what a history seal would publish."""
    inside = bars.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    done = snapshots.filter(F.col("sealed_at").isNotNull()).select(F.col("as_of_date").alias("date")).distinct()
    return inside.groupBy("date").agg(F.count(F.lit(1)).alias("price_row_count")).join(done, "date", "left_anti")


def seal_history(spark: SparkSession, manifest: str, bars: DataFrame, snapshots: DataFrame, first: str, last: str, **fields) -> None:
    """Seal every day between ``first`` and ``last`` that has bars and no sealed snapshot, in one write. ``fields`` are further columns."""
    days = unsealed_days(bars, snapshots, first, last)
    seal(spark, manifest, days.select(
        F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long").alias("snapshot_id"), F.col("date").alias("as_of_date"),
        "price_row_count", *[column.alias(name) for name, column in fields.items()]))
