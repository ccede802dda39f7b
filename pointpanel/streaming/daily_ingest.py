"""Incremental ingest: new daily files become upserted bars and sealed snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointpanel.session import stored
from pointpanel.sources import eod_files, sinks, snapshots

KEYS = ["symbol", "date"]
#: Lines of the files that a task puts in order and writes on average.
TASK_ROWS = 500_000


def corrections_path(bars_path: str) -> str:
    return bars_path.rstrip("/") + "-corrections"


def ingest_batch(spark: SparkSession, lines: DataFrame, bars_path: str, manifest: str) -> None:
    """Parse and upsert on (symbol, date); a repeated batch changes nothing.

    Of several files with one symbol and day, one that bears the identifier wins, then the later file name: within a batch, and against what
    earlier batches left. A late file may correct a day that is sealed already, but not in silence: the values before and after are logged.
    """
    heads = stored(eod_files.layouts(lines), "layouts")
    if not heads.where(F.col("n").isNull()).isEmpty():
        raise ValueError("a daily file has an unknown layout")
    # A row bears the place of its file among the names of the batch, and goes once to where the table wants it: by year and symbol.
    heads = heads.withColumn("_at", F.row_number().over(Window.orderBy("file")))
    rows = eod_files.parse_eod(lines, keep=("_at",), heads=heads)
    ranked = rows.withColumn("_part", F.year("date")).withColumn("_seq", F.struct((F.col("isin") != "").alias("identified"), F.col("_at").alias("at"))).drop("_at")
    tasks = (heads.agg(F.sum("lines")).first()[0] or 0) // TASK_ROWS + 1
    load = sinks.latest_rows(ranked.repartition(tasks, "_part", *KEYS[:1]), ["_part", *KEYS], "_seq")
    if sinks._exists(spark, bars_path):
        load = stored(load.drop("_part"), "load")
        before = sinks.read_table(spark, bars_path).join(load.select(*KEYS), KEYS, "left_semi").select(
            *KEYS, F.col("isin").alias("_isin"), F.col("close").alias("close_before"), F.col("volume").alias("volume_before"))
        both = load.join(before, KEYS, "left")
        load = stored(both.where((F.col("isin") != "") | (F.coalesce("_isin", F.lit("")) == "")), "load")
        moved = ~F.col("close").eqNullSafe(F.col("close_before")) | ~F.col("volume").eqNullSafe(F.col("volume_before"))
        days = snapshots.read_manifest(spark, manifest).select(F.col("as_of_date").alias("date"))
        late = load.where(F.col("_isin").isNotNull() & moved).join(days, "date", "left_semi").select(
            *KEYS, "close_before", "close", "volume_before", "volume", F.current_timestamp().alias("corrected_at"))
        if not late.isEmpty():
            sinks.append_log(late, corrections_path(bars_path))
        load = load.drop("_isin", "close_before", "volume_before").withColumn("_part", F.year("date"))
    sinks.upsert(spark, bars_path, load, KEYS, F.col("_part"), dealt=True)


def seal_landed(spark: SparkSession, bars_path: str, manifest: str) -> None:
    """Seal the days that no snapshot holds yet, with the counts of the table itself.

    It runs once all landed files are drained, so a day whose files fell into several batches is whole.
    """
    if not sinks._exists(spark, bars_path):
        return
    days = sinks.read_table(spark, bars_path).groupBy("date").agg(F.count(F.lit(1)).alias("price_row_count")).select(
        F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long").alias("snapshot_id"),
        F.col("date").alias("as_of_date"), "price_row_count",
    )
    fresh = stored(days.join(snapshots.read_manifest(spark, manifest), "snapshot_id", "left_anti"), "days")  # read four times
    if not fresh.isEmpty():
        snapshots.seal(spark, manifest, fresh)


def run_ingest(spark: SparkSession, landing: str, bars_path: str, manifest: str, checkpoint: str, files: int = 1000) -> None:
    """Drain what has landed, seal the new days and stop; the checkpoint remembers which files were taken."""
    lines = (
        spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files)
        .schema("value string").format("text").load(landing)
        .select(F.col("_metadata.file_path").alias("file"), "value")
    )
    query = (
        lines.writeStream.foreachBatch(
            lambda batch, _: ingest_batch(batch.sparkSession, batch, bars_path, manifest)
        )
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    seal_landed(spark, bars_path, manifest)
