"""Idempotent writes without a table format: upserts, insert-if-new, versioned history and append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointpanel.session import stored


def latest_rows(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Within one load the row with the highest sequence per key."""
    values = [c for c in rows.columns if c not in (*keys, seq)]
    # One buffer for the whole row: a sequence that holds text would otherwise be carried once for each value.
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), seq).alias("_v")).select(*keys, "_v.*").select(
        *[c for c in rows.columns if c != seq]
    )


def merged(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The table after an upsert: existing rows without a new version, and the incoming rows.

    An anti join against the load's keys, not a sort of both sides: the large side moves only if the load is large.
    """
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def upsert(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], partition: Column, dealt: bool = False) -> None:
    """Upsert into a Parquet table partitioned by ``_part``, rewriting only the partitions the load touches.

    The load's partition values prune the read (dynamic partition pruning) and a dynamic overwrite replaces just those
    folders, so a repeated load ends in the same table. A first load that is ``dealt`` by its partition and first key is written where it lies.
    """
    load = incoming.withColumn("_part", partition)
    if _exists(spark, path):
        load = stored(load, "load")  # read three times below; a first load is read once and written at once
        table = spark.read.parquet(path).select(*load.columns)
        touched = table.join(F.broadcast(load.select("_part").distinct()), "_part", "left_semi").select(*load.columns)
        load, dealt = merged(touched, load, [*keys, "_part"]), False
    (
        (load if dealt else load.repartition("_part", *keys[:1])).sortWithinPartitions("_part", *keys)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_part")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Rows of the load whose key is not there yet; within the load the first one wins."""
    values = [c for c in incoming.columns if c not in (*keys, seq)]
    first = incoming.groupBy(*keys).agg(*[F.min_by(c, seq).alias(c) for c in values])
    return first.join(existing.select(*keys), keys, "left_anti")


def versioned(current: DataFrame, incoming: DataFrame, keys: list[str], measures: list[str], on: str) -> DataFrame:
    """System-time history after a load: unchanged rows stay open, changed ones close on ``on`` and open anew.

    ``current`` has valid_from/valid_to. Comparison is null-safe, so an unchanged row writes no new version.
    """
    open_end = F.lit("9999-12-31").cast("date")
    day = F.lit(on).cast("date")
    closed = current.filter(F.col("valid_to") < open_end)
    live = current.filter(F.col("valid_to") == open_end)
    new = incoming.select(*keys, F.struct(*[c for c in incoming.columns if c not in keys]).alias("_new"))
    both = live.withColumn("_old", F.struct(*measures)).join(new, keys, "full_outer")
    fresh = F.struct(*[F.col("_new")[m].alias(m) for m in measures])
    changed = F.col("_new").isNotNull() & ~F.col("_old").eqNullSafe(fresh)
    kept = both.filter(F.col("_old").isNotNull()).withColumn(
        "valid_to", F.when(changed, day).otherwise(F.col("valid_to"))
    ).select(*current.columns)
    values = [c for c in current.columns if c not in (*keys, "valid_from", "valid_to")]
    added = both.filter(changed).select(
        *keys, *[F.col("_new")[c].alias(c) for c in values], day.alias("valid_from"), open_end.alias("valid_to")
    )
    return closed.unionByName(kept).unionByName(added)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def members_json(members: DataFrame, group: list[str], limit: int) -> DataFrame:
    """The members of each run as JSON, by rank, and how many there were. A run keeps at most its screen's ``limit`` as members; the
    count is that of all its results."""
    shown = F.collect_list(F.when(F.col("rank") <= limit, F.struct("rank", "security_id")))
    return members.groupBy(*group).agg(
        F.count(F.lit(1)).alias("result_count"),
        F.to_json(F.transform(F.sort_array(shown), lambda m: F.struct(m["security_id"].alias("security_id")))).alias("members_json"),
    )
