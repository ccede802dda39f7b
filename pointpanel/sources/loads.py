"""Tables as load folders: a load is written aside, a manifest row seals it, and readers merge the sealed loads.

A load that fails half-way was never sealed, so nobody sees it, and nothing that was read is ever overwritten. Readers take the newest row of
each key; a load with equal keys holds one row for them. ``fold`` writes all loads as one, after which readers begin there. Several tables
may share a load, so one manifest row seals them together.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task puts together or merges on average, where their number is known.
TASK_ROWS = 300_000
MANIFEST = "load long, folder string, whole boolean"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def sealed(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, folder) of the loads that readers merge: the last whole one and those after it."""
    if not exists(spark, f"{root}/_loads"):
        return []
    rows = sorted((r["load"], r["whole"], r["folder"]) for r in spark.read.schema(MANIFEST).parquet(f"{root}/_loads").collect())
    first = max((k for k, (_, whole, _) in enumerate(rows) if whole), default=0)
    return [(load, folder) for load, _, folder in rows[first:]]


def begin(spark: SparkSession, root: str) -> tuple[int, str]:
    """The number and the folder of the next load."""
    load = max((number for number, _ in sealed(spark, root)), default=0) + 1
    return load, f"load-{load}-{uuid.uuid4().hex}"


def dealt(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Rows by key over as many tasks as they need, so that an aggregate holds no more in a large table than in a small one."""
    return rows.repartition(count // TASK_ROWS + 1, *keys)


def put(
    rows: DataFrame, root: str, folder: str, table: str, keys: list[str], month: Column, order: list[str] | None = None, yearly: bool = False,
    count: int | None = None, unique: bool = False,
) -> None:
    """Write one table of a load, partitioned by the month of ``month`` (the first of its year if ``yearly``); of equal keys the row last in ``order`` stays (else that of the largest hash).
    A table without rows is no part of its load. ``count`` is the number of rows, if known; ``unique`` rows have each key once."""
    if rows.isEmpty() if count is None else count == 0:
        return
    values = [c for c in rows.columns if c not in keys]
    part = (F.year(month) * 100 + (F.lit(1) if yearly else F.month(month))).alias("_part")
    # Column by column, so that the aggregate stays hash-based; the rebalance makes one file of a small part and several of a large one.
    ranked = (rows if count is None else dealt(rows, keys, count)).withColumn("_o", F.struct(*order) if order else F.xxhash64(*values))
    each = rows if unique else ranked.groupBy(*keys).agg(*[F.max_by(c, "_o").alias(c) for c in values])
    each.select(*rows.columns, part).hint("rebalance", "_part").sortWithinPartitions("_part", *keys).write.partitionBy("_part").parquet(f"{root}/{folder}/{table}")


def seal(spark: SparkSession, root: str, load: int, folder: str, whole: bool = False) -> None:
    spark.createDataFrame([(load, folder, whole)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/_loads")


def read(spark: SparkSession, root: str, table: str, keys: list[str], where: Column | None = None) -> DataFrame | None:
    """The newest sealed row of each key; ``where`` may test ``_part`` (year and month), which prunes folders, and keys."""
    found = [(n, f"{root}/{folder}/{table}") for n, folder in sealed(spark, root)]
    found = [(n, path) for n, path in found if exists(spark, path)]
    if not found:
        return None
    some = [spark.read.parquet(path).withColumn("_load", F.lit(n)) for n, path in found]
    some = [df.where(where) for df in some] if where is not None else some
    rows = reduce(DataFrame.unionByName, some).drop("_part")
    if len(some) == 1:
        return rows.drop("_load")
    values = [c for c in rows.columns if c not in (*keys, "_load")]
    # The number of rows stands in the files' footers.
    return dealt(rows, keys, rows.count()).groupBy(*keys).agg(*[F.max_by(c, "_load").alias(c) for c in values])


def append(rows: DataFrame, root: str, keys: list[str], month: Column, order: list[str] | None = None, table: str = "rows", yearly: bool = False, count: int | None = None) -> None:
    """One load of one table, sealed."""
    load, folder = begin(rows.sparkSession, root)
    put(rows, root, folder, table, keys, month, order, yearly, count)
    seal(rows.sparkSession, root, load, folder)


def fold(spark: SparkSession, root: str, tables: dict[str, tuple[list[str], Column, bool]]) -> None:
    """Write the sealed loads as one; ``tables`` names the keys, the month and the yearly flag of each table."""
    number = max(n for n, _ in sealed(spark, root))
    folder = f"whole-{number}-{uuid.uuid4().hex}"
    for table, (keys, month, yearly) in tables.items():
        rows = read(spark, root, table, keys)
        if rows is not None:
            put(rows, root, folder, table, keys, month, yearly=yearly, unique=True)
    seal(spark, root, number, folder, whole=True)
