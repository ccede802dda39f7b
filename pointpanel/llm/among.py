"""A filter of bounded size for rows that a later join needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap, and the most bitmaps there are: 16 MB in all, whatever the number of ids.
BITS, MOST_MAPS = 32_768, 4096


def among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``column`` may be among ``ids`` (one long column): all that are, and of the others about one in sixteen.

    Bitmaps over hashed ids go to every task, so rows that are not asked for never reach a shuffle. With more ids than the bitmaps have room for
    more rows pass; none is lost. Nulls never pass.
    """
    (name,) = ids.columns
    maps = 1
    asked = ids.count()
    while maps < MOST_MAPS and maps * BITS < 16 * asked:
        maps *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(maps * BITS))
    bitmaps = ids.where(F.col(name).isNotNull()).select(place(name).alias("_at")).groupBy(F.expr(f"_at div {BITS}").alias("_map")).agg(
        F.bitmap_construct_agg(F.col("_at") % BITS).alias("_bits"))
    byte = "cast(conv(hex(substring(_bits, cast(_at % 32768 div 8 as int) + 1, 1)), 16, 10) as int)"
    return (
        rows.where(F.col(column).isNotNull()).withColumn("_at", place(column)).withColumn("_map", F.expr(f"_at div {BITS}"))
        .join(F.broadcast(bitmaps), "_map").where(F.expr(f"shiftright({byte}, cast(_at % 8 as int)) & 1 = 1")).drop("_at", "_map", "_bits")
    )
