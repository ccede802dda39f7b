"""The stored panel: bars, factors, indicator rows and indicator states in one folder of loads.

A load brings new bars and newly known factors. Securities without a new factor and without a bar at or before their last one continue from
their state; the others are derived again from all of their bars. The four tables are sealed together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointpanel.operators import actions, resume
from pointpanel.session import stored
from pointpanel.sources import loads

BARS = ["security_id", "date", "open", "high", "low", "close", "volume"]
KEYS = {"bars": ["security_id", "date"], "factors": ["security_id", "effective_date", "action_type"], "rows": ["security_id", "date"], "states": ["security_id"]}


DAYS, YEARLY = {"bars": "date", "factors": "effective_date", "rows": "date"}, ("factors",)


def _no_day():
    return F.lit("1970-01-01").cast("date")


def _with(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows, those of the load in place of older ones of their keys."""
    return new if old is None else old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def advance(spark: SparkSession, root: str, bars: DataFrame, factors: DataFrame) -> None:
    """Take in ``bars`` (columns BARS) and newly known ``factors`` (security_id, effective_date, action_type, factor)."""
    bars, factors = stored(bars.select(*BARS), "bars"), stored(factors.select(*KEYS["factors"], "factor"), "factors")
    old = {t: loads.read(spark, root, t, KEYS[t]) for t in KEYS}
    all_factors = _with(old["factors"], factors, KEYS["factors"])
    states, due = None, bars
    if old["states"] is not None:
        late = bars.join(old["states"].select("security_id", "state.last_date"), "security_id").where(F.col("date") <= F.col("last_date"))
        touched = stored(factors.select("security_id").union(late.select("security_id")).distinct(), "touched")
        states = old["states"].join(touched, "security_id", "left_anti")
        again = old["bars"].join(touched, "security_id", "left_semi").join(bars.select(*KEYS["bars"]), KEYS["bars"], "left_anti")
        due = bars.unionByName(again.select(*BARS))
    found = stored(resume.continued(actions.adjusted_bars(due, all_factors), states), "continued")
    load, folder = loads.begin(spark, root)
    rows = found.select("security_id", F.explode("rows").alias("r")).select("security_id", "r.*")
    for table, frame in (("bars", bars), ("factors", factors), ("rows", rows), ("states", found.select("security_id", "state"))):
        loads.put(frame, root, folder, table, KEYS[table], F.col(DAYS[table]) if table in DAYS else _no_day(), yearly=table in YEARLY)
    loads.seal(spark, root, load, folder)


def rows(spark: SparkSession, root: str) -> DataFrame:
    """(security_id, date, close, adj_close, volume, indicators) of every bar."""
    return loads.read(spark, root, "rows", KEYS["rows"])


def latest(spark: SparkSession, root: str, as_of: str) -> DataFrame:
    """Each security's last row on or before ``as_of`` as the screens want it, from the folders of its month and earlier ones only."""
    day = F.lit(as_of).cast("date")
    upto = (F.col("_part") <= F.year(day) * 100 + F.month(day)) & (F.col("date") <= day)
    found = loads.read(spark, root, "rows", KEYS["rows"], upto)
    values = ["close", "adj_close", "volume", *resume.MEASURES]
    return found.groupBy("security_id").agg(F.max("date").alias("price_date"), *[F.max_by(c, "date").alias(c) for c in values])


def fold(spark: SparkSession, root: str) -> None:
    loads.fold(spark, root, {t: (KEYS[t], F.col(DAYS[t]) if t in DAYS else _no_day(), t in YEARLY) for t in KEYS})
