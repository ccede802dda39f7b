"""Load folders, resumable indicators and the stored panel."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pointpanel.operators import actions, resume, series
from pointpanel.sources import loads, panel

BARS = "security_id long, date date, open double, high double, low double, close double, volume long"


def walk(security: int, n: int, seed: int, flat: bool = False):
    rng, price, out = random.Random(seed), 100.0, []
    for k in range(n):
        price = price if flat and 40 < k < 120 else max(1.0, price * (1 + rng.uniform(-0.04, 0.04)))
        spread = price * rng.uniform(0, 0.03)
        out.append((security, dt.date(2000, 1, 1) + dt.timedelta(days=k), price, price + spread, price - spread, price, 1000 + k))
    return out


def close_to(got: dict, want: dict):
    assert got.keys() == want.keys()
    for key, row in want.items():
        for name in resume.MEASURES:
            a, b = got[key][name], row[name]
            assert (a is None) == (b is None), (key, name, a, b)
            assert a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9), (key, name)


def keyed(df) -> dict:
    return {(r["security_id"], r["date"]): r for r in df.collect()}


def test_fold_equals_windows(spark):
    bars = spark.createDataFrame(walk(1, 420, 1) + walk(2, 260, 2, flat=True) + walk(3, 12, 3) + walk(4, 1, 4), BARS).withColumn("adj_close", F.col("close"))
    bars = bars.union(bars.where("security_id = 4").withColumn("date", F.lit("2001-01-01").cast("date")).withColumn("close", F.lit(float("nan"))))
    got = resume.continued(bars, None).select("security_id", F.explode("rows").alias("r")).select("security_id", "r.*")
    close_to(keyed(got), keyed(series.indicators(bars)))


def test_day_by_day_equals_a_full_run(spark, tmp_path):
    root = str(tmp_path / "panel")
    rows = walk(1, 260, 1) + walk(2, 230, 2, flat=True) + walk(3, 60, 3)
    bars = spark.createDataFrame(rows, BARS)
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(days=n)
    factors = spark.createDataFrame(
        [(1, day(100), "Split", 0.5), (1, day(255), "Bonus", 0.8), (2, day(256), "Split", 0.25), (3, day(300), "Split", 0.1)],
        "security_id long, effective_date date, action_type string, factor double")
    cuts = [0, 250, 256, 400]
    for a, b in zip(cuts, cuts[1:]):
        own = lambda c: (F.col(c) >= day(a)) & (F.col(c) < day(b))  # noqa: B023, E731
        panel.advance(spark, root, bars.where(own("date")), factors.where(own("effective_date")))
    want = keyed(series.indicators(actions.adjusted_bars(bars, factors), keep=("adj_close",)))
    got = keyed(panel.rows(spark, root))
    close_to(got, want)
    assert all(got[k]["adj_close"] == pytest.approx(want[k]["adj_close"]) for k in want)
    # A corrected bar derives its security again, the others stand.
    fixed = bars.where(F.col("date") == day(200)).where("security_id = 1").withColumn("close", F.lit(55.5))
    panel.advance(spark, root, fixed, factors.limit(0))
    panel.fold(spark, root)
    now = bars.withColumn("close", F.when((F.col("security_id") == 1) & (F.col("date") == day(200)), 55.5).otherwise(F.col("close")))
    close_to(keyed(panel.rows(spark, root)), keyed(series.indicators(actions.adjusted_bars(now, factors))))
    last = {r["security_id"]: r for r in panel.latest(spark, root, str(day(70))).collect()}
    assert last[3]["price_date"] == day(59) and last[1]["price_date"] == day(70) and last[1]["sma50"] == pytest.approx(
        keyed(panel.rows(spark, root))[(1, day(70))]["sma50"])
    plan = panel.latest(spark, root, str(day(70)))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "PartitionFilters: [isnotnull(_part" in plan


def test_loads_are_seen_once_sealed_and_equal_keys_are_one_row(spark, tmp_path):
    root = str(tmp_path / "table")
    schema = "k long, day date, v double, seq long"
    day = dt.date(2020, 1, 31)
    load = lambda *rows: spark.createDataFrame([(k, day, v, s) for k, v, s in rows], schema)
    read = lambda: sorted((r["k"], r["v"]) for r in loads.read(spark, root, "rows", ["k", "day"]).collect())
    assert loads.read(spark, root, "rows", ["k", "day"]) is None
    loads.append(load((1, 1.0, 1), (2, 5.0, 2), (2, 9.0, 1)), root, ["k", "day"], F.col("day"), order=["seq"])
    assert read() == [(1, 1.0), (2, 5.0)]
    _, folder = loads.begin(spark, root)
    loads.put(load((1, 7.0, 1)), root, folder, "rows", ["k", "day"], F.col("day"))
    assert read() == [(1, 1.0), (2, 5.0)]  # it failed before its seal
    for _ in range(2):
        loads.append(load((1, 2.0, 1), (3, 3.0, 1)), root, ["k", "day"], F.col("day"))
        assert read() == [(1, 2.0), (2, 5.0), (3, 3.0)]
    loads.fold(spark, root, {"rows": (["k", "day"], F.col("day"), False)})
    assert read() == [(1, 2.0), (2, 5.0), (3, 3.0)] and len(loads.sealed(spark, root)) == 1
    loads.append(load((2, 6.0, 1)), root, ["k", "day"], F.col("day"))
    assert read() == [(1, 2.0), (2, 6.0), (3, 3.0)]
    assert loads.read(spark, root, "rows", ["k", "day"], F.col("_part") < 202001).count() == 0


def test_a_known_count_deals_a_load_and_its_merge_over_tasks(spark, tmp_path, monkeypatch):
    """Rows of one task are bounded by their number, not by the input's files, and a fold keeps each key's newest row."""
    monkeypatch.setattr(loads, "TASK_ROWS", 100)
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("2020-01-02").cast("date").alias("day"), (F.col("id") % 7).alias("v"))
    assert loads.dealt(rows, ["k"], 1000).rdd.getNumPartitions() == 11
    root, keys = str(tmp_path / "dealt"), ["k", "day"]
    loads.append(rows.union(rows), root, keys, F.col("day"), count=2000)
    loads.append(rows.where("k < 10").withColumn("v", F.lit(-1).cast("long")), root, keys, F.col("day"), count=10)
    loads.append(rows.limit(0), root, keys, F.col("day"), count=0)
    merged = {r.k: r.v for r in loads.read(spark, root, "rows", keys).collect()}
    loads.fold(spark, root, {"rows": (keys, F.col("day"), False)})
    folded = loads.read(spark, root, "rows", keys).collect()
    assert len(folded) == 1000 and {r.k: r.v for r in folded} == merged == {k: -1 if k < 10 else k % 7 for k in range(1000)}
