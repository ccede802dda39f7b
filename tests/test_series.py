from __future__ import annotations

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from pointpanel.functions import corporate
from pointpanel.operators import actions, asof, series

WILDER = [44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.10, 45.42, 45.84, 46.08, 45.89, 46.03, 45.61, 46.28, 46.28, 46.00,
          46.03, 46.41, 46.22, 45.64, 46.21]
DAY = dt.date(2000, 1, 3)


def bars(spark, closes, sid=1):
    rows = [(sid, DAY + dt.timedelta(i), float(c) + 1, float(c) - 1, float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "security_id long, date date, high double, low double, close double")


def values(df, col):
    return [r[col] for r in df.orderBy("date").collect()]


def test_rsi_matches_published_values(spark):
    got = values(series.rsi(series.numbered(bars(spark, WILDER)), "close"), "rsi14")
    assert got[:14] == [None] * 14
    assert got[14:17] == pytest.approx([70.46, 66.25, 66.48], abs=0.05)
    assert got[19] == pytest.approx(57.97, abs=0.10)


def test_rsi_without_losses_is_100(spark):
    assert values(series.rsi(series.numbered(bars(spark, range(1, 20))), "close"), "rsi14")[-1] == 100.0


def walk_ema(xs, n):
    out, e = [], None
    for i, x in enumerate(xs):
        if i == n - 1:
            e = sum(xs[:n]) / n
        elif i >= n:
            e += (x - e) * 2 / (n + 1)
        out.append(e)
    return out


def walk_wilder(xs, n):
    """xs[0] is not used; the seed stands at index n."""
    out, a = [None] * len(xs), None
    for i in range(n, len(xs)):
        a = sum(xs[1:n + 1]) / n if i == n else (a * (n - 1) + xs[i]) / n
        out[i] = a
    return out


def test_smoothers_equal_a_plain_walk_across_block_borders(spark):
    rnd = random.Random(7)
    xs, x = [], 1000.0
    for _ in range(2600):
        x = max(1.0, x * math.exp(rnd.gauss(0, 0.03)))
        xs.append(x)
    df = series.indicators(bars(spark, xs), "close")
    rows = df.orderBy("date").collect()
    e12, e26 = walk_ema(xs, 12), walk_ema(xs, 26)
    macd = [None if b is None else a - b for a, b in zip(e12, e26)]
    signal = [None] * 25 + walk_ema(macd[25:], 9)
    gains = [0] + [max(b - a, 0) for a, b in zip(xs, xs[1:])]
    losses = [0] + [max(a - b, 0) for a, b in zip(xs, xs[1:])]
    g, lo = walk_wilder(gains, 14), walk_wilder(losses, 14)
    tr = [2.0] + [max(2.0, abs(b + 1 - a), abs(b - 1 - a)) for a, b in zip(xs, xs[1:])]
    atr = walk_wilder(tr, 14)
    assert series.block_rows(25 / 27) < 1300  # the series spans several blocks
    for i in (24, 25, 33, 34, 518, 519, 520, 521, 1040, 1041, 2000, 2599):
        r = rows[i]
        assert (r.macd is None) == (macd[i] is None)
        if macd[i] is not None:
            assert r.macd == pytest.approx(macd[i], rel=1e-9, abs=1e-9)
        if signal[i] is not None:
            assert r.macd_signal == pytest.approx(signal[i], rel=1e-9, abs=1e-9)
        assert r.rsi14 == pytest.approx(100 - 100 / (1 + g[i] / lo[i]), rel=1e-9)
        assert r.atr14 == pytest.approx(atr[i], rel=1e-9)
    long = values(series.ema(series.numbered(bars(spark, xs)), "close", 50, "e"), "e")
    want = walk_ema(xs, 50)
    assert long[:49] == [None] * 49
    assert long[49:] == pytest.approx(want[49:], rel=1e-10)


def test_rolling_windows_need_their_full_length(spark):
    df = series.realised_vol(series.rolling_mean(series.numbered(bars(spark, [5.0] * 35)), "close", 10, "m"), "close")
    rows = df.orderBy("date").collect()
    assert [r.m for r in rows[:10]] == [None] * 9 + [5.0]
    assert rows[29].vol30 is None and rows[30].vol30 == 0.0


def test_split_leaves_a_continuous_adjusted_series(spark):
    f = spark.createDataFrame([(1, DAY + dt.timedelta(2), "Split", 0.5)], "security_id long, effective_date date, action_type string, factor double")
    assert values(actions.adjusted_bars(bars(spark, [100, 100, 50, 50]), f), "adj_close") == [50.0] * 4


@pytest.mark.parametrize("kind,text,want", [
    ("bonus", "Bonus issue in the ratio of 1:2", 2 / 3), ("bonus", "ratio of 3:1", 0.25), ("bonus", "ratio of 2 : 5", 5 / 7),
    ("bonus", "no numbers", None), ("split", "from Rs. 10 to Rs. 5", 0.5), ("split", "from Rs10/- to Rs2/-", 0.2),
    ("split", "from Rs. 2/- to Re. 1/-", 0.5), ("split", "from Re. 1 to Rs. 2", 2.0), ("split", "in the ratio of 1:2", None),
])
def test_remarks(spark, kind, text, want):
    f = {"bonus": corporate.bonus_from_remark, "split": corporate.split_from_remark}[kind]
    got = spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("f")).head().f
    assert got == (None if want is None else pytest.approx(want))


def test_rights_terms_take_face_plus_premium(spark):
    t = corporate.rights_terms(F.col("t"))
    df = spark.createDataFrame([("shares of Rs. 10/- in the ratio of 3:5 @ premium of Rs. 290/-",), ("ratio of 1:1 premium of Rs. 5",)], "t string")
    rows = df.select(*[c.alias(n) for n, c in t.items()]).collect()
    assert tuple(rows[0]) == (3.0, 5.0, 300.0) and tuple(rows[1]) == (1.0, 1.0, 5.0)


def test_asof_join_directions_and_bounds(spark):
    left = spark.createDataFrame([(1, DAY + dt.timedelta(5)), (2, DAY)], "security_id long, at date")
    right = spark.createDataFrame([(1, DAY, 1.0), (1, DAY + dt.timedelta(5), 2.0), (1, DAY + dt.timedelta(30), 3.0)], "security_id long, date date, v double")

    def run(**kw):
        return {r.security_id: r.m for r in asof.asof_join(left, right, "at", "date", {"v": "m"}, **kw).collect()}

    assert run() == {1: 2.0, 2: None}
    assert run(exact=False) == {1: 1.0, 2: None}
    assert run(exact=False, forward=True) == {1: 3.0, 2: None}
    assert run(exact=False, forward=True, max_days=10) == {1: None, 2: None}


def test_panel_keeps_the_last_known_row_per_date(spark):
    facts = bars(spark, [1, 2, 3]).unionByName(bars(spark, [9], sid=2).withColumn("date", F.date_add("date", 40)))
    schedule = spark.createDataFrame([(DAY + dt.timedelta(k),) for k in (-1, 1, 20, 50)], "signal_date date")
    rows = asof.panel_as_of(facts, schedule, ["close"]).collect()
    got = {(r.security_id, (r.signal_date - DAY).days): r.close for r in rows}
    assert got == {(1, 1): 2.0, (1, 20): 3.0, (1, 50): 3.0, (2, 50): 9.0}


def walk_rsi(xs, n=14):
    out, gain, loss = [None] * len(xs), 0.0, 0.0
    for i in range(1, len(xs)):
        g, l = max(xs[i] - xs[i - 1], 0.0), max(xs[i - 1] - xs[i], 0.0)
        if i <= n:
            gain, loss = gain + g / n, loss + l / n
        else:
            gain, loss = (gain * (n - 1) + g) / n, (loss * (n - 1) + l) / n
        if i >= n:
            out[i] = 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
    return out


def test_rsi_stays_on_a_long_flat_stretch(spark):
    rng = random.Random(7)
    closes = [100.0]
    for _ in range(299):
        closes.append(closes[-1] + rng.choice([-1, 0, 1, 2, -2]) * 0.5)
    closes += [closes[-1]] * 1500
    closes += [closes[-1] + 1, closes[-1] - 2]
    frame = bars(spark, closes)
    want = walk_rsi(closes)
    for got in (values(series.rsi(series.numbered(frame), "close"), "rsi14"), values(series.indicators(frame.withColumn("adj_close", F.col("close"))), "rsi14")):
        assert got[:14] == [None] * 14 and got[14:] == pytest.approx(want[14:], abs=1e-6)
    assert abs(want[1700] - 100) > 1


def test_a_price_that_is_no_number_is_no_bar(spark):
    closes = [float(100 + i % 7) for i in range(300)]
    clean = values(series.rolling_mean(series.numbered(bars(spark, closes)), "close", 50, "m"), "m")
    spoilt = bars(spark, closes[:100] + [float("nan")] + closes[100:])
    got = values(series.rolling_mean(series.numbered(spoilt), "close", 50, "m"), "m")
    assert got[:49] == [None] * 49 and got[49:] == pytest.approx(clean[49:])


def remarked(spark, rows):
    return spark.createDataFrame(
        [(sid, DAY + dt.timedelta(day), kind, text) for sid, day, kind, text in rows],
        "security_id long, effective_date date, action_type string, raw_description string")


def test_adjusting_by_actions_equals_resolving_factors_first(spark):
    rights = "Rights equity shares of Rs. 10/- in the ratio of 1 : 2 @ premium of Rs. 30/-"
    acts = remarked(spark, [
        (1, 0, "Rights", rights), (1, 4, "Rights", rights), (1, 4, "Split", "from Rs. 10 to Rs. 5"), (1, 4, "Dividend", None), (1, 9, "Bonus", "none"),
        (1, 12, "Bonus", "ratio of 1:2"), (1, 40, "Split", "from Rs. 10 to Rs. 2"), (2, 5, "Rights", rights), (3, 1, "Split", "from Rs. 10 to Rs. 5"),
    ])
    patchy = bars(spark, [60, 0, 80, 0, 0, 90], sid=2).withColumn("close", F.nullif("close", F.lit(0.0)))
    frame = bars(spark, range(100, 115)).filter(F.date_diff("date", F.lit(DAY)) != 4).unionByName(patchy)
    want = actions.adjusted_bars(frame, actions.resolve_factors(acts, frame))
    got = actions.adjusted_by_actions(frame, acts)
    plain = [sorted(map(str, df.withColumn("adj_close", F.round("adj_close", 9)).collect())) for df in (got, want)]
    assert got.columns == want.columns and plain[0] == plain[1]
    first = values(got.filter("security_id = 1"), "adj_close")[0]
    assert first == pytest.approx(100 * 0.2 * (2 / 3) * 0.5 * (2 * 103 + 40) / 3 / 103)
    assert values(got.filter("security_id = 2"), "adj_close")[0] == 60.0  # the cum price is unknown, so nothing is diluted


def test_bars_pass_no_method_that_is_too_long_to_compile(spark, capsys):
    """Above 8,000 bytes the JVM interprets a method, for each bar that runs through it."""
    frame, acts = bars(spark, [100, 100, 50]), remarked(spark, [(1, 2, "Split", "from Rs. 10 to Rs. 5")])
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        resolved = actions.resolve_factors(acts, frame)
        for df in (actions.adjusted_bars(frame, resolved), actions.adjusted_by_actions(frame, acts), actions.with_steps(acts, frame)):
            df.explain("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
