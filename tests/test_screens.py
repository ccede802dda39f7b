from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from pointpanel.functions import dates
from pointpanel.operators import alerts, concepts, identity, screen


def cmp(field="ClosePrice", op="GreaterThan", value=1):
    return {"kind": "comparison", "field": field, "operator": op, "value": value}


@pytest.mark.parametrize("tree", [
    {"kind": "group", "op": "Or", "children": [cmp()]}, {"kind": "group", "op": "Not", "children": [cmp()]},
    {"kind": "group", "op": "And", "children": []}, cmp(field="Momentum"),
])
def test_refused_trees(spark, tree):
    with pytest.raises(ValueError):
        screen.predicate(tree)


def test_refused_universe_and_limits(spark):
    with pytest.raises(ValueError):
        screen.in_universe({"index": "TOP50"})
    for n in (0, 1001):
        with pytest.raises(ValueError):
            screen.top_rows(spark.range(1), None, n)


def test_a_null_metric_passes_no_comparison(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0)], "security_id long, pe double")
    for op in screen.COMPARE:
        hits = df.filter(screen.comparison("PeRatio", op, 3)).collect()
        assert 1 not in [r.security_id for r in hits]


def _json(root, **more):
    return json.dumps({"universe": {}, "root": root, **more})


def _node(field, op, value):
    return {"kind": "comparison", "field": field, "operator": op, "value": value}


def _group(*children, op="And"):
    return {"kind": "group", "op": op, "children": list(children)}


def test_bulk_screens_take_universe_nesting_sort_and_default_limit(spark):
    df = spark.createDataFrame(
        [(i, f"T{i:04d}", "ASIA" if i % 2 else "EUROPE", float(i), None if i % 3 == 0 else i / 2, 50.0) for i in range(300)],
        "security_id long, ticker string, exchange string, close double, pe double, rsi14 double")
    low = _node("ClosePrice", "GreaterThan", 5)
    saved = spark.createDataFrame([
        ("flat", _json(_group(low, _node("PeRatio", "LessThanOrEqual", 6)))), ("bare", _json(_node("PeRatio", "LessThan", 4))),
        ("asia", _json(_group(low), universe={"exchange": "ASIA"}, limit=3)), ("nested", _json(_group(_group(_group(_node("Rsi14", "LessThan", 90)))), limit=1000)),
        ("desc", _json(_group(low), sort={"field": "PeRatio", "direction": "Desc"}, limit=2)), ("or", _json(_group(low, op="Or"))),
        ("asc", _json(_group(low), sort={"field": "PeRatio", "direction": "Asc"}, limit=2)), ("wide", _json(_group(low))),
        ("index", _json(_group(low), universe={"index": "X"})), ("lacking", _json(_group(_node("Sma50", "LessThan", 9)))),
    ], "strategy_id string, criteria_json string")
    valid = concepts.parsed_criteria(saved).withColumnRenamed("strategy_id", "criteria_key")
    got = {}
    for r in screen.screen_many(df, valid, ["security_id"]).orderBy("criteria_key", "rank").collect():
        got.setdefault(r["criteria_key"], []).append(r["security_id"])
    assert got["flat"] == [7, 8, 10, 11] and got["bare"] == [1, 2, 4, 5, 7] and got["asia"] == [7, 9, 11]
    assert len(got["nested"]) == 300 and got["desc"] == [299, 298] and got["asc"] == [6, 9] and len(got["wide"]) == 200
    assert "or" not in got and "index" not in got and "lacking" not in got
    refused = {(r["strategy_id"], r["code"]) for r in concepts.refused_criteria(saved).collect()}
    assert refused == {("or", "OperatorNotSupportedInV1"), ("index", "IndexNotSupported")}


def test_many_criteria_in_several_buckets_and_no_hidden_bound(spark):
    df = spark.createDataFrame([(i, f"T{i}", float(i)) for i in range(40)], "security_id long, ticker string, close double")
    saved = spark.createDataFrame([(str(k), _json(_node("ClosePrice", "LessThan", k % 40))) for k in range(1300)], "strategy_id string, criteria_json string")
    valid = concepts.parsed_criteria(saved).withColumnRenamed("strategy_id", "criteria_key")
    counts = {r["criteria_key"]: r["count"] for r in screen.screen_many(df, valid, ["security_id"]).groupBy("criteria_key").count().collect()}
    assert counts == {str(k): k % 40 for k in range(1300) if k % 40}
    many = spark.range(1500).selectExpr("1 AS g", "id", "1200 AS n")
    assert screen.top_per_group(many, ["g"], ["id"], F.col("n")).count() == 1200
    with pytest.raises(Exception, match="more than 1000"):
        screen.top_per_group(many, ["g"], ["id"], F.col("n"), at_most=1000).count()


def test_deep_trees_report_their_own_errors_only(spark):
    node = _node("Bogus", "LessThan", 1)
    for _ in range(9):
        node = _group(node)
    saved = spark.createDataFrame([("deep", _json(node)), ("text", _json(_node("PeRatio", "LessThan", 1), name="[[[[[["))], "strategy_id string, criteria_json string")
    got = sorted((r["strategy_id"], r["code"], r["path"].count("children")) for r in concepts.validate_criteria(saved).collect())
    assert got == [("deep", "TreeTooDeep", 0), ("deep", "UnknownConcept", 9)]


def test_a_tree_of_any_depth_costs_its_neighbours_nothing(spark):
    deep = _node("PeRatio", "LessThan", 10)
    for k in range(500):
        deep = _group(deep) if k % 2 else _group(deep, _node("Rsi14", "LessThan", 20))
    odd = '{"universe":{"exchange":"A\\\\"},"name":"a \\"[{ b","root":%s}' % json.dumps(_group(_node("PeRatio", "LessThan", 1)))
    deep_odd = json.dumps({"root": {**deep, "name": 'x"]}[{\\'}, "sort": {"field": "Bogus", "direction": "Asc"}, "limit": 0, "universe": {"index": "I"}})
    saved = spark.createDataFrame([("deep", _json(deep)), ("odd", odd), ("deep odd", deep_odd), ("fine", _json(_node("PeRatio", "LessThan", 1)))],
                                  "strategy_id string, criteria_json string")
    got = sorted((r["strategy_id"], r["code"]) for r in concepts.refused_criteria(saved).collect())
    trees = [(k, code) for k in ("deep", "deep odd") for code in ("TreeTooDeep", "TooManyComparisons")]
    assert got == sorted([*trees, ("deep odd", "UnknownConcept"), ("deep odd", "InvalidLimit"), ("deep odd", "IndexNotSupported")])
    valid = {r["strategy_id"]: r for r in concepts.parsed_criteria(saved).collect()}
    assert valid.keys() == {"odd", "fine"} and valid["odd"]["exchange"] == "A\\"


def test_walked_trees_equal_read_ones(spark, monkeypatch):
    trees = [_group(_node("PeRatio", "LessThan", 1.5), _group(_node("Rsi14", "GreaterThan", -2), op="Or"), _group()), _node("Bogus", "Equal", 0),
             _group(_group(_group(_group(_node("ClosePrice", "LessThan", 1e3)))), op="Not")]
    saved = spark.createDataFrame([(str(k), _json(t, limit=k, sort={"field": "PeRatio", "direction": "Desc"})) for k, t in enumerate(trees)],
                                  "strategy_id string, criteria_json string")
    read = lambda: sorted(map(str, concepts.read_criteria(saved).withColumn(
        "nodes", F.array_sort(F.transform("nodes", lambda n: n.withField("n_children", (n["n_children"] > 0).cast("int"))))).collect()))
    whole = read()
    monkeypatch.setattr(concepts, "LEVELS", 1)
    assert read() == whole


def test_index_equals_brute_force_on_many_criteria(spark, monkeypatch):
    from pointpanel.operators import predicate_index

    rng = random.Random(7)
    draw = lambda: rng.choice([None, *range(8), round(rng.uniform(-1, 9), 2)])
    rows = [(i, f"T{i:03d}", rng.choice(["ASIA", "EUROPE", None]), *(None if (v := draw()) is None else float(v) for _ in range(3))) for i in range(120)]
    df = spark.createDataFrame(rows, "security_id long, ticker string, exchange string, close double, pe double, rsi14 double")
    fields, ops = ["ClosePrice", "PeRatio", "Rsi14", "Sma50"], list(screen.COMPARE)[:4]
    made = []
    for k in range(5000):
        own = [(rng.choice(fields[:3] if k % 50 else fields), rng.choice(ops), float(rng.choice([*range(9), round(rng.uniform(0, 8), 2)]))) for _ in range(rng.randrange(1, 4))]
        made.append((f"k{k}", rng.choice([None, None, "ASIA"]), None, own, None, False, 1000))
    criteria = spark.createDataFrame(made, "criteria_key string, exchange string, sector string, "
                                     "comparisons array<struct<field:string,operator:string,value:double>>, sort_field string, descending boolean, limit int")
    column = {"ClosePrice": 3, "PeRatio": 4, "Rsi14": 5}
    want = {(key, r[0]) for key, place, _, own, *_ in made for r in rows if (place is None or r[2] == place) and all(
        f in column and r[column[f]] is not None and screen.COMPARE[op](r[column[f]], value) for f, op, value in own)}
    for part in (50_000, 700):
        monkeypatch.setattr(predicate_index, "PART_CRITERIA", part)
        got = [(r["criteria_key"], r["security_id"]) for r in screen.screen_many(df, criteria, ["security_id"]).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_index_join_is_dealt_by_the_pairs_it_makes(spark, monkeypatch):
    """One block that 300 rows share with 200 criteria: no task makes more than a few times the stated number of pairs."""
    from pointpanel.operators import predicate_index

    block = ["part", "field", "op", "level", "block"]
    hot = [F.lit(0).alias("part"), F.lit("Volume").alias("field"), F.lit("LessThan").alias("op"), F.lit(3).alias("level"), F.lit(0).alias("block")]
    asked = spark.range(300).select(F.col("id").alias("_row"), *hot)
    entries = spark.range(200).select(F.concat(F.lit("k"), "id").alias("criteria_key"), *hot)
    monkeypatch.setattr(predicate_index, "TASK_PAIRS", 2_000)
    found = predicate_index._reached(asked, entries, block)
    assert found.distinct().count() == found.count() == 300 * 200
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) <= 10 * 2_000


def test_only_the_first_matches_of_a_cell_leave_it(spark, monkeypatch):
    """Ranks equal brute force over nulls, NaN, zeros and ties, and of each cell a criteria takes no more rows than its limit."""
    from pointpanel.operators import first_matches

    rng = random.Random(3)
    draw = lambda: rng.choice([None, float("nan"), 0.0, -0.0, float("inf"), *map(float, range(-3, 9))])
    rows = [(i, f"T{rng.randrange(90):03d}" if i % 9 else None, rng.choice(["ASIA", "EUROPE", None]), draw(), draw()) for i in range(150)]
    df = spark.createDataFrame(rows, "security_id long, ticker string, exchange string, close double, pe double")
    ops, column = list(screen.COMPARE)[:4], {"ClosePrice": 3, "PeRatio": 4}
    made = []
    for k in range(400):
        own = [(rng.choice(["ClosePrice", "PeRatio"] if k % 40 else ["Sma50", "PeRatio"]), rng.choice(ops), float(rng.randrange(-3, 9))) for _ in range(k % 4)]
        made.append((f"k{k}", rng.choice([None, None, "ASIA", "AFRICA"]), None, own, rng.choice([None, "PeRatio", "ClosePrice", "Sma50"]), rng.random() < 0.5, rng.choice([1, 3, 1000])))
    criteria = spark.createDataFrame(made, "criteria_key string, exchange string, sector string, "
                                     "comparisons array<struct<field:string,operator:string,value:double>>, sort_field string, descending boolean, limit int")
    key = lambda v: (v != v, 0.0 if v != v else v)  # noqa: E731 - NaN is the largest
    value = lambda r, f: r[column[f]] if f in column else None

    def before(r, field, descending):
        if field is None:
            return (r[1] is not None, r[1] or "", r[0])
        v = value(r, field)
        return ((v is None) == descending, key(0.0 if v is None else -v if descending else v), r[0])

    want = set()
    for name, place, _, own, field, descending, limit in made:
        hits = [r for r in rows if own and (place is None or r[2] == place) and all(
            value(r, f) is not None and screen.COMPARE[op](key(value(r, f)), key(v)) for f, op, v in own)]
        want |= {(name, n + 1, r[0]) for n, r in enumerate(sorted(hits, key=lambda r: before(r, field, descending))[:limit])}
    monkeypatch.setattr(first_matches, "CELL_ROWS", 40)
    monkeypatch.setattr(first_matches, "CELL_CRITERIA", 150)
    assert {tuple(r) for r in screen.screen_many(df, criteria, ["security_id"]).collect()} == want
    moved = first_matches.first_matches(df, criteria, "security_id", list(column)).groupBy("criteria_key").count()
    assert moved.join(criteria, "criteria_key").where("count > 4 * limit").isEmpty()


def test_later_bars_take_no_part_in_the_bulk_frame(spark, monkeypatch):
    from pointpanel.fixtures import Fixtures
    from pointpanel.plans import screens

    kept = []
    monkeypatch.setattr(screens, "stored", lambda df, label: kept.append(df) or df)
    screens.bulk_frame(Fixtures(spark, "/root/testdata/sf0.001"))
    assert [str(df.agg(F.max("date")).first()[0]) <= screens.AS_OF for df in kept] == [True]


def test_longer_alias_consumes_its_words(spark):
    df = spark.createDataFrame([("Cheap, not OVERBOUGHT!",), ("cheapest",), ("low-debt & low   leverage",), ("low conservative balance sheet debt",)], "t string")
    got = [sorted(r.t) for r in df.select(concepts.tags(F.col("t")).alias("t")).collect()]
    # removing a phrase brings its neighbours together, which counts for shorter keys
    assert got == [["cheap", "not_overbought"], [], ["low_debt"], ["low_debt"]]


def test_first_run_raises_no_events_and_flips_are_seen(spark):
    d = [dt.date(2020, 1, i) for i in (1, 2, 3)]
    runs = spark.createDataFrame([(1, x) for x in d] + [(2, d[2])], "strategy_id long, as_of_date date")
    m = spark.createDataFrame([(1, d[0], 7), (1, d[2], 7), (1, d[1], 8), (2, d[2], 9)], "strategy_id long, as_of_date date, security_id long")
    got = sorted((r.security_id, r.event_type, r.as_of_date.day) for r in alerts.diff_history(m, runs).collect())
    assert got == [(7, "Entered", 3), (7, "Exited", 2), (8, "Entered", 2), (8, "Exited", 3)]


def test_chained_month_ends(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 31), dt.date(2020, 4, 30))], "s date, e date")
    got = df.select(dates.rebalance_dates(F.col("s"), F.col("e"), F.lit(1)).alias("d")).head().d
    assert [str(x) for x in got] == ["2020-01-31", "2020-02-29", "2020-03-29", "2020-04-29"]


def test_dates_in_six_formats(spark):
    texts = ["03-JAN-1996", "1996-01-03", "03-01-1996", "03/01/1996", "19960103", "03-Jan-96", " 03-jan-1996 ", "31-31-1996", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.d for r in df.select("i", dates.parse_date(F.col("t")).alias("d")).orderBy("i").collect()]
    assert got == [dt.date(1996, 1, 3)] * 7 + [None, None]


def test_lock_needs_one_price_and_a_move(spark):
    rows = [(1, dt.date(2020, 1, i + 1), o, h, o, c) for i, (o, h, c) in enumerate([(10.0, 10.0, 10.0), (10.1, 10.1, 10.1), (10.5, 10.5, 10.5), (11.0, 12.0, 11.0)])]
    df = identity.with_lock_flag(spark.createDataFrame(rows, "security_id long, date date, open double, high double, low double, close double"))
    assert [r.is_circuit_locked for r in df.orderBy("date").collect()] == [False, False, True, False]


def test_relisted_renamed_and_reused_tickers(spark):
    d = lambda n: dt.date(2020, 1, n)
    rows = spark.createDataFrame([
        (d(1), "AAA", "INE1"), (d(2), "AAA", ""), (d(3), "AAX", "INE1"), (d(4), "AAX", ""),  # renamed
        (d(5), "AAA", "INE9"), (d(6), "AAA", ""),  # the symbol is taken over
        (d(1), "BBB", ""), (d(2), "BBB", "INE2"), (d(3), "DDD", ""), (d(6), "EEE", "INE5"), (d(2), "FFF", "INE6"),
    ], "date date, symbol string, isin string")
    intervals = identity.symbol_intervals(rows)
    assert sorted((r.symbol, r.isin, r.valid_from.day, r.valid_to and r.valid_to.day) for r in intervals.collect() if r.symbol == "AAA") == [
        ("AAA", "INE1", 1, 4), ("AAA", "INE9", 5, None)]
    resolved = identity.resolve_over_time(rows, intervals)
    got = {(r.date.day, r.symbol): r.provider_id for r in resolved.collect()}
    assert got[(2, "AAA")] == "INE1" and got[(6, "AAA")] == "INE9" and got[(1, "BBB")] == "INE2" and got[(3, "DDD")] == "NSE:DDD"
    old = spark.createDataFrame([
        ("INE1", "AAA", "A", "NSE", True, None, None), ("NSE:BBB", "BBB", "B", "NSE", True, None, None), ("INE3", "CCC", "C", "NSE", True, None, None),
        ("INE5", "EEE", "E", "NSE", False, d(5), "Unknown"), ("INE6", "FFF", "F", "NSE", False, d(5), "Merger"), ("NSE:AAX", "AAX", "twin", "NSE", True, None, None),
    ], "provider_id string, ticker string, name string, exchange string, is_active boolean, delisted_date date, delisting_reason string")
    got = {r.provider_id: (r.ticker, r.is_active, r.delisted_date, r.change) for r in identity.reconcile_securities(old, resolved, intervals).collect()}
    assert got == {
        "INE1": ("AAX", True, None, "renamed"), "INE9": ("AAA", True, None, "inserted"), "INE2": ("BBB", True, None, "identified"),
        "INE3": ("CCC", True, None, "untouched"), "NSE:DDD": ("DDD", True, None, "inserted"), "INE5": ("EEE", True, None, "reactivated"),
        "INE6": ("FFF", False, d(5), "seen"), "NSE:AAX": ("AAX", True, None, "untouched")}
    (change,) = identity.ticker_change_rows(identity.ticker_history(resolved)).collect()
    assert (change.provider_id, change.effective_date, change.new_ticker) == ("INE1", d(3), "AAX")
