from __future__ import annotations

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from pointpanel.sources import eod_files, provider_files, sinks, snapshots
from pointpanel.streaming.daily_ingest import corrections_path, run_ingest

LEGACY = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,LAST,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,TOTALTRADES,ISIN"
FULL = "SYMBOL, SERIES, DATE1, PREV_CLOSE, OPEN_PRICE, HIGH_PRICE, LOW_PRICE, CLOSE_PRICE, TTL_TRD_QNTY"
UDIFF = "TradDt,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,PrvsClsgPric,TtlTradgVol,ISIN"


def land(folder):
    (folder / "cm03JAN2020bhav.csv").write_text(
        LEGACY + "\nAAA,EQ,1,2,0.5,1.5,1.5,1.4,100,150,03-JAN-2020,7,INE1\nBOND,GS,1,1,1,1,1,1,1,1,03-JAN-2020,1,INE9\n"
        "BAD,EQ,x,2,1,1,1,1,1,1,03-JAN-2020,1,INE8\n\"B, Co\",be,2,2,2,2,2,0,5,10,03-JAN-2020,1,INE2\ntrailer\n")
    (folder / "sec_06012020.csv").write_text(FULL + "\nAAA, EQ, 06-Jan-2020, 1.5, 1.6, 1.7, 1.5, 1.65, 200\n")
    with zipfile.ZipFile(folder / "day20200107.csv.zip", "w") as z:
        z.writestr("day.csv", UDIFF + "\n2020-01-07,AAA,EQ,1.6,1.7,1.5,1.7,1.65,300,INE1\n")


def test_three_layouts(spark, tmp_path):
    land(tmp_path)
    (tmp_path / "plain").mkdir()
    for f in tmp_path.glob("*.csv"):
        f.rename(tmp_path / "plain" / f.name)
    lines = eod_files.read_lines(spark, str(tmp_path / "plain"))
    got = {(r.symbol, r.date.day): (r.isin, r.series, r.close, r.prev_close, r.volume) for r in eod_files.parse_eod(lines).collect()}
    assert got == {
        ("AAA", 3): ("INE1", "EQ", 1.5, 1.4, 100), ("B, Co", 3): ("INE2", "BE", 2.0, None, 5), ("AAA", 6): ("", "EQ", 1.65, 1.5, 200),
    }
    zipped = eod_files.parse_eod(eod_files.read_archives(spark, str(tmp_path))).collect()
    assert [(r.symbol, r.date, r.close, r.isin) for r in zipped] == [("AAA", dt.date(2020, 1, 7), 1.7, "INE1")]


def test_archives_are_unpacked_once_and_read_as_plain_files(spark, tmp_path):
    for i, text in enumerate([UDIFF + "\n2020-01-07,AAA,EQ,1.6,1.7,1.5,1.7,1.65,300,INE1\n", "no header\n1,2,3\n",
                              FULL + "\n\"A, Co\", EQ, 06-Jan-2020, 1.5, 1.6, 1.7, 1.5, 1.65, 200\nshort,EQ\n"]):
        with zipfile.ZipFile(tmp_path / f"{i}.csv.zip", "w") as z:
            z.writestr("day.csv", text)
            z.writestr("readme.txt", UDIFF)
    archives = spark.read.format("binaryFile").load(str(tmp_path))
    found = eod_files.parse_archives(archives)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, eod_files.parse_eod(eod_files.unzip_lines(archives)).collect()))
    assert sorted(r.symbol for r in found.collect()) == ["A, Co", "AAA"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_a_line_is_split_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text(UDIFF + "\n2020-01-07,AAA,EQ,1.6,1.7,1.5,1.7,1.65,300,INE1\n")
    rows = eod_files.parse_eod(eod_files.read_lines(spark, str(tmp_path)))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(value") == 1


def test_a_first_load_is_written_once_and_its_sequence_carried_once(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("A", 1, 1.0, None, "a"), ("A", 1, 2.0, "x", "b"), ("B", 1, 3.0, "y", "a")], "k string, d int, v double, w string, file string")
    last = sinks.latest_rows(rows.withColumn("_seq", F.struct("file")).drop("file"), ["k", "d"], "_seq")
    assert last._jdf.queryExecution().optimizedPlan().toString().count("max_by(") == 1
    writes = []
    monkeypatch.setattr(sinks, "stored", lambda df, label: writes.append(label) or df.localCheckpoint())
    path = str(tmp_path / "t")
    sinks.upsert(spark, path, last, ["k", "d"], F.col("d"))
    assert not writes and sorted(map(tuple, sinks.read_table(spark, path).collect())) == [("A", 1, 2.0, "x"), ("B", 1, 3.0, "y")]


def test_an_ingest_moves_its_rows_once_and_keeps_no_lines(spark, tmp_path, monkeypatch):
    """Headers go to the lines, and rows go straight to where the table wants them."""
    from pointpanel.streaming import daily_ingest

    for k, close in enumerate((1.65, 1.7)):
        (tmp_path / f"{k}.csv").write_text(FULL + f"\nAAA, EQ, 06-Jan-2020, 1.5, 1.6, 1.7, 1.5, {close}, 200\n")
    plans, kept = [], sinks.upsert
    monkeypatch.setattr(daily_ingest, "TASK_ROWS", 1)
    monkeypatch.setattr(sinks, "upsert", lambda spark, path, load, *more, **named: (
        plans.append(load._jdf.queryExecution().executedPlan().toString()), kept(spark, path, load, *more, **named)))
    bars = str(tmp_path.parent / f"{tmp_path.name}-bars")
    daily_ingest.ingest_batch(spark, eod_files.read_lines(spark, str(tmp_path)), bars, str(tmp_path / "manifest"))
    assert plans[0].count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plans[0] and "InMemoryTableScan" not in plans[0]
    assert {(r.symbol, str(r.date)): r.close for r in sinks.read_table(spark, bars).collect()}[("AAA", "2020-01-06")] == 1.7


def test_layouts_of_all_files_come_from_one_pass(spark):
    full = [(f, line) for f in ("a", "b") for line in (FULL + "\nMYSYMBOL, EQ, 06-Jan-2020, 1, 1, 1, 1, 1, 2").split("\n")]
    lines = spark.createDataFrame([*full, ("c", "SYMBOL,ELSE"), ("c", "1,2"), ("d", None)], "file string, value string")
    got = {r.file: (r.lines, r.n) for r in eod_files.layouts(lines).collect()}
    want = {r.file: r.n for r in eod_files.headers(lines).collect()}
    assert {f: n for f, (_, n) in got.items() if n is not None} == want and want.keys() == {"a", "b"}
    assert {r.file for r in eod_files.unknown_layouts(lines).collect()} == {"c", "d"} and got["c"] == (2, None) and got["d"] == (1, None)


def test_one_file_per_day_identifier_layout_first(spark, tmp_path):
    land(tmp_path)
    (tmp_path / "sec_03012020.csv").write_text(FULL)
    got = {str(r.date): r.path.rsplit("/", 1)[1] for r in eod_files.pick_files(eod_files.list_files(spark, str(tmp_path))).collect()}
    assert got == {"2020-01-03": "cm03JAN2020bhav.csv", "2020-01-06": "sec_06012020.csv", "2020-01-07": "day20200107.csv.zip"}


def test_streamed_ingest_takes_each_file_once_and_refuses_unknown_layouts(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    paths = [str(tmp_path / x) for x in ("bars", "manifest", "checkpoint")]
    (inbox / "a.csv").write_text(FULL + "\nAAA, EQ, 06-Jan-2020, 1.5, 1.6, 1.7, 1.5, 1.65, 200\n")
    run_ingest(spark, str(inbox), *paths)
    (inbox / "b.csv").write_text(FULL + "\nAAA, EQ, 06-Jan-2020, 1.5, 1.6, 1.7, 1.5, 1.99, 200\nAAA, EQ, 07-Jan-2020, 1, 1, 1, 1, 1, 1\n")
    run_ingest(spark, str(inbox), *paths)
    run_ingest(spark, str(inbox), *paths)
    rows = {r.date.day: r.close for r in sinks.read_table(spark, paths[0]).collect()}
    assert rows == {6: 1.99, 7: 1.0}
    assert sorted(r.as_of_date.day for r in snapshots.read_manifest(spark, paths[1]).collect()) == [6, 7]
    (inbox / "c.csv").write_text("WHAT,IS,THIS\n1,2,3\n")
    with pytest.raises(Exception, match="unknown layout"):
        run_ingest(spark, str(inbox), *paths)


def test_late_files_leave_a_trace_and_identified_rows_stay(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    paths = [str(tmp_path / x) for x in ("bars", "manifest", "checkpoint")]
    legacy = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,PREVCLOSE,TOTTRDQTY,TIMESTAMP,ISIN\n"
    (inbox / "a.csv").write_text(legacy + "AAA,EQ,1,2,1,2,1,10,03-JAN-2020,INE1\nBBB,EQ,1,2,1,2,1,10,03-JAN-2020,\n")
    run_ingest(spark, str(inbox), *paths)
    (inbox / "b.csv").write_text(legacy + "AAA,EQ,1,2,1,9,1,10,03-JAN-2020,\nBBB,EQ,1,2,1,3,1,10,03-JAN-2020,INE2\n")
    run_ingest(spark, str(inbox), *paths)
    rows = {r.symbol: (r.close, r.isin) for r in sinks.read_table(spark, paths[0]).collect()}
    assert rows == {"AAA": (2.0, "INE1"), "BBB": (3.0, "INE2")}
    log = spark.read.parquet(corrections_path(paths[0])).collect()
    assert [(r.symbol, r.close_before, r.close) for r in log] == [("BBB", 2.0, 3.0)]


def test_a_day_over_several_batches_is_sealed_once_with_the_count_of_the_table(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    paths = [str(tmp_path / x) for x in ("bars", "manifest", "checkpoint")]
    for k in range(3):
        (inbox / f"{k}.csv").write_text(FULL + f"\nS{k}, EQ, 06-Jan-2020, 1.5, 1.6, 1.7, 1.5, 1.65, 200\n")
    run_ingest(spark, str(inbox), *paths, files=1)
    n = sinks.read_table(spark, paths[0]).count()
    assert n >= 3 and [r.price_row_count for r in snapshots.read_manifest(spark, paths[1]).where("as_of_date = '2020-01-06'").collect()] == [n]


def test_quotes_are_removed_from_rows_and_headers(spark, tmp_path):
    header = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,PREVCLOSE,TOTTRDQTY,TIMESTAMP,ISIN"
    quote = lambda line: ",".join(f'"{c}"' for c in line.split(","))
    (tmp_path / "q.csv").write_text("\n".join([
        quote(header), quote("AAA,EQ,1,2,1,2,1,10,03-JAN-2020,INE1"), '"BBB",EQ,1,2,1,2,1,"1",03-JAN-2020,INE2',
        'CCC,EQ,1,2,1,2,1,10,03-JAN-2020,INE3']) + "\n")
    lines = eod_files.read_lines(spark, str(tmp_path))
    assert eod_files.unknown_layouts(lines).isEmpty()
    got = sorted((r.symbol, r.isin, r.close) for r in eod_files.parse_eod(lines).collect())
    assert got == [("AAA", "INE1", 2.0), ("BBB", "INE2", 2.0), ("CCC", "INE3", 2.0)]


def test_a_run_counts_all_results_and_keeps_its_limit_of_members(spark):
    members = spark.createDataFrame([(1, k, k) for k in range(1, 8)], "run long, security_id long, rank int")
    row = sinks.members_json(members, ["run"], 3).first()
    assert row["result_count"] == 7 and row["members_json"] == '[{"security_id":1},{"security_id":2},{"security_id":3}]'


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from pointpanel.session import shared_root

    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://m:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_delistings_found_earlier_stay(spark):
    from pointpanel.operators.identity import detect_delistings

    day = lambda d: dt.date(2020, 1, 1) + dt.timedelta(d)
    bars = spark.createDataFrame([(1, day(0)), (2, day(200)), (3, day(10))], "security_id long, date date")
    known = spark.createDataFrame([(1, False, day(5), "Merger"), (2, True, None, None), (3, True, None, None)],
                                  "security_id long, is_active boolean, delisted_date date, delisting_reason string")
    once = detect_delistings(known, bars)
    rows = lambda f: {r["security_id"]: (r["is_active"], r["delisted_date"], r["delisting_reason"]) for r in f.collect()}
    assert rows(once) == {1: (False, day(5), "Merger"), 2: (True, None, None), 3: (False, day(10), "Unknown")}
    assert rows(detect_delistings(once, bars)) == rows(once)


def test_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    cols = "security_id long, date date, close double"
    first = spark.createDataFrame([(1, dt.date(2019, 5, 1), 1.0), (1, dt.date(2020, 5, 1), 2.0)], cols)
    sinks.upsert(spark, path, first, ["security_id", "date"], F.year("date"))
    kept = sorted(p.name for p in (tmp_path / "t" / "_part=2019").glob("*.parquet"))
    load = spark.createDataFrame([(1, dt.date(2020, 5, 1), 3.0), (2, dt.date(2020, 5, 1), 4.0)], cols)
    for _ in range(2):
        sinks.upsert(spark, path, load, ["security_id", "date"], F.year("date"))
    assert sorted(r.close for r in sinks.read_table(spark, path).collect()) == [1.0, 3.0, 4.0]
    assert sorted(p.name for p in (tmp_path / "t" / "_part=2019").glob("*.parquet")) == kept


def test_unchanged_filing_writes_no_version(spark):
    d, end = dt.date(2020, 1, 1), dt.date(9999, 12, 31)
    cur = spark.createDataFrame([(1, 5.0, d, end), (2, None, d, end)], "k long, revenue double, valid_from date, valid_to date")
    new = spark.createDataFrame([(1, 6.0), (2, None), (3, 7.0)], "k long, revenue double")
    out = sorted((r.k, r.revenue, r.valid_to == end) for r in sinks.versioned(cur, new, ["k"], ["revenue"], "2020-06-01").collect() if r.k != 2)
    assert out == [(1, 5.0, False), (1, 6.0, True), (3, 7.0, True)]
    assert sinks.versioned(cur, new, ["k"], ["revenue"], "2020-06-01").filter("k = 2").count() == 1


def test_seal_refuses_empty_and_repeated_snapshots(spark, tmp_path):
    row = lambda n: spark.createDataFrame([(1, dt.date(2020, 1, 1), n)], "snapshot_id long, as_of_date date, price_row_count long")
    path = str(tmp_path / "m")
    with pytest.raises(ValueError, match="without price rows"):
        snapshots.seal(spark, path, row(0))
    snapshots.seal(spark, path, row(5))
    with pytest.raises(ValueError, match="already sealed"):
        snapshots.seal(spark, path, row(5))


def test_annual_statement_wins_over_interim(spark):
    doc = """{"financials":[{"Type":"Interim","EndDate":"2026-03-31","stockFinancialMap":{"INC":[{"key":"Revenue","value":"1"}]}},
      {"Type":"Annual","EndDate":"2026-03-31","stockFinancialMap":{"INC":[{"key":"REVENUE","value":"4"}]}},
      {"Type":"Annual","EndDate":"2025-03-31","stockFinancialMap":{"INC":[{"key":"Other","value":"4"}]}}]}"""
    df = spark.createDataFrame([(1, doc), (2, "{}"), (3, "not json")], "security_id long, json string")
    rows = provider_files.parse_fundamentals(df).collect()
    assert [(r.security_id, r.revenue, str(r.reported_date)) for r in rows] == [(1, 4.0, "2026-05-30")]
    assert provider_files.parse_actions(df).collect() == []


def test_benchmark_file_without_rows_is_refused(spark, tmp_path):
    (tmp_path / "i.csv").write_text("Date,Close\nx,y\n")
    with pytest.raises(ValueError):
        provider_files.require_rows(provider_files.read_benchmark(spark, str(tmp_path), "I"))
