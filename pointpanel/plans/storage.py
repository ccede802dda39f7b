"""Registered queries: file sources, idempotent sinks, snapshots, logs and streams."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointpanel.fixtures import Fixtures
from pointpanel.functions.rounding import half_up
from pointpanel.functions.vocabulary import DEFAULT_LIMIT
from pointpanel.operators import calendar, concepts, series
from pointpanel.plans import screens
from pointpanel.plans.oracle_views import rnd, with_views
from pointpanel.session import scratch_path, stored
from pointpanel.sources import eod_files, loads, provider_files, sinks, snapshots
from pointpanel.streaming import daily_bars, daily_ingest

# --- daily files -----------------------------------------------------------------------------------------------------


def eod_rows(fx: Fixtures) -> DataFrame:
    """Bars as file rows: most are equity, every ninth security is of another series."""
    sid = F.col("security_id")
    return fx.bars.select(
        F.concat(F.lit("S"), sid.cast("string")).alias("symbol"),
        F.when(sid % 9 == 0, "GB").when(sid % 2 == 0, "EQ").otherwise("be").alias("series"),
        "open", "high", "low", "close", (F.col("close") * 0.5).alias("prev_close"), "volume", "date",
        F.concat(F.lit("INE"), sid.cast("string")).alias("isin"),
    )


def write_eod(fx: Fixtures, root: str) -> None:
    """The bars as csv files of all three layouts, by year; one file per layout also holds an unreadable row."""
    y = F.year("date")
    parts = {"legacy": y < 1998, "udiff": (y >= 1998) & (y < 2000), "full": y >= 2000}
    formats = {"legacy": "dd-MMM-yyyy", "udiff": "yyyy-MM-dd", "full": "dd-MMM-yyyy"}
    rows = eod_rows(fx.with_stored_bars())
    for layout, mine in parts.items():
        names = eod_files.LAYOUTS[layout]
        pad = " " if layout == "full" else ""
        d = F.date_format("date", formats[layout])
        text = {f: F.col(f).cast("string") for f in eod_files.FIELDS} | {"date": F.upper(d) if layout == "legacy" else d}
        good = rows.filter(mine).select(*[F.concat(F.lit(pad), text[f]).alias(n) for f, n in zip(eod_files.FIELDS, names) if n])
        bad = good.limit(1).withColumn(names[2], F.lit("n/a"))
        good.unionByName(bad).write.options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}).option("header", "true").option(
            "ignoreLeadingWhiteSpace", "false").csv(f"{root}/{layout}")


def q_src_eod_csv(spark, sf):
    root = scratch_path(spark, "eod")
    write_eod(Fixtures(spark, sf), root)
    return eod_files.parse_eod(eod_files.read_lines(spark, root))


def q_src_archive_discovery(spark, sf):
    """Three naming styles per trading day, not all of them present every day."""
    d = calendar.trading_days(Fixtures(spark, sf).bars)
    names = F.array_compact(F.array(
        F.when(F.dayofmonth("date") % 3 == 0, F.concat(F.lit("a/cm"), F.upper(F.date_format("date", "ddMMMyyyy")), F.lit("bhav.csv"))),
        F.when(F.dayofmonth("date") % 2 == 0, F.concat(F.lit("b/full_"), F.date_format("date", "ddMMyyyy"), F.lit(".csv"))),
        F.concat(F.lit("c/day"), F.date_format("date", "yyyyMMdd"), F.lit(".csv.zip")),
        F.lit("c/readme.txt"),
    ))
    return eod_files.pick_files(d.select(F.explode(names).alias("path")))


def zipped(fx: Fixtures) -> DataFrame:
    """(path, content): one zip per security and year, as a binary file source would deliver them."""

    names = eod_files.LAYOUTS["legacy"]

    def pack(batches):
        for batch in batches:
            paths, contents = batch.column("path").to_pylist(), []
            for text in batch.column("text"):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
                    z.writestr("day.csv", text.as_py())
                contents.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    # The text is put together where the rows are; a worker only packs it.
    text = [F.date_format("date", "dd-MMM-yyyy") if f == "date" else F.col(f).cast("string") for f in eod_files.FIELDS]
    days = eod_rows(fx).groupBy("symbol", F.year("date").alias("year")).agg(
        F.sort_array(F.collect_list(F.struct("date", F.concat_ws(",", *text).alias("line")))).alias("days"))
    whole = F.concat(F.lit(",".join(names) + "\n"), F.array_join("days.line", "\n"))
    return days.select(F.concat("symbol", F.lit("-"), "year", F.lit(".csv.zip")).alias("path"), whole.alias("text")).mapInArrow(
        pack, "path string, content binary")


def q_src_archive_zip(spark, sf):
    rows = eod_files.parse_archives(zipped(Fixtures(spark, sf)))
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("close").alias("high_close"), F.sum("volume").alias("volume")
    )


def q_src_benchmark_csv(spark, sf):
    root = scratch_path(spark, "benchmark")
    b = Fixtures(spark, sf).benchmark
    d = F.when(F.dayofmonth("date") % 2 == 0, F.date_format("date", "dd-MMM-yyyy")).otherwise(F.date_format("date", "yyyy-MM-dd"))
    d = F.when(F.dayofmonth("date") == 9, F.lit("not a date")).otherwise(d)
    b.select(d.alias("Date"), F.col("total_return_index_value").cast("string").alias("Close")).write.option("header", "true").csv(root)
    out = provider_files.require_rows(provider_files.read_benchmark(spark, root, "MKT"))
    return out.withColumn("total_return_index_value", half_up("total_return_index_value", 6))


# --- provider documents ----------------------------------------------------------------------------------------------


def action_documents(fx: Fixtures) -> DataFrame:
    """One nested document per security."""
    key = {"bonus": "xbDate", "splits": "exDate", "rights": "recordDate", "dividend": "xdDate"}
    arrays = []
    for name, kind in provider_files.ACTION_ARRAYS.items():
        item = F.struct(
            F.col("effective_date").cast("string").alias(key[name]), F.col("raw_description").alias("remarks"),
            F.col("dividend_amount").cast("string").alias("value"),
        )
        arrays.append(F.collect_list(F.when(F.col("action_type") == kind, item)).alias(name))
    return fx.actions.groupBy("security_id").agg(*arrays).select(
        "security_id",
        F.to_json(F.struct(F.struct(*provider_files.ACTION_ARRAYS).alias("stockCorporateActionData"))).alias("json"),
    )


def q_src_actions_json(spark, sf):
    return provider_files.parse_actions(action_documents(Fixtures(spark, sf)))


def fundamental_documents(fx: Fixtures) -> DataFrame:
    """Per security its annual statements, an interim one sharing each period end, and a repeated annual one."""
    def pair(key, value):
        return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))

    def statement(kind, scale):
        s = lambda c: F.col(c) * scale
        return F.struct(
            F.lit(kind).alias("Type"), F.col("fiscal_period_end").cast("string").alias("EndDate"),
            F.struct(
                F.array(pair("totalrevenue", s("revenue")), pair("NetIncomeAfterTaxes", s("net_income")),
                        pair("DilutedWeightedAverageShares", s("shares_outstanding")), pair("CostofRevenueTotal", s("cost_of_revenue"))).alias("INC"),
                F.array(pair("TotalDebt", F.lit("n/a")), pair("LongTermDebt", s("total_debt")), pair("TotalEquity", s("shareholders_equity"))).alias("BAL"),
            ).alias("stockFinancialMap"),
        )

    three = F.array(statement("Interim", 0.25), statement("Annual", 1.0), statement("Annual", 2.0))
    return fx.fundamentals_v2.groupBy("security_id").agg(F.flatten(F.collect_list(three)).alias("financials")).select(
        "security_id", F.to_json(F.struct("financials")).alias("json")
    )


def q_src_fundamentals_json(spark, sf):
    return provider_files.parse_fundamentals(fundamental_documents(Fixtures(spark, sf)))


# --- sinks -----------------------------------------------------------------------------------------------------------

CHANGED_FROM = "2001-06-01"


def _load(df: DataFrame, key: str, value: str) -> DataFrame:
    """A later load: revised rows of the last months, and rows of securities not seen before."""
    late = df.filter(F.col("date") >= F.lit(CHANGED_FROM).cast("date")).withColumn(value, F.col(value) * 2)
    new = df.filter(F.col(key) % 7 == 0).withColumn(key, F.col(key) + 1000000000)
    return late.unionByName(new)


def _twice(spark, table: DataFrame, load: DataFrame, keys: list[str], day: str, label: str, yearly: bool = False) -> DataFrame:
    """The table after a load that ran twice, with a load that failed half-way in between, folded at the end."""
    path = scratch_path(spark, label)
    n = load.count()
    loads.append(table, path, keys, F.col(day), yearly=yearly, count=table.count())
    loads.append(load, path, keys, F.col(day), yearly=yearly, count=n)
    _, lost = loads.begin(spark, path)
    loads.put(load.limit(10), path, lost, "rows", keys, F.col(day), yearly=yearly)  # never sealed
    loads.append(load, path, keys, F.col(day), yearly=yearly, count=n)
    loads.fold(spark, path, {"rows": (keys, F.col(day), yearly)})
    return loads.read(spark, path, "rows", keys)


def q_sink_bars_upsert(spark, sf):
    bars = Fixtures(spark, sf).with_stored_bars().bars.select("security_id", "date", "close", "volume")
    return _twice(spark, bars, _load(bars, "security_id", "close"), ["security_id", "date"], "date", "bars")


def q_sink_indicators_upsert(spark, sf):
    bars = series.numbered(Fixtures(spark, sf).bars)
    ind = series.rolling_mean(bars, "close", 50, "sma50").select("security_id", "date", half_up("sma50", 4).alias("sma50"))
    ind = stored(ind, "indicators")
    return _twice(spark, ind, _load(ind, "security_id", "sma50"), ["security_id", "date"], "date", "indicators")


def q_sink_benchmark_upsert(spark, sf):
    b = stored(Fixtures(spark, sf).benchmark.withColumn("total_return_index_value", half_up("total_return_index_value", 6)), "benchmark")
    load = b.filter(F.col("date") >= F.lit(CHANGED_FROM).cast("date")).withColumn("total_return_index_value", F.lit(1.0))
    return _twice(spark, b, load, ["ticker", "date"], "date", "benchmark", yearly=True)


def q_sink_ratios_upsert(spark, sf):
    r = stored(screens.ratios_of(Fixtures(spark, sf)).select("security_id", "reported_date", half_up("pb", 6).alias("pb")), "ratios")
    load = r.filter(F.year("reported_date") == 2001).withColumn("pb", F.lit(0.5))
    return _twice(spark, r, load, ["security_id", "reported_date"], "reported_date", "ratios", yearly=True)


def q_sink_actions_insert_new(spark, sf):
    """The second load repeats part of the first and lists its own rows twice."""
    a = Fixtures(spark, sf).actions.select("security_id", "effective_date", "action_type", "dividend_amount")
    first = a.filter(F.col("security_id") % 2 == 0)
    load = a.filter(F.col("security_id") % 3 == 0).withColumn("_seq", F.lit(1))
    again = load.withColumns({"_seq": F.lit(2), "dividend_amount": F.lit(-1.0)})
    keys = ["security_id", "effective_date", "action_type"]
    return sinks.insert_new(first, load.unionByName(again), keys, "_seq")


MEASURES = ["revenue", "net_income", "total_debt", "shareholders_equity", "shares_outstanding", "cost_of_revenue"]
LOADED = "2002-06-30"


def q_sink_fundamentals_scd2(spark, sf):
    fx = Fixtures(spark, sf)
    current = fx.fundamentals_v1.withColumns(
        {"valid_from": F.col("reported_date"), "valid_to": F.lit("9999-12-31").cast("date")}
    )
    out = sinks.versioned(current, fx.fundamentals_v2, ["security_id", "fiscal_period_end"], MEASURES, LOADED)
    return out.select("security_id", "fiscal_period_end", "revenue", "valid_from", "valid_to")


# --- snapshots and logs ----------------------------------------------------------------------------------------------


def q_snapshot_seal(spark, sf):
    """A year of bars per snapshot; even years are sealed, the others stay invisible."""
    data_path, manifest = scratch_path(spark, "data"), scratch_path(spark, "manifest")
    bars = Fixtures(spark, sf).bars
    bars.select("security_id", "date", "close", F.year("date").cast("long").alias("snapshot_id")).write.partitionBy("snapshot_id").parquet(data_path)
    data = spark.read.parquet(data_path).withColumn("snapshot_id", F.col("snapshot_id").cast("long"))
    counts = data.filter(F.col("snapshot_id") % 2 == 0).groupBy("snapshot_id").agg(
        F.max("date").alias("as_of_date"), F.count(F.lit(1)).alias("price_row_count")
    ).withColumn("provider_version", F.concat(F.lit("eod-"), F.col("snapshot_id").cast("string")))
    snapshots.seal(spark, manifest, counts)
    seen = snapshots.sealed_rows(data, snapshots.read_manifest(spark, manifest))
    rows = seen.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last_date"))
    fields = snapshots.read_manifest(spark, manifest).filter("sealed_at IS NOT NULL AND created_at IS NOT NULL").select(
        "snapshot_id", "as_of_date", "price_row_count", "fundamental_row_count", "provider_version")
    return rows.join(fields, "snapshot_id")


def q_snapshot_latest_sealed(spark, sf):
    fx = Fixtures(spark, sf)
    return calendar.latest_sealed(fx.snapshots, fx.orders_dates, "order_date")


def q_snapshot_seal_history(spark, sf):
    """The unsealed days of five years, sealed in one write and read back from the manifest."""
    fx, manifest = Fixtures(spark, sf), scratch_path(spark, "manifest")
    snapshots.seal_history(spark, manifest, fx.bars, fx.snapshots, "1996-01-01", "2000-12-31", provider_version=F.lit("eod-1"))
    return snapshots.read_manifest(spark, manifest).select(
        F.col("as_of_date").alias("date"), "snapshot_id", "price_row_count", "fundamental_row_count", "provider_version",
        (F.col("sealed_at") >= F.col("created_at")).alias("in_order"))


def q_append_run_log(spark, sf):
    """Two appended batches of screen runs; only saved strategies keep their members."""
    path = scratch_path(spark, "runs")
    in_run = Window.partitionBy("strategy_id", "as_of_date").orderBy("security_id")
    ranked = screens.membership(Fixtures(spark, sf)).withColumn("rank", F.row_number().over(in_run))
    runs = sinks.members_json(ranked, ["strategy_id", "as_of_date"], DEFAULT_LIMIT).withColumn(
        "members_json", F.when(F.col("strategy_id") % 2 == 1, F.col("members_json"))
    )
    early = F.col("as_of_date") < F.lit("1999-07-01").cast("date")
    sinks.append_log(runs.filter(early), path)
    sinks.append_log(runs.filter(~early), path)
    return spark.read.parquet(path)


def q_json_roundtrip(spark, sf):
    """Event properties and saved criteria, read into columns and written again."""
    fx = Fixtures(spark, sf)
    parsed = F.from_json("props", "k long")
    events = fx.table("events").select(
        F.lit("event").alias("kind"), F.col("event_id").alias("id"), parsed["k"].alias("k"), F.get_json_object("props", "$.k").alias("k_text"),
        F.to_json(parsed).alias("json"))
    c = F.from_json("criteria_json", concepts.criteria_schema())
    children = c["root"]["children"]
    saved = screens.strategies(fx).select(
        F.lit("criteria").alias("kind"), F.col("strategy_id").alias("id"), F.size(children).cast("long").alias("k"), children[0]["field"].alias("k_text"),
        F.to_json(c).alias("json"))
    return events.unionByName(saved)


# --- streams ---------------------------------------------------------------------------------------------------------


def q_stream_daily_bars(spark, sf):
    out, checkpoint = scratch_path(spark, "ticks"), scratch_path(spark, "ticks-checkpoint")
    daily_bars.run_daily_bars(spark, sf, "events.parquet", out, checkpoint)
    return spark.read.parquet(out)


def q_stream_daily_ingest(spark, sf):
    root, table, manifest, checkpoint = [scratch_path(spark, x) for x in ("landing", "ingested", "manifest", "checkpoint")]
    write_eod(Fixtures(spark, sf), root)
    daily_ingest.run_ingest(spark, root, table, manifest, checkpoint, files=1000)
    rows = sinks.read_table(spark, table)
    days = snapshots.read_manifest(spark, manifest).select(F.col("as_of_date").alias("date"))
    return rows.join(days, "date", "left_semi").select("symbol", "date", "isin", "close", "volume")


QUERIES = {
    "src_eod_csv": q_src_eod_csv, "src_archive_discovery": q_src_archive_discovery, "src_archive_zip": q_src_archive_zip,
    "src_benchmark_csv": q_src_benchmark_csv, "src_actions_json": q_src_actions_json,
    "src_fundamentals_json": q_src_fundamentals_json, "sink_bars_upsert": q_sink_bars_upsert,
    "sink_indicators_upsert": q_sink_indicators_upsert, "sink_benchmark_upsert": q_sink_benchmark_upsert,
    "sink_ratios_upsert": q_sink_ratios_upsert, "sink_actions_insert_new": q_sink_actions_insert_new,
    "sink_fundamentals_scd2": q_sink_fundamentals_scd2, "snapshot_seal": q_snapshot_seal,
    "snapshot_latest_sealed": q_snapshot_latest_sealed, "snapshot_seal_history": q_snapshot_seal_history,
    "append_run_log": q_append_run_log, "json_roundtrip": q_json_roundtrip, "stream_daily_bars": q_stream_daily_bars,
    "stream_daily_ingest": q_stream_daily_ingest,
}


def v(body: str, **more: str) -> str:
    return with_views(body, **screens.X, **more)


_SYM = "concat('S', CAST(security_id AS VARCHAR)) AS symbol"
_EQ = "security_id % 9 <> 0"


def _upserted(src: str, key_cols: str, col: str, is_late: str, revised: str, extra: str = "") -> str:
    """Table after a load, by outer join and coalesce."""
    keys = [k.strip() for k in key_cols.split(",")]
    on = " AND ".join(f"o.{k} = n.{k}" for k in keys)
    ks = ", ".join(f"coalesce(n.{k}, o.{k}) AS {k}" for k in keys)
    load = f"SELECT * REPLACE ({revised} AS {col}) FROM {src} WHERE {is_late}{extra}"
    return f"SELECT {ks}, CASE WHEN n.{keys[0]} IS NULL THEN o.{col} ELSE n.{col} END AS {col} FROM {src} o FULL OUTER JOIN ({load}) n ON {on}"


_LATE = f"date >= DATE '{CHANGED_FROM}'"
_NEW = " UNION ALL SELECT * REPLACE (security_id + 1000000000 AS security_id) FROM {} WHERE security_id % 7 = 0"

ORACLES = {
    "src_eod_csv": v(
        f"SELECT {_SYM}, CASE WHEN year(date) >= 2000 THEN '' ELSE concat('INE', CAST(security_id AS VARCHAR)) END AS isin, "
        "CASE WHEN security_id % 2 = 0 THEN 'EQ' ELSE 'BE' END AS series, date, open, high, low, close, close * 0.5 AS prev_close, volume "
        f"FROM fx_bars WHERE {_EQ}"),
    "src_archive_discovery": v(
        "SELECT date, CASE WHEN day(date) % 3 = 0 THEN concat('a/cm', upper(strftime(date, '%d%b%Y')), 'bhav.csv') "
        "WHEN day(date) % 2 = 0 THEN concat('b/full_', strftime(date, '%d%m%Y'), '.csv') "
        "ELSE concat('c/day', strftime(date, '%Y%m%d'), '.csv.zip') END AS path FROM (SELECT DISTINCT date FROM fx_bars) t"),
    "src_archive_zip": v(f"SELECT {_SYM}, count(*) AS n, min(date) AS first, max(close) AS high_close, CAST(sum(volume) AS BIGINT) AS volume "
                         f"FROM fx_bars WHERE {_EQ} GROUP BY security_id"),
    "src_benchmark_csv": v(f"SELECT ticker, date, {rnd('total_return_index_value')} AS total_return_index_value FROM fx_benchmark WHERE day(date) <> 9"),
    "src_actions_json": v(
        "SELECT security_id, effective_date, action_type, CASE action_type WHEN 'Split' THEN (1 + security_id % 5) / 10::DOUBLE "
        "WHEN 'Bonus' THEN (1 + security_id % 3) / (2 + security_id % 3)::DOUBLE END AS adjustment_factor, dividend_amount, raw_description FROM fx_actions"),
    "src_fundamentals_json": v(
        "SELECT security_id, fiscal_period_end, reported_date, true AS is_reported_date_estimated, revenue, net_income, total_debt, shareholders_equity, "
        "shares_outstanding, cost_of_revenue FROM fx_fundamentals_v2"),
    "sink_bars_upsert": v(
        "SELECT coalesce(n.security_id, o.security_id) AS security_id, coalesce(n.date, o.date) AS date, coalesce(n.close, o.close) AS close, "
        f"coalesce(n.volume, o.volume) AS volume FROM fx_bars o FULL OUTER JOIN (SELECT security_id, date, close * 2 AS close, volume FROM fx_bars WHERE {_LATE} "
        "UNION ALL SELECT security_id + 1000000000, date, close, volume FROM fx_bars WHERE security_id % 7 = 0) n ON o.security_id = n.security_id AND o.date = n.date"),
    "sink_indicators_upsert": v(
        _upserted("fx_sma", "security_id, date", "sma50", _LATE, "sma50 * 2", _NEW.format("fx_sma")),
        fx_sma="SELECT security_id, date, CASE WHEN row_number() OVER (PARTITION BY security_id ORDER BY date) >= 50 THEN "
               + rnd("avg(close) OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)", 4) + " END AS sma50 FROM fx_bars"),
    "sink_benchmark_upsert": v(f"SELECT ticker, date, CASE WHEN {_LATE} THEN 1 ELSE {rnd('total_return_index_value')} END AS total_return_index_value FROM fx_benchmark"),
    "sink_ratios_upsert": v(f"SELECT security_id, reported_date, CASE WHEN year(reported_date) = 2001 THEN 0.5::DOUBLE ELSE {rnd('pb')} END AS pb FROM fx_ratios"),
    "sink_actions_insert_new": v("SELECT security_id, effective_date, action_type, dividend_amount FROM fx_actions a WHERE security_id % 3 = 0 AND NOT EXISTS "
                                 "(SELECT 1 FROM fx_actions b WHERE b.security_id % 2 = 0 AND b.security_id = a.security_id AND b.effective_date = a.effective_date "
                                 "AND b.action_type = a.action_type)"),
    "sink_fundamentals_scd2": v(
        f"SELECT a.security_id, a.fiscal_period_end, a.revenue, a.reported_date AS valid_from, CASE WHEN b.security_id IS NOT NULL AND (a.revenue, a.net_income, a.total_debt, "
        f"a.shareholders_equity, a.shares_outstanding, a.cost_of_revenue) IS DISTINCT FROM (b.revenue, b.net_income, b.total_debt, b.shareholders_equity, b.shares_outstanding, "
        f"b.cost_of_revenue) THEN DATE '{LOADED}' ELSE DATE '9999-12-31' END AS valid_to FROM fx_fundamentals_v1 a LEFT JOIN fx_fundamentals_v2 b USING (security_id, fiscal_period_end) "
        f"UNION ALL SELECT b.security_id, b.fiscal_period_end, b.revenue, DATE '{LOADED}', DATE '9999-12-31' FROM fx_fundamentals_v2 b LEFT JOIN fx_fundamentals_v1 a "
        "USING (security_id, fiscal_period_end) WHERE a.security_id IS NULL OR (a.revenue, a.net_income, a.total_debt, a.shareholders_equity, a.shares_outstanding, "
        "a.cost_of_revenue) IS DISTINCT FROM (b.revenue, b.net_income, b.total_debt, b.shareholders_equity, b.shares_outstanding, b.cost_of_revenue)"),
    "snapshot_seal": v("SELECT year(date) AS snapshot_id, count(*) AS n, max(date) AS last_date, max(date) AS as_of_date, count(*) AS price_row_count, "
                       "CAST(0 AS BIGINT) AS fundamental_row_count, concat('eod-', CAST(year(date) AS VARCHAR)) AS provider_version FROM fx_bars WHERE year(date) % 2 = 0 GROUP BY 1"),
    "snapshot_latest_sealed": v("SELECT o.d AS order_date, s.as_of_date, s.snapshot_id FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) o "
                                "ASOF LEFT JOIN (SELECT * FROM fx_snapshots WHERE sealed_at IS NOT NULL) s ON o.d >= s.as_of_date"),
    "snapshot_seal_history": v("SELECT date, CAST(date - DATE '1970-01-01' AS BIGINT) AS snapshot_id, count(*) AS price_row_count, "
                               "CAST(0 AS BIGINT) AS fundamental_row_count, 'eod-1' AS provider_version, true AS in_order FROM fx_bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND date NOT IN "
                               "(SELECT as_of_date FROM fx_snapshots WHERE sealed_at IS NOT NULL) GROUP BY 1"),
    "append_run_log": v(
        "SELECT strategy_id, as_of_date, count(*) AS result_count, CASE WHEN strategy_id % 2 = 1 THEN concat('[', string_agg(concat('{\"security_id\":', security_id, '}'), ',' "
        "ORDER BY security_id) FILTER (WHERE rank <= 200), ']') END AS members_json FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id, as_of_date "
        "ORDER BY security_id) AS rank FROM fx_members) t GROUP BY 1, 2"),
    "json_roundtrip": v(
        "SELECT 'event' AS kind, event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS k_text, "
        "concat('{\"k\":', json_extract_string(props, '$.k'), '}') AS json FROM events UNION ALL "
        "SELECT 'criteria', strategy_id, 2, f1, concat('{\"universe\":{},\"root\":{\"kind\":\"group\",\"op\":\"And\",\"children\":[{\"kind\":\"comparison\",\"field\":\"', f1, "
        "'\",\"operator\":\"', o1, '\",\"value\":', CAST(CAST(v1 AS DOUBLE) AS VARCHAR), '},{\"kind\":\"comparison\",\"field\":\"', f2, "
        "'\",\"operator\":\"GreaterThan\",\"value\":', CAST(CAST(v2 AS DOUBLE) AS VARCHAR), '}]},\"limit\":20}') FROM fx_strategies"),
    "stream_daily_bars": "SELECT user_id, CAST(ts AS DATE) AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, "
                         "arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2 "
                         "HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "stream_daily_ingest": v(f"SELECT {_SYM}, date, CASE WHEN year(date) >= 2000 THEN '' ELSE concat('INE', CAST(security_id AS VARCHAR)) END AS isin, close, volume "
                             f"FROM fx_bars WHERE {_EQ}"),
}
