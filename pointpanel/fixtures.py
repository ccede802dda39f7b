"""Daily-bar style inputs derived from the generic star-schema tables.

Every view is a job over the whole base table. Sums of money run over whole cents (bigint), so a result does not
depend on how rows were partitioned.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointpanel.functions import corporate
from pointpanel.session import stored


#: Trades that a task aggregates on average.
TASK_TRADES = 300_000


def _trade_order() -> Column:
    """(order, line, part, price) as one fixed-width decimal.

    A struct key would force ``min_by``/``max_by`` into a sort-based aggregate over the raw rows; a decimal buffer is
    mutable in place, so the aggregate stays hash-based with a map-side combine.
    """
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("decimal(18,0)")
    part_and_price = (F.col("l_partkey") * 10**8 + cents("l_extendedprice")).cast("decimal(19,0)")
    return (line * F.lit("1" + "0" * 19).cast("decimal(20,0)")).cast("decimal(38,0)") + part_and_price


def cents(c: str) -> Column:
    return F.floor(F.col(c) * 100 + 0.5)  # rounding a double goes through a decimal per row


def bars_from_trades(trades: DataFrame) -> DataFrame:
    """OHLCV per (security_id, date) from rows (security_id, date, ord, px, qty)."""
    return trades.groupBy("security_id", "date").agg(
        F.min_by("px", "ord").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "ord").alias("close"),
        (F.sum("qty") * 1000).cast("long").alias("volume"),
    )


class Fixtures:
    """Lazily built views over one data directory; each attribute is an unmaterialised DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def with_stored_bars(self) -> "Fixtures":
        """The bars written once and read back, as the ingest leaves them: for jobs that use them several times."""
        self.__dict__["bars"] = stored(self.bars, "bars")
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _trades(self, security: Column) -> DataFrame:
        return (
            self.table("lineitem")
            .select(
                security.alias("security_id"),
                F.to_date("l_shipdate").alias("date"),
                _trade_order().alias("ord"),
                (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
                F.col("l_quantity").alias("qty"),
            )
        )

    @cached_property
    def bars(self) -> DataFrame:
        stopped = (F.col("security_id") % 10 == 3) & (F.col("date") > F.lit("2000-06-30").cast("date"))
        # Nearly every trade is a bar of its own here, so combining them before the shuffle would only fill the memory of the map tasks. The
        # number of trades stands in the file's footer.
        tasks = self.table("lineitem").count() // TASK_TRADES + 1
        return bars_from_trades(self._trades(F.col("l_suppkey")).filter(~stopped).repartition(tasks, "security_id", "date"))

    @cached_property
    def bars_dense(self) -> DataFrame:
        stopped = (F.col("security_id") == 3) & (F.col("date") > F.lit("2000-06-30").cast("date"))
        return bars_from_trades(self._trades(F.col("l_suppkey") % 10 + 1).filter(~stopped))

    @cached_property
    def securities(self) -> DataFrame:
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return (
            self.table("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("security_id"),
                F.col("s_name").alias("ticker"),
                F.concat(F.lit("SUP"), F.col("s_suppkey").cast("string")).alias("provider_security_id"),
                F.col("s_name").alias("name"),
                F.col("r_name").alias("exchange"),
                F.col("n_name").alias("sector"),
                F.lit(None).cast("string").alias("industry"),
                F.lit(True).alias("is_active"),
            )
        )

    def _fundamentals(self, lines: DataFrame) -> DataFrame:
        rows = (
            lines.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(
                F.col("l_suppkey").alias("security_id"),
                F.make_date(F.year("l_shipdate"), F.lit(12), F.lit(31)).alias("fiscal_period_end"),
            )
            .agg(
                F.sum(cents("l_extendedprice") * (100 - cents("l_discount"))).alias("rev4"),
                F.sum(F.col("l_quantity").cast("long") * cents("p_retailprice") * 200).alias("cost4"),
                F.sum(F.when(F.col("l_returnflag") == "R", cents("l_extendedprice")).otherwise(0)).alias("debt2"),
                F.max(cents("s_acctbal")).alias("equity"),
                F.sum(F.col("l_quantity").cast("long")).alias("shares"),
            )
        )
        return rows.select(
            "security_id",
            "fiscal_period_end",
            F.date_add("fiscal_period_end", 60).alias("reported_date"),
            (F.col("rev4").cast("double") / 10000).alias("revenue"),
            ((F.col("rev4") - F.col("cost4")).cast("double") / 10000).alias("net_income"),
            (F.col("debt2").cast("double") / 100).alias("total_debt"),
            F.col("equity").cast("double").alias("shareholders_equity"),
            F.col("shares").cast("double").alias("shares_outstanding"),
            (F.col("cost4").cast("double") / 10000).alias("cost_of_revenue"),
        )

    @cached_property
    def fundamentals_v2(self) -> DataFrame:
        """Figures as they stand now."""
        return self._fundamentals(self.table("lineitem"))

    @cached_property
    def fundamentals_v1(self) -> DataFrame:
        """Figures as first reported: only the finished lines were known."""
        return self._fundamentals(self.table("lineitem").filter(F.col("l_linestatus") == "F"))

    @cached_property
    def fundamentals_scd2(self) -> DataFrame:
        """System-time history: the restatement lands 180 days after the first report."""
        turn = F.date_add("reported_date", 180)
        first = self.fundamentals_v1.withColumns({"valid_from": F.col("reported_date"), "valid_to": turn})
        second = self.fundamentals_v2.withColumns(
            {"valid_from": turn, "valid_to": F.lit("9999-12-31").cast("date")}
        )
        return first.unionByName(second)

    def numbered_bars(self, bars: DataFrame | None = None) -> DataFrame:
        w = Window.partitionBy("security_id").orderBy("date")
        return (self.bars if bars is None else bars).withColumn("rn", F.row_number().over(w))

    def _remarked(self, bars: DataFrame) -> DataFrame:
        """Every bar with the action of its day: type and remark, or nulls."""
        sid = F.col("security_id")
        kind = (
            F.when(F.col("rn") % 97 == 50, "Split")
            .when(F.col("rn") % 101 == 60, "Bonus")
            .when(F.col("rn") % 103 == 70, "Rights")
            .when(F.col("rn") % 53 == 20, "Dividend")
        )
        text = (
            F.when(
                F.col("action_type") == "Split",
                F.concat(F.lit("Sub-division from Rs. 10/- to Re. "), (1 + sid % 5).cast("string"), F.lit("/-")),
            )
            .when(
                F.col("action_type") == "Bonus",
                F.concat(F.lit("Bonus issue in the ratio of 1:"), (1 + sid % 3).cast("string"), F.lit(" of Rs. 10/-.")),
            )
            .when(
                F.col("action_type") == "Rights",
                F.concat(
                    F.lit("Rights equity shares of Rs. 10/- in the ratio of 1 : "), (2 + sid % 4).cast("string"),
                    F.lit(" @ premium of Rs. "), (300 + sid % 7).cast("string"), F.lit("/-"),
                ),
            )
        )
        return self.numbered_bars(bars).withColumn("action_type", kind).withColumn("raw_description", text)

    def _actions(self, bars: DataFrame) -> DataFrame:
        return (
            self._remarked(bars)
            .filter(F.col("action_type").isNotNull())
            .select(
                "security_id",
                F.col("date").alias("effective_date"),
                "action_type",
                F.when(F.col("action_type") == "Dividend", F.col("close") * 0.02).alias("dividend_amount"),
                "raw_description",
            )
        )

    @cached_property
    def actions(self) -> DataFrame:
        return self._actions(self.bars)

    @cached_property
    def actions_dense(self) -> DataFrame:
        return self._actions(self.bars_dense)

    def _snapshots(self, bars: DataFrame) -> DataFrame:
        # one row per trading day after the aggregate, so the global row_number sees a calendar, not the facts
        days = bars.groupBy("date").agg(F.count(F.lit(1)).alias("price_row_count"))
        return days.select(
            F.row_number().over(Window.orderBy("date")).cast("long").alias("snapshot_id"),
            F.col("date").alias("as_of_date"),
            "price_row_count",
            F.when(F.dayofmonth("date") != 13, F.col("date")).alias("sealed_at"),
        )

    def traded(self, bars: DataFrame, smooth: int = 20) -> DataFrame:
        """Bars whose close is a trailing mean that steps down on every split and bonus date, as a traded price does. One sort serves all."""
        w = Window.partitionBy("security_id").orderBy("date")
        text = F.col("raw_description")
        factor = F.when(F.col("action_type") == "Split", corporate.split_from_remark(text)).when(
            F.col("action_type") == "Bonus", corporate.bonus_from_remark(text))
        mean = F.avg("close").over(w.rowsBetween(1 - smooth, 0))
        level = F.product(F.coalesce("_f", F.lit(1.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return self._remarked(bars).withColumn("_f", factor).select(
            *[(mean * level).alias(c) if c == "close" else c for c in bars.columns])

    def actions_of(self, bars: DataFrame) -> DataFrame:
        return self._actions(bars)

    @cached_property
    def snapshots(self) -> DataFrame:
        return self._snapshots(self.bars)

    @cached_property
    def snapshots_dense(self) -> DataFrame:
        return self._snapshots(self.bars_dense)

    @cached_property
    def benchmark(self) -> DataFrame:
        return self.bars.groupBy("date").agg(F.avg("close").alias("total_return_index_value")).select(
            F.lit("MKT").alias("ticker"), "date", "total_return_index_value"
        )

    @cached_property
    def symbols(self) -> DataFrame:
        sid = F.col("security_id")
        moved = (sid % 5 == 0) & (F.col("date") >= F.lit("1999-01-01").cast("date"))
        return self.bars.select(
            "date",
            "security_id",
            F.concat(F.when(moved, "N").otherwise("S"), sid.cast("string")).alias("symbol"),
            F.when(
                F.col("date") < F.lit("1998-01-01").cast("date"), F.concat(F.lit("INE"), sid.cast("string"))
            ).otherwise("").alias("isin"),
        )

    @cached_property
    def orders_dates(self) -> DataFrame:
        return self.table("orders").select(F.to_date("o_orderdate").alias("order_date")).distinct()

    @cached_property
    def rebalance(self) -> DataFrame:
        k = F.col("id")
        return self.spark.range(12).select(
            k.cast("int").alias("rebalance_no"),
            F.make_date(
                (1998 + F.floor(k / 4)).cast("int"), (1 + 3 * (k % 4)).cast("int"), F.lit(2)
            ).alias("signal_date"),
        )
