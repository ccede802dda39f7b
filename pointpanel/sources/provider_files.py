"""Benchmark index files and nested provider documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointpanel.functions import corporate
from pointpanel.functions.dates import estimated_report_date, parse_date

# Action arrays, date keys in order of preference, and metric keys in order of preference.
ACTION_ARRAYS = {"bonus": "Bonus", "splits": "Split", "rights": "Rights", "dividend": "Dividend"}
DATE_KEYS = ["exDate", "xbDate", "xdDate", "sortDate", "recordDate"]
METRIC_KEYS = {
    "revenue": ("INC", ["TotalRevenue", "Revenue"]),
    "net_income": ("INC", ["NetIncome", "NetIncomeAfterTaxes"]),
    "total_debt": ("BAL", ["TotalDebt", "LongTermDebt"]),
    "shareholders_equity": ("BAL", ["TotalEquity"]),
    "shares_outstanding": ("INC", ["DilutedWeightedAverageShares", "TotalCommonSharesOutstanding"]),
    "cost_of_revenue": ("INC", ["CostofRevenueTotal"]),
}

_ACTION = "array<struct<" + ",".join(f"{k}:string" for k in DATE_KEYS) + ",remarks:string,value:string>>"
ACTIONS_SCHEMA = "struct<stockCorporateActionData:struct<" + ",".join(f"{a}:{_ACTION}" for a in ACTION_ARRAYS) + ">>"
_PAIRS = "array<struct<key:string,value:string>>"
FINANCIALS_SCHEMA = (
    f"struct<financials:array<struct<Type:string,EndDate:string,stockFinancialMap:struct<INC:{_PAIRS},BAL:{_PAIRS}>>>>"
)


def read_benchmark(spark: SparkSession, path: str, ticker: str) -> DataFrame:
    """Date,Close rows of an index file; rows that do not parse are skipped."""
    rows = spark.read.option("header", "true").schema("Date string, Close string").csv(path)
    return rows.select(
        F.lit(ticker).alias("ticker"),
        parse_date(F.col("Date"), ["dd-MMM-yyyy", "yyyy-MM-dd"]).alias("date"),
        F.trim("Close").try_cast("double").alias("total_return_index_value"),
    ).dropna()


def require_rows(df: DataFrame) -> DataFrame:
    """Refuses an input that yields nothing at all."""
    if df.isEmpty():
        raise ValueError("the file holds no readable rows")
    return df


def _first_date(item: Column) -> Column:
    return F.coalesce(*[F.substring(item[k], 1, 10).try_cast("date") for k in DATE_KEYS])


def parse_actions(documents: DataFrame) -> DataFrame:
    """Corporate actions of provider documents (security_id, json). A missing branch yields no rows."""
    d = F.from_json("json", ACTIONS_SCHEMA)["stockCorporateActionData"]

    def tagged(name, kind):
        items = F.coalesce(F.col("d")[name], F.array().cast(_ACTION))
        return F.transform(items, lambda x: F.struct(F.lit(kind).alias("t"), x.alias("x")))

    typed = [tagged(name, kind) for name, kind in ACTION_ARRAYS.items()]
    rows = documents.select("security_id", d.alias("d")).select("security_id", F.explode(F.concat(*typed)).alias("a"))
    item, remark = F.col("a.x"), F.col("a.x.remarks")
    return rows.select(
        "security_id",
        _first_date(item).alias("effective_date"),
        F.col("a.t").alias("action_type"),
        F.when(F.col("a.t") == "Bonus", corporate.bonus_from_remark(remark))
        .when(F.col("a.t") == "Split", corporate.split_from_remark(remark)).alias("adjustment_factor"),
        F.when(F.col("a.t") == "Dividend", item["value"].try_cast("double")).alias("dividend_amount"),
        remark.alias("raw_description"),
    ).filter(F.col("effective_date").isNotNull())


def _metric(section: str, keys: list[str]) -> Column:
    """The first candidate key that holds a number; keys compare without case."""
    pairs = F.col(f"f.stockFinancialMap.{section}")

    def numbers(key):
        hits = F.filter(pairs, lambda p: (F.lower(p["key"]) == key.lower()) & p["value"].try_cast("double").isNotNull())
        return F.get(hits, F.lit(0))["value"].try_cast("double")

    return F.coalesce(*[numbers(k) for k in keys])


def parse_fundamentals(documents: DataFrame) -> DataFrame:
    """Annual statements of provider documents (security_id, json); of several for one period the first one counts."""
    f = F.from_json("json", FINANCIALS_SCHEMA)["financials"]
    rows = documents.select("security_id", F.posexplode(f).alias("pos", "f"))
    annual = rows.filter(F.lower("f.Type") == "annual").select(
        "security_id", "pos", F.substring("f.EndDate", 1, 10).try_cast("date").alias("fiscal_period_end"),
        F.col("f.stockFinancialMap").isNotNull().alias("_mapped"),
        *[_metric(s, k).alias(m) for m, (s, k) in METRIC_KEYS.items()],
    ).filter(F.col("fiscal_period_end").isNotNull())
    first = annual.groupBy("security_id", "fiscal_period_end").agg(
        F.min_by("_mapped", "pos").alias("_mapped"), *[F.min_by(m, "pos").alias(m) for m in METRIC_KEYS]
    )
    used = F.coalesce("revenue", "net_income", "total_debt", "shareholders_equity")
    return first.filter(F.col("_mapped") & used.isNotNull()).select(
        "security_id", "fiscal_period_end",
        estimated_report_date(F.col("fiscal_period_end"), F.lit(True)).alias("reported_date"),
        F.lit(True).alias("is_reported_date_estimated"), *METRIC_KEYS,
    )
