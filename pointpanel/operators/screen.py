"""Point-in-time screens: a criteria tree becomes a column predicate over the panel as of one date.

A criteria is a plain dict: ``{"universe": {...}, "root": {"kind": "group", "op": "And", "children": [...]},
"sort": {"field": ..., "direction": "Asc"}, "limit": n}`` with comparisons
``{"kind": "comparison", "field": ..., "operator": ..., "value": ...}``. Catalyst receives ordinary filters.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointpanel.functions.vocabulary import DEFAULT_LIMIT, MAX_LIMIT, METRIC_COLUMN
from pointpanel.operators import first_matches
from pointpanel.operators.asof import latest_as_of
from pointpanel.session import stored

RATIO_COLUMNS = ["market_cap", "pe", "pb", "ps", "roe", "debt_to_equity", "gross_margin", "roic", "fcf_yield"]
INDICATOR_COLUMNS = ["sma50", "sma200", "rsi14", "macd", "macd_signal", "atr14", "vol30"]
PROJECTION = ["security_id", "ticker", "name", "exchange", "sector", "industry", "close", "adj_close", "price_date"]

COMPARE = {
    "LessThan": operator.lt,
    "LessThanOrEqual": operator.le,
    "GreaterThan": operator.gt,
    "GreaterThanOrEqual": operator.ge,
    "Equal": operator.eq,
    "NotEqual": operator.ne,
}


def comparison(field: str, op: str, value: float) -> Column:
    """One comparison; a null metric makes it unknown, so the row is not selected."""
    if field not in METRIC_COLUMN:
        raise ValueError(f"'{field}' is not a known metric")
    return COMPARE[op](F.col(METRIC_COLUMN[field]), F.lit(float(value)))


def predicate(node: dict) -> Column:
    if node["kind"] == "comparison":
        return comparison(node["field"], node["operator"], node["value"])
    if node["op"] != "And":
        raise ValueError(f"group operator '{node['op']}' is not supported")
    if not node["children"]:
        raise ValueError("a group needs children")
    return reduce(operator.and_, [predicate(c) for c in node["children"]])


def in_universe(universe: dict | None) -> Column:
    """Exchange and sector equality. There is no index membership data, so an index constraint is refused."""
    u = universe or {}
    if u.get("index") is not None:
        raise ValueError("index constraints are not supported")
    tests = [F.col(k) == F.lit(u[k]) for k in ("exchange", "sector") if u.get(k) is not None]
    return reduce(operator.and_, tests, F.lit(True))


def panel_frame(
    securities: DataFrame, bars: DataFrame, as_of: str, indicators: DataFrame | None = None,
    ratios: DataFrame | None = None,
) -> DataFrame:
    """Each security's last bar on or before ``as_of``, its indicators of that same day and its last known ratios.

    A security without a bar drops out, one without indicators or ratios stays, one delisted since stays too.
    """
    latest = latest_as_of(bars, as_of, ["close", "adj_close", "volume"], date_alias="price_date")
    frame = securities.join(latest, "security_id")
    if indicators is not None:
        frame = join_indicators(frame, indicators)
    if ratios is not None:
        frame = frame.join(
            latest_as_of(ratios, as_of, RATIO_COLUMNS, date="reported_date"), "security_id", "left"
        )
    return frame


def join_indicators(frame: DataFrame, indicators: DataFrame) -> DataFrame:
    same_day = indicators.withColumnRenamed("date", "price_date")
    return frame.join(same_day, ["security_id", "price_date"], "left")


def top_rows(df: DataFrame, sort: dict | None, limit: int | None) -> DataFrame:
    """Order by a vocabulary field (default: ticker) and keep ``limit`` rows; ties fall to the security id."""
    n = DEFAULT_LIMIT if limit is None else limit
    if not 1 <= n <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    column = F.col(METRIC_COLUMN[sort["field"]]) if sort else F.col("ticker")
    descending = bool(sort) and sort.get("direction") == "Desc"
    return df.orderBy(column.desc_nulls_last() if descending else column.asc_nulls_first(), "security_id").limit(n)


def screen(frame: DataFrame, criteria: dict) -> DataFrame:
    rows = frame.filter(in_universe(criteria.get("universe"))).filter(predicate(criteria["root"]))
    return top_rows(rows, criteria.get("sort"), criteria.get("limit"))


def screen_many(frame: DataFrame, criteria: DataFrame, keep: list[str]) -> DataFrame:
    """Any number of criteria over one frame: rows (criteria_key, rank, *keep), each criteria with its own universe, order and limit.

    ``criteria`` has one row per *distinct* content key, as ``concepts.parsed_criteria`` gives them: criteria_key, exchange, sector,
    comparisons array<struct<field, operator, value>>, sort_field, descending, limit. Matches come from ``first_matches``, so only the first of
    each criteria are moved and no list passes through the driver. ``frame`` has one row per security. A metric it lacks is unknown, which selects nothing.
    """
    have = [f for f, column in METRIC_COLUMN.items() if column in frame.columns]
    frame = stored(frame, "frame")
    found = first_matches.first_matches(frame, criteria, "security_id", have)
    named = found.join(criteria.select("criteria_key", "sort_field", "descending", "limit"), "criteria_key")
    # as top_rows: nulls first when ascending and last when descending; the ticker orders where no field does
    order = [
        F.when(F.col("sort_field").isNull(), 0).otherwise((F.col("_value").isNull() == F.col("descending")).cast("int")),
        F.when(F.col("descending"), -F.col("_value")).otherwise(F.col("_value")),
        F.when(F.col("sort_field").isNull(), F.col("ticker")), F.col("security_id"),
    ]
    first = top_per_group(named, ["criteria_key"], order, F.col("limit"), at_most=MAX_LIMIT)
    own = [c for c in dict.fromkeys(keep) if c not in first.columns]
    first = first.join(frame.select("security_id", *own), "security_id") if own else first
    return first.select("criteria_key", "rank", *keep)


def top_per_group(rows: DataFrame, group: list[str], order: list, n: Column | int, at_most: int | None = None) -> DataFrame:
    """The first ``n`` rows per group; ``n`` may be a column.

    A literal bound lets Spark prune every map task to its own first rows before the shuffle (WindowGroupLimit), so a group of any size
    arrives as a few rows per task. A column has no such bound unless the caller states one in ``at_most``; a larger ``n`` is then an error.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    ranked = rows.withColumn("rank", F.row_number().over(w))
    if isinstance(n, int):
        return ranked.filter(F.col("rank") <= n)
    if at_most is None:
        return ranked.filter(F.col("rank") <= n)
    fits = F.assert_true(n <= at_most, f"a group asks for more than {at_most} rows").isNull()
    return ranked.filter(F.col("rank") <= at_most).filter(fits & (F.col("rank") <= n))
