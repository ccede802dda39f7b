"""Date parsing, reporting lags and rebalance schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date formats of daily files, in order of preference.
DATE_FORMATS = ["dd-MMM-yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyyMMdd", "dd-MMM-yy"]

# Days between a period's end and its assumed publication.
ANNUAL_LAG_DAYS = 60
QUARTERLY_LAG_DAYS = 45



def _shape(fmt: str) -> str:
    pattern = fmt.replace("MMM", "[A-Za-z]{3}").replace("yyyy", r"\d{4}")
    for token in ("dd", "MM", "yy"):
        pattern = pattern.replace(token, r"\d{2}")
    return f"^{pattern}$"


def parse_date(text: Column, formats: list[str] | None = None) -> Column:
    t = F.trim(text)
    # month names come in any case; the parser wants Title case
    titled = F.regexp_replace(F.initcap(F.regexp_replace(t, "-", " ")), " ", "-")
    tries = []
    for f in formats or DATE_FORMATS:
        month_name = "MMM" in f
        # a format is only tried on text of its shape: a failed parse costs an exception per row
        shaped = F.when(t.rlike(_shape(f)), titled if month_name else t)
        d = F.try_to_timestamp(shaped, F.lit(f)).cast("date")
        if "yyyy" not in f:  # two-digit years reach from 1950 to 2049
            d = F.when(F.year(d) > 2049, F.add_months(d, -1200)).otherwise(d)
        tries.append(d)
    return F.coalesce(*tries, t.try_cast("date"))


def estimated_report_date(period_end: Column, annual: Column) -> Column:
    return F.when(annual, F.date_add(period_end, ANNUAL_LAG_DAYS)).otherwise(
        F.date_add(period_end, QUARTERLY_LAG_DAYS)
    )


def rebalance_dates(start: Column, end: Column, months: Column) -> Column:
    """Dates from ``start``, each one ``months`` after the one before, up to ``end``.

    Every step counts from the previous date, so a clipped month end stays clipped (31 Jan, 29 Feb, 29 Mar); a
    ``sequence`` would count every step from ``start`` instead.
    """
    steps = F.floor(F.months_between(F.last_day(end), F.trunc(start, "MM")) / months).cast("int") + 1
    chained = F.aggregate(
        F.sequence(F.lit(1), steps),
        F.array(start),
        lambda acc, _: F.array_append(acc, F.add_months(F.element_at(acc, -1), months)),
    )
    return F.filter(chained, lambda d: d <= end)


def is_weekday(d: Column) -> Column:
    return ~F.dayofweek(d).isin(1, 7)
