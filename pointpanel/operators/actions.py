"""Corporate actions: resolved factors, adjusted closes and the reconciliation of factors against price steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointpanel.functions import corporate
from pointpanel.functions.rounding import half_even
from pointpanel.operators.asof import asof_join

# Actions that move prices, how far a bar may lie from its action, and the accepted deviation.
PRICE_ACTIONS = ("Split", "Bonus", "Rights")
MAX_BAR_DISTANCE_DAYS = 10
TOLERANCE = 0.05


def with_cum_close(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """The last close strictly before each ex-date."""
    return asof_join(actions, bars, "effective_date", "date", {"close": "cum_close"}, exact=False)


def _read(actions: DataFrame) -> DataFrame:
    """Adds what the remarks say: ``_own``, the factor of a split or bonus, and ``_terms`` of a rights issue.

    Remarks are read on the actions alone, before these meet the bars, and each pattern is run once: joined into one formula they make a method
    too long for the JVM to compile, which every bar would pass too.
    """
    kind, found = F.col("action_type"), {k: F.col(f"_{k}") for k in corporate.NUMBERS}
    terms = F.struct(*[c.alias(k) for k, c in corporate.rights_of(found).items()])
    return actions.withColumns({f"_{k}": c for k, c in corporate.numbers(F.col("raw_description")).items()}).withColumns({
        "_own": F.when(kind == "Split", corporate.split_of(found)).when(kind == "Bonus", corporate.bonus_of(found)),
        "_terms": F.when(kind == "Rights", terms),
    }).select(*actions.columns, "_own", "_terms")


def _factor() -> Column:
    """From the remark for splits and bonuses, from terms and cum price for rights, null otherwise."""
    terms = F.col("_terms")
    return F.coalesce(
        F.col("_own"), corporate.rights_factor(terms["offered"], terms["held"], terms["subscription"], F.col("cum_close"))
    )


def resolve_factors(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds ``factor``."""
    return with_cum_close(_read(actions), bars).withColumn("factor", _factor()).drop("_own", "_terms")


def factor_per_date(factors: DataFrame) -> DataFrame:
    """One combined factor per (security, ex-date): the product, not the exponential of a sum of logs."""
    return (
        factors.filter(F.col("factor") > 0)
        .groupBy("security_id", "effective_date")
        .agg(F.product("factor").alias("factor"), F.count(F.lit(1)).alias("n_actions"))
    )


def adjusted_bars(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Adds ``adj_close``: close times every factor with a later ex-date; an action does not adjust its own day."""
    steps = factor_per_date(factors).select(
        "security_id", F.col("effective_date").alias("date"), F.col("factor").alias("_f"), F.lit(1).alias("_side")
    )
    rows = bars.withColumn("_side", F.lit(0)).unionByName(steps, allowMissingColumns=True)
    # newest first; on one date the bar comes before the action
    later = (
        Window.partitionBy("security_id").orderBy(F.col("date").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumn("_k", F.coalesce(F.product("_f").over(later), F.lit(1.0)))
        .filter(F.col("_side") == 0)
        .withColumn("adj_close", F.col("close") * F.col("_k"))
        .drop("_side", "_f", "_k")
    )


def adjusted_by_actions(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """``adjusted_bars`` straight from unresolved actions: one shuffle of both serves the cum prices and the factors that come later."""
    steps = _read(actions.filter(F.col("action_type").isin(*PRICE_ACTIONS))).select(
        "security_id", F.col("effective_date").alias("date"), "_own", "_terms", F.lit(0).alias("_side")
    )
    rows = bars.withColumn("_side", F.lit(1)).unionByName(steps, allowMissingColumns=True)
    # newest first; on one date the bar comes before the action, so the next bar is the one before the ex-date
    newest = Window.partitionBy("security_id").orderBy(F.col("date").desc(), F.col("_side").desc())
    later = newest.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_bar", F.when(F.col("_side") == 1, F.struct("close")))
    rows = rows.withColumn("cum_close", F.expr("lead(_bar) IGNORE NULLS").over(newest)["close"]).withColumn("_f", _factor())
    return (
        rows.withColumn("_k", F.coalesce(F.product(F.when(F.col("_f") > 0, F.col("_f"))).over(later), F.lit(1.0)))
        .filter(F.col("_side") == 1)
        .withColumn("adj_close", F.col("close") * F.col("_k"))
        .select(*bars.columns, "adj_close")
    )


def surrounding_prices(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """First close on or after and last close before each ex-date, raw and adjusted, both within ten days."""
    near = MAX_BAR_DISTANCE_DAYS
    after = asof_join(
        actions, bars, "effective_date", "date", {"close": "close_after", "adj_close": "adj_after"},
        forward=True, max_days=near,
    )
    return asof_join(
        after, bars, "effective_date", "date", {"close": "close_before", "adj_close": "adj_before"},
        exact=False, max_days=near,
    )


def with_steps(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """Each action with its factor and the closes around it, raw and adjusted, from one sort of bars and actions together.

    Rows are numbered by twice their day, bars one more, so an action stands before the bar of its own day. The cum price and the product of
    factors so far are running frames, the neighbours are frames of the days within reach: all share one order. A bar's adjusted close takes
    the factors that come after it, which are all of the security's over those so far.
    """
    day = F.datediff("_on", F.lit("1970-01-01").cast("date")) * 2
    left = _read(actions).select("*", F.col("effective_date").alias("_on"), F.lit(True).alias("_action"))
    right = bars.select("security_id", F.col("date").alias("_on"), F.col("close").alias("_close"))
    rows = left.unionByName(right, allowMissingColumns=True).withColumn("_at", day + F.when(F.col("_action"), 0).otherwise(1))
    w = Window.partitionBy("security_id").orderBy("_at")
    reach = 2 * MAX_BAR_DISTANCE_DAYS
    rows = rows.withColumn("cum_close", F.last("_close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("factor", F.when(F.col("_action"), _factor()))
    step = F.when(F.col("factor") > 0, F.col("factor")).otherwise(1.0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_k", F.product(step).over(whole) / F.product(step).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    bar = F.when(F.col("_close").isNotNull(), F.struct(F.col("_close").alias("c"), (F.col("_close") * F.col("_k")).alias("a")))
    rows = rows.withColumn("_bar", bar).withColumns({
        "_before": F.last("_bar", ignorenulls=True).over(w.rangeBetween(1 - reach, -1)),
        "_after": F.first("_bar", ignorenulls=True).over(w.rangeBetween(1, reach + 1)),
    })
    return rows.where("_action").select(
        *actions.columns, "cum_close", "factor", F.col("_before.c").alias("close_before"), F.col("_before.a").alias("adj_before"),
        F.col("_after.c").alias("close_after"), F.col("_after.a").alias("adj_after"))


def reconcile(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """One row per action: its factor against the step the traded price made across the ex-date."""
    per_date = Window.partitionBy("security_id", "effective_date")
    is_price = F.col("action_type").isin(*PRICE_ACTIONS)
    rows = with_steps(actions, bars).withColumns({
        "actions_sharing_date": F.count(F.when(is_price, 1)).over(per_date),
        "_combined": F.product(F.when(is_price & (F.col("factor") > 0), F.col("factor"))).over(per_date),
    })
    usable = (F.col("close_before") > 0) & (F.col("close_after") > 0)
    implied = F.when(usable, F.col("close_after") / F.col("close_before"))
    compared = F.when(
        F.col("actions_sharing_date") > 1, F.coalesce(F.col("_combined"), F.col("factor"))
    ).otherwise(F.col("factor"))
    rows = rows.withColumns({"_implied": implied, "_cmp": compared})
    deviation = F.when(F.col("_cmp") > 0, F.abs(F.col("_implied") - F.col("_cmp")) / F.col("_cmp"))
    status = (
        F.when(F.col("_implied").isNull(), "Skipped")
        .when(deviation <= TOLERANCE, "Agrees")
        .when(deviation.isNotNull(), "Disagrees")
        .when(F.col("action_type") == "Dividend", "NotApplicable")
        .otherwise("Unadjusted")
    )
    adj_ok = F.col("_implied").isNotNull() & (F.col("adj_before") > 0) & (F.col("adj_after") > 0)
    step = F.when(adj_ok, F.abs(F.col("adj_after") - F.col("adj_before")) / F.col("adj_before"))
    return rows.select(
        "security_id", "effective_date", "action_type", "actions_sharing_date",
        half_even("_cmp").alias("comparison_factor"),
        half_even("_implied").alias("implied_factor"),
        half_even(deviation).alias("deviation"),
        half_even(step).alias("adjusted_step"),
        status.alias("status"),
    )


def reconcile_report(checks: DataFrame) -> DataFrame:
    """One row: checks per status, distinct securities checked, and whether the sample is large enough."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in
              ("Agrees", "Disagrees", "Unadjusted", "NotApplicable", "Skipped")]
    checked = F.countDistinct(F.when(F.col("status") != "Skipped", F.col("security_id")))
    return checks.agg(*counts, checked.alias("distinct_securities")).withColumn(
        "meets_sample", F.col("distinct_securities") >= 20
    )
