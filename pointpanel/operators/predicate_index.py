"""Many criteria over one frame through an index of their comparisons.

Each distinct (field, operator) has a list of thresholds in the order in which a rising (or falling) value satisfies them, so what a row
satisfies is a prefix of the list, and a binary search finds its length. A prefix is at most log2(n) aligned blocks of powers of two, and
each comparison lies in one block of each size: rows and comparisons that match meet by an equi-join on blocks, each pair once, without a
range join.

A criteria is reached through its rarest comparison only, by counts over the frame, and then confirmed on all of its comparisons. So the work
grows with the matches of the rarest comparisons, not with rows times criteria. Criteria are dealt into parts of bounded size, each with its
own lists; a row meets every part once.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointpanel.functions.vocabulary import METRIC_COLUMN
from pointpanel.session import stored

#: Criteria of a part on average, and the bits that number the comparisons of a list.
PART_CRITERIA, LIST_BITS = 50_000, 22
#: Pairs of a row and a criteria that a task of the index join makes on average.
TASK_PAIRS = 250_000


def satisfied(value: Column, op: Column, bound: Column) -> Column:
    """One comparison; a null metric or an unknown operator selects nothing."""
    return F.coalesce(
        F.when(op == "LessThan", value < bound).when(op == "LessThanOrEqual", value <= bound)
        .when(op == "GreaterThan", value > bound).when(op == "GreaterThanOrEqual", value >= bound),
        F.lit(False),
    )


def holds(values: Column) -> Column:
    """All of the ``comparisons`` of a criteria, against a row's map of field to value."""
    return F.forall("comparisons", lambda k: satisfied(F.try_element_at(values, k["field"]), k["operator"], k["value"]))


def _falling(op: Column) -> Column:
    return op.isin("LessThan", "LessThanOrEqual")


def _length(bounds: Column, value: Column, strict: Column) -> Column:
    """How many of the sorted bounds lie below the value (or at it, unless strict): a binary search in a fold over its steps."""
    start = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        middle = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        at = F.get(bounds, middle)
        right = (acc["lo"] < acc["hi"]) & ((at < value) | (~strict & (at == value)))
        return F.struct(
            F.when(right, middle + 1).otherwise(acc["lo"]).alias("lo"),
            F.when((acc["lo"] < acc["hi"]) & ~right, middle).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.size(bounds) + 1)).cast("int") + 1), start, step, lambda acc: acc["lo"])


def _lists(comparisons: DataFrame) -> DataFrame:
    """(part, lists): the distinct thresholds of each (field, op), those of falling operators negated, in rising order."""
    key = F.when(_falling(F.col("op")), -F.col("bound")).otherwise(F.col("bound"))
    each = comparisons.select("part", "field", "op", key.alias("key")).distinct()
    each = each.groupBy("part", "field", "op").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    return each.groupBy("part").agg(F.collect_list(F.struct("field", "op", "keys")).alias("lists"))


def _prefixes(rows: DataFrame, lists: DataFrame, parts: int) -> DataFrame:
    """(row, part, field, op, p): the length of the prefix that each row satisfies in each list, if any."""
    spread = rows.select("_row", "_m", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).join(lists, "part")
    found = spread.select("_row", "part", "_m", F.explode("lists").alias("l")).withColumn("v", F.try_element_at("_m", F.col("l.field"))).where("v is not null")
    value = F.when(_falling(F.col("l.op")), -F.col("v")).otherwise(F.col("v"))
    p = _length(F.col("l.keys"), value, F.col("l.op").isin("LessThan", "GreaterThan"))
    return found.select("_row", "part", "l.field", "l.op", p.alias("p")).where("p > 0")


def _reached(asked: DataFrame, entries: DataFrame, block: list[str]) -> DataFrame:
    """(row, criteria_key) of equal blocks. A block in which most rows meet many criteria is dealt over slices of its rows, and the tasks are
    numbered by the pairs they make: their input says nothing about these, so adaptive coalescing would leave all of them to a few tasks."""
    pairs = asked.groupBy(*block).agg(F.count("*").alias("_a")).join(entries.groupBy(*block).agg(F.count("*").alias("_e")), block)
    pairs = stored(pairs.select(*block, (F.col("_a") * F.col("_e")).alias("_n")), "pairs")
    tasks = (pairs.agg(F.sum("_n")).first()[0] or 0) // TASK_PAIRS + 1
    if tasks == 1:
        return asked.join(entries, block).select("_row", "criteria_key")
    slices = pairs.select(*block, F.ceil(F.col("_n") / TASK_PAIRS).cast("int").alias("_of"))
    one = F.pmod(F.xxhash64("_row"), F.col("_of")).cast("int").alias("_slice")
    every = F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_slice")
    keys = [*block, "_slice"]
    rows = asked.join(slices, block).select("_row", *block, one).repartition(tasks, *keys)
    return rows.join(entries.join(slices, block).select("criteria_key", *block, every).repartition(tasks, *keys), keys).select("_row", "criteria_key")


def matches(frame: DataFrame, criteria: DataFrame, row: str, metrics: list[str]) -> DataFrame:
    """(criteria_key, row): the rows of ``frame`` that satisfy each criteria, universe and comparisons.

    ``frame`` has a unique column ``row``, the metric columns of the fields in ``metrics``, and exchange and sector where it knows them;
    ``criteria`` as in ``screen.screen_many``. A field that the frame lacks selects nothing.
    """
    parts = max(1, -(-criteria.count() // PART_CRITERIA))
    values = F.create_map(*[x for f in metrics for x in (F.lit(f), F.col(METRIC_COLUMN[f]).cast("double"))])
    places = [c for c in ("exchange", "sector") if c in frame.columns]
    rows = stored(frame.select(F.col(row).alias("_row"), *places, values.alias("_m")), "rows")
    dealt = criteria.select(
        "criteria_key", "exchange", "sector", "comparisons", F.pmod(F.xxhash64("criteria_key"), F.lit(parts)).cast("int").alias("part"))
    each = dealt.select("criteria_key", "part", F.explode("comparisons").alias("c")).select(
        "criteria_key", "part", F.col("c.field").alias("field"), F.col("c.operator").alias("op"), F.col("c.value").alias("bound"))
    each = stored(each, "comparisons")

    # How many rows satisfy each comparison: rows by prefix length, summed from the longest down.
    lists = stored(_lists(each), "lists")
    by_length = _prefixes(rows, lists, parts).groupBy("part", "field", "op", "p").agg(F.count("*").alias("n"))
    at_least = Window.partitionBy("part", "field", "op").orderBy(F.desc("p"))
    counts = by_length.withColumn("n", F.sum("n").over(at_least)).withColumn("from", F.coalesce(F.lead("p").over(at_least), F.lit(0)) + 1)
    key = F.when(_falling(F.col("op")), -F.col("bound")).otherwise(F.col("bound"))
    placed = lists.select("part", F.explode("lists").alias("l")).select("part", "l.field", "l.op", F.posexplode("l.keys").alias("at", "key"))
    lengths = counts.select("part", "field", "op", F.explode(F.sequence("from", "p")).alias("at"), "n").withColumn("at", F.col("at") - 1)
    weighed = placed.join(lengths, ["part", "field", "op", "at"], "left").select("part", "field", "op", "key", F.coalesce("n", F.lit(0)).alias("n"))
    known = each.withColumn("key", key).join(weighed, ["part", "field", "op", "key"], "left")
    rarest = known.groupBy("criteria_key", "part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "field", "op", "bound")).alias("r"))
    access = stored(rarest.where("r.n > 0").select("criteria_key", "part", "r.field", "r.op", "r.bound"), "access")

    # The index proper: lists of access comparisons only.
    lists = stored(_lists(access), "access-lists")
    placed = lists.select("part", F.explode("lists").alias("l")).select("part", "l.field", "l.op", F.posexplode("l.keys").alias("at", "key"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(LIST_BITS))).alias("level")
    block = ["part", "field", "op", "level", "block"]
    entries = access.withColumn("key", key).join(placed, ["part", "field", "op", "key"]).select(
        "criteria_key", "part", "field", "op", "at", levels).select("criteria_key", "part", "field", "op", "level", F.expr("shiftright(at, level)").alias("block"))
    largest = lists.select(F.max(F.array_max(F.transform("lists", lambda x: F.size(x["keys"]))))).first()[0] or 0
    entries = entries.where(F.col("level") <= largest.bit_length())
    prefixes = stored(_prefixes(rows, lists, parts), "prefixes")  # read twice: the pairs of a block are counted before they are made
    asked = prefixes.select("_row", "part", "field", "op", "p", levels).where(
        (F.col("level") <= largest.bit_length()) & (F.expr("shiftright(p, level)") % 2 == 1)).select(
        "_row", "part", "field", "op", "level", (F.expr("shiftright(p, level)") - 1).alias("block"))
    reached = _reached(asked, entries, block)

    whole = reached.join(rows, "_row").join(dealt.select(
        "criteria_key", *(F.col(c).alias(f"_{c}") for c in ("exchange", "sector")), "comparisons"), "criteria_key")
    place = {c: F.col(c) if c in places else F.lit(None).cast("string") for c in ("exchange", "sector")}
    inside = reduce(operator.and_, [F.col(f"_{c}").isNull() | F.coalesce(place[c] == F.col(f"_{c}"), F.lit(False)) for c in place])
    return whole.where(inside & holds(F.col("_m"))).select("criteria_key", F.col("_row").alias(row))
