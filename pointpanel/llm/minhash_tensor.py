"""MinHash near-dedup by tensored banding: table keys are pairs out of two small collections of hashes, candidates are verified.

A set is the distinct two-word shingles of a text; two sets link when their Jaccard similarity is at least ``percent``.

1. Each set gets two collections of ``SIDE`` half keys, a half key being ``ROWS`` minhashes. Every pair of a half key of the one and a half
   key of the other is a table key: SIDE * SIDE tables of 2 * ROWS minhashes each, for 2 * SIDE * ROWS minhashes in all, where plain
   banding would compute SIDE times as many. Two sets of similarity s share a table with probability (1 - (1 - s^ROWS)^SIDE)^2, which is
   0.9985 at 0.8, 0.9998 at 0.85 and 0.999999 at 0.95.
2. Identical sets are one set; only tables' entries that several sets share are kept.
3. Each set is compared with the leaders (the smallest fingerprint) of its entries, those first that it shares most tables with, by exact
   intersections of whole shingle sets. That joins large groups of near copies by a few comparisons a set. An entry whose sets are then in
   one component is settled.
4. The sets of the other entries (stragglers of groups, and unlike sets that share a passage) are paired by an exact rule, so no entry is cut
   however full it is: linked sets share a shingle among the rarest of each, at positions that leave room for what they must share. Pairs of
   one component are skipped, and a list's largest component never meets itself. A set meets its nearest of a component first, and a pivot
   of each component rules out most of the others by the triangle inequality.
5. Components of the confirmed links give the smallest document id that links reach.

A third of all rows may be copies of one text (the first aggregation, pre-aggregated in the tasks, makes them one set) or near copies (their
entries are read by joins that the planner splits). Leaders are found by aggregates, never by collecting an entry.
Texts are read twice: for the sketches, and once more for the sets that share an entry.

Defined results: null or wordless texts have an empty set and link with nothing; a text of one word has one shingle; each row is a document
of its own, so rows that repeat a doc_id may differ in their component; a row without a doc_id links with nothing, has no component and is
kept; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointpanel.llm.among import among
from pointpanel.llm.graph import components
from pointpanel.llm.words import mix, shingle_sets, slices, small_batches
from pointpanel.session import stored

WIDTH = 2
#: Minhashes of half a key, and half keys in each of the two collections.
ROWS, SIDE = 3, 10
ROWS_AT_ONCE = 250
#: Leaders that a set is compared with before the exact rule.
LEADERS = 3
#: Sets of a list's largest component that the list's other sets meet before all of them do.
FIRST = 8
#: How many sets of another component a set has met after each round, before it meets the rest.
NEAREST = (5, 40)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def half_keys(sets: list[np.ndarray], rows: int, side: int) -> np.ndarray:
    """2 * side half keys of each set, of ``rows`` minhashes each; sets are not empty."""
    draw = np.random.default_rng(11)
    shifts, factors = (draw.integers(0, 1 << 63, 2 * side * rows, dtype=np.uint64) for _ in range(2))
    everything = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.zeros((len(sets), 2 * side), np.uint64)
    with np.errstate(over="ignore"):
        for h in range(2 * side):
            own = np.full(len(sets), h, np.uint64)
            for k in range(h * rows, (h + 1) * rows):
                own = mix(own * np.uint64(3) + np.minimum.reduceat((everything ^ shifts[k]) * (factors[k] | np.uint64(1)), starts))
            out[:, h] = own
    return out


def _sketches(docs: DataFrame, rows: int, side: int) -> DataFrame:
    """(doc_id, n, fa, fb, a, b): size and 128-bit fingerprint of each row's set, and its two collections of half keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS_AT_ONCE):
            sets = shingle_sets(batch.column(1), WIDTH)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            full = np.flatnonzero(sizes)
            marks, halves = np.zeros((2, len(sets)), np.int64), np.zeros((len(sets), 2 * side), np.int64)
            if len(full):
                some = [sets[k] for k in full]
                everything = np.concatenate(some)
                starts = np.cumsum(sizes[full]) - sizes[full]
                with np.errstate(over="ignore"):
                    marks[0, full] = _signed(np.add.reduceat(mix(everything), starts))
                    marks[1, full] = _signed(np.bitwise_xor.reduceat(mix(everything + np.uint64(7)), starts))
                halves[full] = half_keys(some, rows, side).view(np.int64)
            ends = np.arange(0, (len(sets) + 1) * side, side, dtype=np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).reshape(-1)))
                     for x in (halves[:, :side], halves[:, side:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(marks[0]), pa.array(marks[1]), *lists], names=["doc_id", "n", "fa", "fb", "a", "b"])

    schema = "doc_id long, n long, fa long, fb long, a array<long>, b array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _grams(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, grams): fingerprint and whole shingle set of at least the documents named by ``ids`` (sid)."""
    texts = among(docs.select(F.col("doc_id").cast("long").alias("sid"), "text"), "sid", stored(ids, "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS_AT_ONCE):
            sets = shingle_sets(batch.column(0), WIDTH)
            with np.errstate(over="ignore"):
                marks = _signed(np.array([mix(own).sum(dtype=np.uint64) for own in sets], np.uint64))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(marks), pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate(sets))))], names=["id", "grams"])

    return stored(texts.select("text").mapInArrow(run, "id long, grams array<long>").dropDuplicates(["id"]), "grams")


def _distances(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """The pairs (a, b) with both sizes and the size of the intersection of their whole sets."""
    side = lambda k: grams.select(F.col("id").alias(k), F.col("grams").alias(f"g{k}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select(
        "a", "b", F.size("ga").alias("na"), F.size("gb").alias("nb"), F.size(F.array_intersect("ga", "gb")).alias("both"))


def _confirmed(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    return _distances(pairs, grams).where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _sized(percent: int, n, m):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _posted(grams: DataFrame, open_: DataFrame, percent: int) -> DataFrame:
    """(token, id, label, n, pos): the rarest shingles of each set (id, label), as many as two linked sets must share one of, where
    several labels have them."""
    tokens = open_.join(grams, "id").select("id", "label", F.size("grams").alias("n"), F.explode("grams").alias("token"))
    tokens = stored(tokens, "tokens")
    seen = tokens.groupBy("token").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    rarest = Window.partitionBy("id").orderBy("c", "token")
    posted = (
        tokens.join(seen, "token").withColumn("pos", F.row_number().over(rarest) - 1)
        .where(F.col("pos") <= F.expr(f"n - (({percent} * n + 99) div 100)")).where("lo < hi").select("token", "id", "label", "n", "pos")
    )
    return stored(posted, "posted")


def _listed(posted: DataFrame) -> DataFrame:
    """The postings of lists that hold several labels, with the label that has most of the list."""
    sizes = posted.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(
        F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1").select("token", F.col("m.label").alias("major"))
    return posted.join(sizes, "token")


def _needed(percent: int):
    return F.expr(f"({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent}")


def _fitting(percent: int):
    """Whether postings x and y of one list leave room for a link that shares this shingle first."""
    needed = _needed(percent)
    return _sized(percent, F.col("x.n"), F.col("y.n")) & (F.col("x.n") - F.col("x.pos") >= needed) & (F.col("y.n") - F.col("y.pos") >= needed)


def _first_links(grams: DataFrame, posted: DataFrame, percent: int) -> DataFrame:
    """Links of each list's sets with a few sets of its largest component, those first that share most lists: a number of comparisons in
    proportion to the postings, which joins most stragglers of a large group before its lists are met in full."""
    listed = _listed(posted)
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("id"), "id"))
    few = listed.where("label = major").withColumn("rank", rank).where(F.col("rank") <= FIRST)
    met = listed.where("label != major").alias("x").join(few.alias("y"), "token").where(_fitting(percent))
    shares = met.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count("*").alias("c"))
    most = Window.partitionBy("a").orderBy(F.desc("c"), "b")
    tried = shares.withColumn("rank", F.row_number().over(most)).where(F.col("rank") <= FIRST).select("a", "b")
    return _confirmed(stored(tried, "tried"), grams, percent)


def _exact_pairs(posted: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of posted sets of different labels that may link, with their labels and the room their bound leaves: every pair
    that does link is among them."""
    listed = _listed(posted)
    x, y = listed.where("label != major").alias("x"), listed.alias("y")
    needed = _needed(percent)
    met = x.join(y, "token").where(
        (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.major")) | (F.col("x.id") < F.col("y.id"))) & _fitting(percent))
    # Shingles in common up to the last one that both prefixes hold are counted; of those after it no more than the shorter rest can be.
    rest = F.least(F.min(F.col("x.n") - F.col("x.pos")), F.min(F.col("y.n") - F.col("y.pos"))) - 1
    together = met.groupBy(F.col("x.id").alias("a"), F.col("x.label").alias("la"), F.col("y.id").alias("b"), F.col("y.label").alias("lb")).agg(
        (F.count("*") + rest).alias("most"), F.max(needed).alias("needed"))
    return together.where("most >= needed").withColumn("room", F.col("most") - F.col("needed")).drop("most", "needed")


def _further_links(grams: DataFrame, open_: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Components after the links among the sets (id, label) of unsettled entries.

    Each set meets a few of another component at a time, those first whose bound leaves most room, which joins stragglers to their group: what is
    then in one component is settled. For the rest, a pivot of each component rules out pairs without looking at them: Jaccard distance is a
    metric, so two sets whose distances to the pivot differ by more than a link allows are no link.
    """
    posted = _posted(grams, open_, percent)
    found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(_first_links(grams, posted, percent)))
    # A set that links with none is in no component and keeps its own label.
    own = found.select("id", F.col("component").alias("now"))
    posted = stored(posted.join(own, "id", "left").withColumn("label", F.coalesce("now", "label")).drop("now"), "posted")
    sizes = open_.join(own, "id", "left").groupBy(F.coalesce("now", "label").alias("label")).agg(F.count("*").alias("n"))
    size = lambda k: sizes.select(F.col("label").alias(f"l{k}"), F.struct("n", "label").alias(f"n{k}"))
    met = _exact_pairs(posted, percent).join(size("a"), "la").join(size("b"), "lb")
    smaller = F.col("na") < F.col("nb")
    pairs = stored(met.select(
        F.when(smaller, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(smaller, F.col("b")).otherwise(F.col("a")).alias("b"),
        F.when(smaller, F.col("lb")).otherwise(F.col("la")).alias("lb"), "room"), "pairs")
    nearest = Window.partitionBy("a", "lb").orderBy(F.desc("room"), F.xxhash64("a", "b"))
    left = stored(pairs.withColumn("rank", F.row_number().over(nearest)), "ranked")
    pivots = left.where(F.col("rank") <= NEAREST[0]).groupBy("lb", "b").agg(F.count("*").alias("c")).groupBy("lb").agg(
        F.max_by("b", F.struct("c", "b")).alias("pivot"))
    left = stored(left.join(pivots, "lb"), "pairs")
    for upto in NEAREST:
        links = _confirmed(left.where(F.col("rank") <= upto), grams, percent)
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))
        now = lambda k: found.select(F.col("id").alias(k), F.col("component").alias(f"now_{k}"))  # noqa: B023, E731
        left = stored(left.where(F.col("rank") > upto).join(now("a"), "a", "left").join(now("b"), "b", "left").where(
            F.coalesce("now_a", "a") != F.coalesce("now_b", "b")).drop("now_a", "now_b"), "left")
    ends = left.select("a", F.col("pivot").alias("b")).union(left.select("b", "pivot")).distinct()
    away = stored(_distances(ends, grams).select(
        "a", F.col("b").alias("pivot"), (1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("d")), "away")
    near = left.join(away.withColumnRenamed("d", "da"), ["a", "pivot"]).join(
        away.select(F.col("a").alias("b"), "pivot", F.col("d").alias("db")), ["b", "pivot"])
    near = near.where(F.abs(F.col("da") - F.col("db")) <= 1 - percent / 100 + 1e-9)
    last = _confirmed(stored(near.select("a", "b").distinct(), "pairs"), grams, percent)
    return components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(last))


def _linked(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, component): fingerprints of sets that link with others, and the smallest fingerprint that their links reach."""
    entries = sets.select("id", "n", F.explode("a").alias("x"), "b").select("id", "n", "x", F.explode("b").alias("y")).select(
        F.xxhash64("x", "y").alias("key"), "id", "n")
    heads = entries.groupBy("key").agg(F.min(F.struct("id", "n")).alias("head"), F.count("*").alias("c")).where("c > 1").drop("c")
    live = stored(entries.join(heads, "key").where(F.col("id") != F.col("head.id")), "live")
    shares = live.where(_sized(percent, F.col("n"), F.col("head.n"))).groupBy("id", F.col("head.id").alias("b")).agg(F.count("*").alias("c"))
    most = Window.partitionBy("id").orderBy(F.desc("c"), "b")
    tried = shares.withColumn("rank", F.row_number().over(most)).where(F.col("rank") <= LEADERS).select(F.col("id").alias("a"), "b")
    sharing = live.select("id").union(live.select("head.id")).distinct()
    grams = _grams(docs, sets.join(sharing, "id", "left_semi").select("sid"))
    found = components(stored(_confirmed(stored(tried, "tried"), grams, percent), "links"))
    label = lambda k: found.select(F.col("id").alias(k), F.col("component").alias(f"{k}_label"))
    lead = live.groupBy("key").agg(F.min("head.id").alias("head"))
    members = live.select("key", "id").union(lead.select("key", "head"))
    labelled = members.join(label("id"), "id", "left").select("key", "id", F.coalesce("id_label", "id").alias("label"))
    several = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    open_ = stored(labelled.join(several, "key", "left_semi").select("id", "label").distinct(), "open")
    return _further_links(grams, open_, found, percent)


def near_copies(docs: DataFrame, percent: int = 80, rows: int = ROWS, side: int = SIDE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    with small_batches(docs.sparkSession):  # all work in Python workers is done in here, into stored tables
        sketches, known = _known(docs, percent, rows, side)
    rows_ = sketches.select("doc_id", "n", "fa", "fb")
    linked = rows_.where("doc_id is not null").join(known, ["fa", "fb", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    alone = rows_.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _known(docs: DataFrame, percent: int, rows: int, side: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and (fa, fb, n, component) of each distinct set."""
    sketches = stored(_sketches(docs, rows, side), "sketches")
    full = sketches.where("n > 0 and doc_id is not null")
    sets = full.groupBy("fa", "fb", "n").agg(F.min("doc_id").alias("sid"), F.first("a").alias("a"), F.first("b").alias("b"))
    sets = stored(sets.withColumnRenamed("fa", "id"), "sets")
    found = _linked(docs, sets, percent)
    # The smallest fingerprint of a component is no row of its own there.
    found = found.union(found.select("component", "component").distinct())
    named = sets.select("id", "fb", "n", "sid").join(found, "id")
    least = named.groupBy("component").agg(F.min("sid").alias("least"))
    least = named.join(least, "component").select("id", "fb", "n", "least")
    known = sets.select("id", "fb", "n", "sid").join(least, ["id", "fb", "n"], "left").select(
        F.col("id").alias("fa"), "fb", "n", F.coalesce("least", "sid").alias("component"))
    return sketches, known
