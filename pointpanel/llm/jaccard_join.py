"""N-gram Jaccard join with set relations: groups of documents linked by similar shingle sets, exactly and without all pairs.

A set is the distinct five-word shingles of a text. Two sets link when their Jaccard similarity is at least ``percent``.

1. Identical sets collapse to one representative (the smallest doc_id).
2. Each set looks for a *head*: the smallest set that shares one of its three least shingles. Those within the threshold of
   their head form the head's block. Blocks are the highly similar sets whose answers derive from the head's.
3. Index lists: every set posts the prefix of its shingles in one global order (rarest first, by counts over all documents in a
   bounded number of hash buckets). A list holds one entry for each block, with the range of sizes and the first position; blocks that
   sizes or positions rule out are skipped without looking at their members.
4. In dense lists all blocks are first compared with the heads of the largest few, which joins most of a large group of near copies by
   a number of comparisons in proportion to its size. What then meets in a list within one component needs no comparison.
5. Other pairs of blocks that meet in a list have only their heads compared. Jaccard distance is a metric: with head distance d and radii
   r, s no members can link beyond d > r + s + t, and heads within t link both blocks at once.
6. Only the ring between needs members, derived in two steps: members against the other head, then member pairs whose distances to
   the heads differ by no more than t. Blocks that are already in one component are left out.
7. Components of head-member, head-head and ring links are found by star contraction.

Every link lies inside a component that results, because two linked sets share a posted shingle, so their blocks meet in a list.

Defined results: null or wordless texts have an empty set and link with nothing; a text of fewer than five words is one shingle; rows
that repeat a doc_id each have their own set and share the component of their id; a null doc_id links with nothing and has a null
component; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointpanel.llm.among import among
from pointpanel.llm.graph import components
from pointpanel.llm.words import mix, shingle_sets, slices, small_batches
from pointpanel.session import stored

WIDTH = 5
#: Buckets of the shingle counts, as a power of two. The counts of all documents reach the tasks as one array of that size.
ORDER_BITS = 20
#: Rows that hold the counts of a task.
COUNT_PARTS = 16
ROWS_AT_ONCE = 250
#: Lists of so many blocks are dense; their blocks first meet the heads of the largest ones, so many in each of some rounds.
DENSE, LEADERS, ROUNDS = 16, 3, 2
SEEDS = np.array([0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95], dtype=np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _summaries(docs: DataFrame) -> DataFrame:
    """A row for each document (size, 128-bit fingerprint of its set, three least shingles) and, with ``part`` set, for each task a few rows
    with the number of its shingles in each bucket of the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << ORDER_BITS, np.int64)
        names = ["doc_id", "n", "fa", "fb", "m0", "m1", "m2", "part", "counts"]
        for batch in slices(batches, ROWS_AT_ONCE):
            sets = shingle_sets(batch.column(1), WIDTH)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            everything = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            counts += np.bincount((everything >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=len(counts))
            full = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[full]
            out = np.zeros((6, len(sets)), np.int64)
            out[0] = sizes
            if len(full):
                with np.errstate(over="ignore"):
                    out[1, full] = _signed(np.add.reduceat(mix(everything), starts))
                    out[2, full] = _signed(np.bitwise_xor.reduceat(mix(everything + SEEDS[0]), starts))
                    for k, seed in enumerate(SEEDS):
                        out[3 + k, full] = _signed(np.minimum.reduceat(mix(everything ^ seed), starts))
            none = [pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in out), *none], names=names)
        for part, own in enumerate(np.split(counts, COUNT_PARTS)):
            if own.any():
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none] * 7 + [pa.array([part], pa.int64()), pa.array([own], pa.list_(pa.int64()))], names=names)

    schema = "doc_id long, n long, fa long, fb long, m0 long, m1 long, m2 long, part long, counts array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _order_counts(summaries: DataFrame) -> np.ndarray:
    """Shingles of all documents in each bucket: 2 ** ORDER_BITS numbers, whatever the size of the corpus. Tasks' rows are added up as
    they stream by."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = own.values.to_numpy()
                sums[part] = sums[part] + own if part in sums else own
        for part, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([own], pa.list_(pa.int64()))], names=["part", "counts"])

    rows = summaries.where("part is not null").select("part", "counts")
    found = rows.repartition(COUNT_PARTS, "part").mapInArrow(add, "part long, counts array<long>").toArrow()
    counts = np.zeros((COUNT_PARTS, (1 << ORDER_BITS) // COUNT_PARTS), np.int64)
    for part, own in zip(found["part"].to_pylist(), found["counts"]):
        counts[part] += own.values.to_numpy()
    return counts.reshape(-1)


def prefix_length(n: int, percent: int) -> int:
    """Shingles a set of n posts: two linked sets share one among them, since a link needs ``percent`` of either set to be shared."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _postings(docs: DataFrame, counts, percent: int) -> DataFrame:
    """(sid, n, prefix shingles in the global order) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = counts.value
        for batch in slices(batches, ROWS_AT_ONCE):
            kept, sizes = [], []
            for own in shingle_sets(batch.column(1), WIDTH):
                order = np.lexsort((own, load[(own >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]))
                kept.append(own[order[: prefix_length(len(own), percent)]])
                sizes.append(len(own))
            lengths = np.fromiter(map(len, kept), np.int64, len(kept))
            flat = _signed(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(sizes, np.int64)), lists], names=["sid", "n", "prefix"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "sid long, n long, prefix array<long>")


def _compare(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, na, nb, both) for pairs (a, b) of document ids: sizes of the sets and of their intersection, from whole texts.

    Only texts that a pair asks for are shuffled. A task has one Python worker, which looks at a few megabytes of text at once and cuts the
    set of a text that follows itself only once.
    """
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    texts = among(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), "id", ids)
    side = lambda k: texts.select(F.col("id").alias(k), F.col("text").alias(f"text_{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS_AT_ONCE):
            left = shingle_sets(batch.column(2), WIDTH)
            right = batch.column(3)
            # Rows that repeat an id may differ in text, so neighbours are one set only with equal texts.
            again = pc.equal(right.slice(1), right.slice(0, len(right) - 1)).fill_null(False).to_numpy(zero_copy_only=False)
            which = np.concatenate([[0], np.cumsum(~again)])
            sets = shingle_sets(right.take(pa.array(np.flatnonzero(np.concatenate([[True], ~again])))), WIDTH)
            rows = [sets[k] for k in which]
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(np.array(v, np.int64)) for v in (
                    [len(x) for x in left], [len(y) for y in rows], both))], names=["a", "b", "na", "nb", "both"])

    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long, na long, nb long, both long")


def _near(percent: int):
    return 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))


def _distance():
    return 1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))


def _blocks(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(sid, n, head, gap, linked): every set in one block, ``gap`` its distance to the block's head (0 for a head of its own), and the
    heads it was found to link with."""
    least = sets.select("sid", "n", F.explode(F.array(
        *(F.struct(F.lit(k).alias("k"), F.col(f"m{k}").alias("m")) for k in range(len(SEEDS))))).alias("s")).select("sid", "n", "s.*")
    heads = least.groupBy("k", "m").agg(F.min(F.struct("n", "sid")).alias("h"), F.count("*").alias("c")).where("c > 1")
    tried = (
        least.join(heads, ["k", "m"]).where((F.col("sid") != F.col("h.sid")) & (100 * F.col("h.n") >= percent * F.col("n")))
        .select(F.col("sid").alias("a"), F.col("h.sid").alias("b")).distinct()
    )
    compared = _compare(docs, stored(tried, "tried")).where(_near(percent))
    best = compared.groupBy("a").agg(
        F.min(F.struct(F.col("nb"), F.col("b"), _distance().alias("gap"))).alias("best"), F.collect_set("b").alias("linked"))
    return sets.select("sid", "n").join(best.withColumnRenamed("a", "sid"), "sid", "left").select(
        "sid", "n", F.coalesce("best.b", "sid").alias("head"), F.coalesce("best.gap", F.lit(0.0)).alias("gap"), "linked")


def _lists(docs: DataFrame, blocks: DataFrame, counts, percent: int) -> DataFrame:
    """The index lists that hold several blocks: (token, head, lo, hi, pos, heads), an entry for each block with the range of its sizes
    and its first position.

    Most posted shingles stand in one set only. All postings cross the network once, without their blocks, and end there; what the few shared
    ones need is looked up afterwards.
    """
    ids = stored(blocks.select("sid").distinct(), "posting")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    posted = _postings(among(named, "doc_id", ids), counts, percent).select("sid", "n", F.posexplode("prefix").alias("pos", "token"))
    beside = Window.partitionBy("token").orderBy("sid")
    shared = posted.withColumns({"_before": F.lag("sid").over(beside), "_after": F.lead("sid").over(beside)}).where(
        "_before is not null or _after is not null").drop("_before", "_after")
    shared = stored(shared, "shared")
    entries = shared.join(blocks.select("sid", "head"), "sid").groupBy("token", "head").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("pos").alias("pos"))
    return entries.withColumn("heads", F.count("*").over(Window.partitionBy("token"))).where("heads > 1")


def _fitting(percent: int):
    """Whether blocks l and r of one list may hold members of linked sizes whose first shared shingle stands there: what is left from its
    position on must be as many as a link needs to share."""
    needed = F.ceil(percent * (F.col("l.lo") + F.col("r.lo")) / (100 + percent) - 1e-9)
    return ((100 * F.col("l.hi") >= percent * F.col("r.lo")) & (100 * F.col("r.hi") >= percent * F.col("l.lo"))
            & (F.col("l.hi") - F.col("l.pos") >= needed) & (F.col("r.hi") - F.col("r.pos") >= needed))


def _labelled(lists: DataFrame, found: DataFrame) -> DataFrame:
    own = found.select(F.col("id").alias("head"), "component")
    return lists.join(own, "head", "left").withColumn("label", F.coalesce("component", "head")).drop("component")


def _leading(docs: DataFrame, lists: DataFrame, found: DataFrame, blocks: DataFrame, percent: int, part: int) -> DataFrame:
    """Links of blocks in dense lists with the heads of each list's largest blocks, ranks ``part * LEADERS`` and following."""
    dense = _labelled(lists.where(F.col("heads") >= DENSE), found)
    weighed = dense.join(blocks.groupBy("head").agg(F.count("*").alias("members")), "head")
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("members"), "head"))
    top = weighed.withColumn("rank", rank).where(F.col("rank") <= (part + 1) * LEADERS).where(F.col("rank") > part * LEADERS)
    tried = dense.alias("l").join(top.alias("r"), "token").where((F.col("l.label") != F.col("r.label")) & _fitting(percent))
    pairs = tried.select(F.col("l.head").alias("a"), F.col("r.head").alias("b")).distinct()
    return _compare(docs, stored(pairs, "leading")).where(_near(percent)).select("a", "b")


def _meetings(lists: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of blocks of different components that meet in a list and that neither sizes nor positions rule out."""
    own = _labelled(lists, found)
    met = own.alias("l").join(own.alias("r"), "token").where(
        (F.col("l.head") < F.col("r.head")) & (F.col("l.label") != F.col("r.label")) & _fitting(percent))
    return met.select(F.col("l.head").alias("a"), F.col("r.head").alias("b")).distinct()


def _ring_links(docs: DataFrame, ring: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Links between members of blocks (a, b) whose heads do not link but whose radii leave room for members that do."""
    far = 1 - percent / 100 + 1e-12
    own = ring.select("a", "b").union(ring.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Members of block a against the head of block b.
    crossed = stored(_compare(docs, blocks.join(own, blocks["head"] == own["a"]).select(
        F.col("sid").alias("a"), F.col("b")).where("a != b").distinct()), "crossed")
    links = crossed.where(_near(percent)).select("a", "b")
    open_ = crossed.where(~_near(percent)).select(F.col("a").alias("sid"), F.col("b").alias("other"), _distance().alias("d"))
    member = blocks.select("sid", "head", "gap", "n").join(open_, "sid")
    x, y = member.alias("x"), member.alias("y")
    pairs = x.join(y, (F.col("x.head") == F.col("y.other")) & (F.col("y.head") == F.col("x.other")) & (F.col("x.head") < F.col("y.head"))
                   & (F.col("x.d") - F.col("y.gap") <= far) & (F.col("y.d") - F.col("x.gap") <= far)
                   & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")))
    last = _compare(docs, stored(pairs.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")), "last")).where(_near(percent))
    return links.union(last.select("a", "b"))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links: the earlier ones stand for all links they came from."""
    links = stored(links, "further")
    if links.isEmpty():
        return found
    return components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))


def similar_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id, head_id) of every row of ``docs``; ``set_id`` is the smallest document with the
    identical set, ``head_id`` the head of its block."""
    with small_batches(docs.sparkSession):  # all work in Python workers is done in here, into stored tables
        return _similar_components(docs, percent)


def _similar_components(docs: DataFrame, percent: int) -> DataFrame:
    spark = docs.sparkSession
    summaries = stored(_summaries(docs), "summaries")
    rows = summaries.where("part is null")
    full = rows.where("n > 0 and doc_id is not null")
    sets = full.groupBy("fa", "fb", "n").agg(
        F.min("doc_id").alias("sid"), *(F.min(f"m{k}").alias(f"m{k}") for k in range(len(SEEDS))))
    sets = stored(sets, "sets")
    blocks = stored(_blocks(docs, sets, percent), "blocks")
    counts = spark.sparkContext.broadcast(_order_counts(summaries))
    lists = stored(_lists(docs, blocks, counts, percent), "lists")
    links = blocks.where("linked is not null").select(F.col("sid").alias("a"), F.explode("linked").alias("b"))
    found = components(links)
    for part in range(ROUNDS):
        found = _joined(found, _leading(docs, lists, found, blocks, percent, part))
    met = stored(_meetings(lists, found, percent), "met")
    radius = blocks.groupBy("head").agg(F.max("gap").alias("r"))
    compared = stored(
        _compare(docs, met)
        .join(radius.select(F.col("head").alias("a"), F.col("r").alias("ra")), "a")
        .join(radius.select(F.col("head").alias("b"), F.col("r").alias("rb")), "b")
        .where(_near(percent) | (_distance() <= F.col("ra") + F.col("rb") + (1 - percent / 100 + 1e-12))), "compared")
    found = _joined(found, compared.where(_near(percent)).select("a", "b"))
    ring = compared.where(~_near(percent)).select("a", "b")
    of = lambda k: found.select(F.col("id").alias(k), F.col("component").alias(f"c_{k}"))
    ring = ring.join(of("a"), "a", "left").join(of("b"), "b", "left").where(
        F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    ring = stored(ring, "ring")
    if not ring.isEmpty():
        found = _joined(found, _ring_links(docs, ring, blocks, percent))
    named = sets.select("fa", "fb", "n", "sid").join(blocks.select("sid", "head"), "sid").join(
        found.select(F.col("id").alias("sid"), "component"), "sid", "left")
    joined = rows.where("doc_id is not null").select("doc_id", "n", "fa", "fb").join(
        named.select("n", "fa", "fb", "sid", "head", F.coalesce("component", "sid").alias("c")), ["n", "fa", "fb"], "left")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"),
        F.coalesce("sid", "doc_id").alias("set_id"), F.coalesce("head", "doc_id").alias("head_id")
    ).unionByName(rows.where("doc_id is null").select(
        "doc_id", F.col("n").alias("n_shingles"), *(F.lit(None).cast("long").alias(c) for c in ("component_id", "set_id", "head_id"))))


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest doc_id.

    Decided by row: rows that repeat an id with other texts are documents of their own (the smaller hash of the text comes first), rows
    that repeat an id and its text are one. Rows without an id stay.
    """
    keyed = docs.withColumns({"_text": F.xxhash64("text"), "_row": F.col("doc_id").cast("long")})
    marks = stored(keyed.where("_row is not null").select("_row", "_text"), "marks")
    repeated = stored(marks.groupBy("_row").agg(F.min("_text").alias("_lo"), F.max("_text").alias("_hi"), F.count("*").alias("_n")).where("_n > 1"), "repeated")
    copied = not repeated.isEmpty()
    if copied:
        several = repeated.where("_lo < _hi").select("_row", F.lit(True).alias("_several"))
        own = F.when(F.col("_several"), F.xxhash64("_row", "_text")).otherwise(F.col("_row"))
        keyed = keyed.join(several, "_row", "left").withColumn("_row", own).drop("_several")
    found = similar_components(keyed.select(F.col("_row").alias("doc_id"), "text"), percent)
    found = found.where("doc_id is not null").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")).distinct()
    if copied:
        ids = keyed.where("_row is not null").select("_row", F.col("doc_id").cast("long").alias("_id")).distinct()
        first = stored(found.join(ids, "_row"), "found")
        kept = first.groupBy("_group").agg(F.min(F.struct("_id", "_row")).alias("_k")).select("_group", F.col("_k._row").alias("_kept"))
        gone = first.join(kept, "_group").where("_row != _kept").select("_row")
    else:
        gone = found.where("_group != _row").select("_row")
    left = keyed.join(gone, "_row", "left_anti")
    if copied:
        twice = keyed.groupBy("_row").count().where("_row is not null and count > 1").select("_row")
        left = left.join(twice, "_row", "left_anti").unionByName(left.join(twice, "_row", "left_semi").dropDuplicates(["_row"]))
    return left.select(docs.columns)
