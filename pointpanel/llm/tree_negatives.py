"""Hard-negative mining with bounds along a spanning tree of the anchors.

A score is the integer inner product of two scaled vectors. An anchor's positives are its best rows of the same label; its hard negatives for
a positive are the best rows of other labels whose scores lie in a window below the positive's score.

Anchors are dealt into chunks, and a minimum spanning tree joins those of a chunk. In a block of candidates the root's scores are computed.
Along an edge of length e the score of a candidate x changes by at most e * |x|, so a parent's scores, plus and minus that, bound its child's.
Only candidates whose bounds overlap what the child asks for are scored again:

1. Positives: of the rows of the anchor's label those whose upper bound reaches the k-th largest lower bound.
2. Negatives: of the rows of other labels those whose bounds overlap one of the anchor's windows.

Bounds of a parent are dropped once its last child has its own, and the child with the most descendants comes last, so a task holds the bounds
of about log2(chunk) anchors. Chunks meet all blocks (a stated query set against all rows, in blocks): a task holds one block and one chunk,
both of bounded size, and gives a few rows for each anchor, which windows merge after pruning in each task. No label, group of equal
vectors or anchor is ever collected.

Defined results: rows with a null id, label or vector, an empty vector, a null or non-finite component or one of 65,536 or more take no part, neither
do vectors of another length than the most common one (the smallest of these); of rows that repeat an id the one of the smallest label takes
part, then of the smallest vector; ties go to the smaller id; anchors without positives, and windows without rows, return nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointpanel.session import stored

#: Rows of a block of candidates, anchors of a chunk.
BLOCK_ROWS, CHUNK_ROWS = 8192, 2048
#: Components below this bound give scores that 64 bits hold.
LARGEST = 65_536.0


def _usable(table: DataFrame, label: Column, scale: int) -> DataFrame:
    """(id, label, v): the rows that take part, with whole components."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & label.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    whole = F.transform(v, lambda x: F.floor(x * float(scale)))
    rows = table.where(fine).select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def _matrix(column, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree from point 0: parents come before their children, and of the children of a point
    the one with the most descendants comes last. ``parent`` is -1 for the root."""
    n = len(points)
    squares = (points * points).sum(1)
    parent, best, inside = np.full(n, -1), np.full(n, np.inf), np.zeros(n, bool)
    best[0], added = 0.0, []
    for _ in range(n):
        near = int(np.where(inside, np.inf, best).argmin())
        inside[near] = True
        added.append(near)
        away = np.maximum(squares + squares[near] - 2 * (points @ points[near]), 0)
        closer = ~inside & (away < best)
        best[closer], parent[closer] = away[closer], near
    edge = np.zeros(n)
    for k in added[1:]:
        edge[k] = np.sqrt(((points[k] - points[parent[k]]) ** 2).sum())
    below, children = np.ones(n, int), [[] for _ in range(n)]
    for k in reversed(added[1:]):
        below[parent[k]] += below[k]
        children[parent[k]].append(k)
    order, todo = [], [0] if n else []
    while todo:
        k = todo.pop()
        order.append(k)
        todo += sorted(children[k], key=lambda c: (-below[c], c))  # the last one pushed is the next one visited
    return np.array(order, int), parent, edge


class Bounds:
    """Lower and upper bounds of the scores of a block's rows with each anchor of a chunk, in the order of the tree."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray, parents: np.ndarray, edges: np.ndarray):
        exact = float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * rows.shape[1] < 2.0**53
        kind = np.float64 if exact else np.int64  # products of doubles are exact as long as all sums stay below 2^53
        self.rows, self.anchors = rows.astype(kind), anchors.astype(kind)
        self.norms = np.sqrt((rows.astype(float) ** 2).sum(1)) * (1 + 1e-12)
        self.parents, self.edges = parents, edges
        self.waiting = np.bincount(parents[parents >= 0], minlength=len(parents))
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.scored = 0

    def scores(self, k: int, at: np.ndarray) -> np.ndarray:
        self.scored += len(at)
        chosen = self.rows if len(at) == len(self.rows) else self.rows[at]
        return (chosen @ self.anchors[k]).astype(np.int64)

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Own bounds of anchor k, to be tightened by ``settle``; the parent's are dropped after its last child."""
        p = self.parents[k]
        if p < 0:
            own = self.scores(k, np.arange(len(self.rows))).astype(float)
            low, high = own, own.copy()
        else:
            low, high = self.held[p]
            slack = self.norms * self.edges[k] * (1 + 1e-9) + 1e-6
            low, high = low - slack, high + slack
            self.waiting[p] -= 1
            if not self.waiting[p]:
                del self.held[p]
        if self.waiting[k]:
            self.held[k] = (low, high)
        return low, high

    def settle(self, k: int, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The scores of rows ``at`` with anchor k, which its bounds hold from now on."""
        own = self.scores(k, at)
        low[at] = high[at] = own
        return own


def best_alike(bounds: Bounds, ids: np.ndarray, labels: np.ndarray, anchor_ids: np.ndarray, anchor_labels: np.ndarray, most: int):
    """(anchor, rows, scores): at least the ``most`` best rows of each anchor's label, the anchor itself left out."""
    for k in range(len(anchor_ids)):
        low, high = bounds.of(k)
        alike = np.flatnonzero((labels == anchor_labels[k]) & (ids != anchor_ids[k]))
        if len(alike) > most:
            alike = alike[high[alike] >= np.partition(low[alike], len(alike) - most)[-most]]
        if len(alike):
            own = bounds.settle(k, alike, low, high)
            first = np.lexsort((ids[alike], -own))[:most]
            yield k, alike[first], own[first]


def best_in_windows(bounds: Bounds, ids: np.ndarray, labels: np.ndarray, anchor_labels: np.ndarray, windows: list, most: int):
    """(anchor, window, rows, scores): the ``most`` best rows of other labels in each of the anchor's windows (lowest, highest)."""
    for k, asked in enumerate(windows):
        low, high = bounds.of(k)
        overlap = np.zeros(len(ids), bool)
        for least, largest in asked:
            if least <= largest:
                overlap |= (high >= least) & (low <= largest)
        other = np.flatnonzero(overlap & (labels != anchor_labels[k]))
        if not len(other):
            continue
        own = bounds.settle(k, other, low, high)
        order = np.lexsort((ids[other], -own))
        other, own = other[order], own[order]
        for w, (least, largest) in enumerate(asked):
            start, stop = np.searchsorted(-own, [-largest, -least + 1])
            stop = min(stop, start + most)
            if start < stop:
                yield k, w, other[start:stop], own[start:stop]


def hard_negatives(
    table: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, lowest: int = 80, highest: int = 100, scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``table`` (vec_id, embedding).

    ``is_anchor`` is a condition on ``id``, ``label`` a column of the table. A window holds the scores s with
    ``lowest * positive_score <= 100 * s <= highest * positive_score``.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    points = stored(_usable(table, label, scale), "points")
    lengths = points.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if lengths is None:
        return table.sparkSession.createDataFrame([], schema)
    dims = lengths["dims"]
    points = points.where(F.size("v") == dims)
    anchors = points.where(is_anchor)
    blocks, chunks = max(1, -(-lengths["count"] // BLOCK_ROWS)), max(1, -(-anchors.count() // CHUNK_ROWS))

    def grow(batch: pa.Table) -> pa.Table:
        order, parent, edge = spanning_tree(_matrix(batch.column("v"), dims).astype(float))
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        up = parent[order]
        out = batch.take(pa.array(order))
        return out.append_column("place", pa.array(np.arange(len(order)))).append_column(
            "parent", pa.array(np.where(up < 0, -1, place[up]))).append_column("edge", pa.array(edge[order]))

    dealt = anchors.select("id", "label", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks)).alias("chunk"))
    tree = stored(dealt.groupBy("chunk").applyInArrow(
        grow, "id long, label long, v array<long>, chunk long, place long, parent long, edge double"), "tree")
    cell = lambda b, c: (F.col(b) * F.lit(chunks) + F.col(c)).alias("cell")
    rows = points.select("id", "label", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b")).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("id", "label", "v", cell("b", "c"))
    each = lambda frame, *more: frame.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "id", "label", "v", "place", "parent", "edge", *more, cell("b", "chunk"))

    def start(left: pa.Table, right: pa.Table):
        right = right.sort_by("place")
        numbers = lambda t, c: t.column(c).to_numpy()
        bounds = Bounds(_matrix(left.column("v"), dims), _matrix(right.column("v"), dims), numbers(right, "parent"), numbers(right, "edge"))
        return right, bounds, *(numbers(t, c) for t in (left, right) for c in ("id", "label"))

    def together(found: list, fields: list[str]) -> pa.Table:
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64) for _ in fields]
        return pa.table({f: pa.array(c.astype(np.int64)) for f, c in zip(fields, columns)})

    def alike(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            _, bounds, ids, labels, anchor_ids, anchor_labels = start(left, right)
            for k, at, own in best_alike(bounds, ids, labels, anchor_ids, anchor_labels, positives):
                found.append((np.full(len(at), anchor_ids[k]), ids[at], own))
        return together(found, ["anchor_id", "positive_id", "positive_score"])

    def best(frame: DataFrame, keys: list[str], score: str, by: str, most: int) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.desc(score), by)
        return frame.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)

    near = rows.groupBy("cell").cogroup(each(tree).groupBy("cell")).applyInArrow(
        alike, "anchor_id long, positive_id long, positive_score long")
    chosen = stored(best(near, ["anchor_id"], "positive_score", "positive_id", positives), "positives")
    s = F.col("positive_score")
    # Division that rounds up and down, for scores of either sign.
    least = F.expr(f"({lowest} * positive_score + pmod(-{lowest} * positive_score, 100L)) div 100L")
    largest = F.expr(f"({highest} * positive_score - pmod({highest} * positive_score, 100L)) div 100L")
    asked = chosen.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.col("positive_id").alias("p"), s.alias("s"), least.alias("lo"), largest.alias("hi")))).alias("w"))
    asking = stored(tree.join(asked.withColumnRenamed("anchor_id", "id"), "id", "left"), "asking")

    def others(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            right, bounds, ids, labels, anchor_ids, anchor_labels = start(left, right)
            windows = right.column("w").to_pylist()
            ranges = [[(x["lo"], x["hi"]) for x in own or []] for own in windows]
            for k, w, at, own in best_in_windows(bounds, ids, labels, anchor_labels, ranges, negatives):
                at_all = lambda x: np.full(len(at), x)  # noqa: B023, E731
                found.append((at_all(anchor_ids[k]), at_all(windows[k][w]["p"]), ids[at], at_all(windows[k][w]["s"]), own))
        return together(found, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    hard = rows.groupBy("cell").cogroup(each(asking, "w").groupBy("cell")).applyInArrow(
        others, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    return best(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
