"""Approximate nearest neighbours by stable projections: an incremental kd-tree search that a chi-square test stops.

Largest inner products are nearest points in one more dimension: with the largest norm M of all vectors, a vector x becomes
(x, sqrt(M^2 - |x|^2)) and a query (q, 0). Points are projected on a few directions of a 2-stable (normal) distribution, so a projected
squared distance is the true one times a chi-square variable. Each block of vectors is indexed by a kd-tree over its projections. A
query takes projected neighbours in the order of their cells and verifies them by inner products on the original vectors, until the
chi-square test says that a point as near as the k-th found would, with probability ``CONFIDENCE``, already have appeared.

Work is dealt in blocks: vectors by a hash into blocks of a bounded number of rows, and each query to every block. Equal vectors are one
point that carries its smallest ids, as many as an answer can hold, and equal queries are searched once. The blocks' answers are merged
by a window whose input is pruned to k rows for each query and task.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, neither do vectors of another
length than the most common one (the smallest of these) or null ids; repeated rows of an id are one candidate (the largest product
counts); fewer candidates than k give fewer rows; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pointpanel.session import stored

DIRECTIONS = 8
CONFIDENCE = 0.98
#: Points in a cell of a tree, distinct vectors in a block, queries in a chunk.
CELL, BLOCK_ROWS, CHUNK_ROWS = 64, 16_384, 2048
SEED = 5


def chi_square_quantile(p: float, freedom: int) -> float:
    """The value a chi-square variable with an even number of degrees of freedom stays below with probability p."""
    if freedom % 2:
        raise ValueError("an even number of directions is needed")

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1 - np.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def directions(dims: int, count: int) -> np.ndarray:
    """The same normal directions in every process, for points with the added dimension."""
    return np.random.default_rng(SEED).standard_normal((dims + 1, count))


class Tree:
    """A kd-tree whose leaves are cells of near points: their order, bounds and boxes in the projected space."""

    def __init__(self, points: np.ndarray):
        order, cells = np.arange(len(points)), []
        todo = [(0, len(points))]
        while todo:
            a, b = todo.pop()
            own = points[order[a:b]]
            spread = own.max(0) - own.min(0)
            if b - a <= CELL or not spread.max():
                cells.append((a, b))
                continue
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, int(spread.argmax())], middle)]
            todo += [(a, a + middle), (a + middle, b)]
        self.order, self.cells = order, sorted(cells)
        self.low = np.array([points[order[a:b]].min(0) for a, b in self.cells])
        self.high = np.array([points[order[a:b]].max(0) for a, b in self.cells])

    def by_distance(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells in the order of their boxes' squared distances from the query, and these."""
        gap = np.maximum(np.maximum(self.low - query, query - self.high), 0)
        squared = (gap * gap).sum(1)
        order = np.argsort(squared, kind="stable")
        return order, squared[order]


def search_block(vectors: np.ndarray, queries: np.ndarray, norm: float, k: int, tree: Tree, axes: np.ndarray) -> list[tuple]:
    """For each query (points of the block, inner products) of at least its k nearest that the test admits.

    Verified are cells in the order of the tree, a few at first and then twice as many, as long as the test allows.
    """
    limit = chi_square_quantile(CONFIDENCE, axes.shape[1])
    projected = queries @ axes[:-1]
    out = []
    for q, own in zip(queries, projected):
        order, near = tree.by_distance(own)
        reach, base = np.inf, norm * norm + q @ q
        ids, scores, at, step = [], [], 0, 4
        best = np.zeros(0)
        while at < len(order) and near[at] <= reach:
            stop = min(at + step, int(np.searchsorted(near, reach, side="right")))
            points = np.concatenate([tree.order[a:b] for a, b in (tree.cells[c] for c in order[at:stop])])
            found = vectors[points] @ q
            ids.append(points)
            scores.append(found)
            best = np.concatenate([best, found])
            if len(best) >= k:
                best = np.partition(best, len(best) - k)[-k:]
                reach = limit * max(base - 2 * best.min(), 0.0)  # the k-th squared distance times the quantile
            at, step = stop, step * 2
        points, found = np.concatenate(ids), np.concatenate(scores)
        keep = found >= (best.min() if len(best) >= k else -np.inf)
        out.append((points[keep], found[keep]))
    return out


def _usable(table: DataFrame) -> DataFrame:
    """(id, v): the rows that take part, in double precision."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(fine)


def nearest(table: DataFrame, is_query, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each row for which ``is_query`` (a condition on ``id``) holds
    with all other rows of ``table`` (vec_id, embedding)."""
    points = _usable(table)
    sizes = points.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dims = sizes["dims"]
    points = points.where(F.size("v") == dims)
    # Of equal vectors an answer can hold k others, so the k + 1 smallest ids do.
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    ids = points.distinct().withColumn("n", first).where(F.col("n") <= k + 1)
    groups = stored(ids.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vectors")
    asked = stored(points.where(is_query).select("id", "v").distinct().withColumn("key", F.xxhash64("v", F.lit(1))), "asked")
    queries = asked.groupBy("key", "v").agg(F.count("*").alias("n")).select("key", "v")
    stats = groups.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    blocks, norm = max(1, -(-stats["n"] // BLOCK_ROWS)), float(np.sqrt(stats["m"])) * (1 + 1e-12)
    axes = directions(dims, DIRECTIONS)

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"key": [], "ids": [], "score": []}
        if left.num_rows and right.num_rows:
            matrix = lambda t: np.array(t.column("v").combine_chunks().flatten(), dtype=float).reshape(-1, dims)
            vectors, asks = matrix(left), matrix(right)
            lifted = np.column_stack([vectors, np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(1), 0))])
            tree = Tree(lifted @ axes)
            ids, keys = left.column("ids").combine_chunks(), right.column("key").to_pylist()
            for n, (hit, score) in enumerate(search_block(vectors, asks, norm, k + 1, tree, axes)):
                found["key"] += [keys[n]] * len(hit)
                found["ids"] += ids.take(pa.array(hit)).to_pylist()
                found["score"] += score.tolist()
        return pa.table({"key": pa.array(found["key"], pa.int64()), "ids": pa.array(found["ids"], pa.list_(pa.int64())),
                         "score": pa.array(found["score"], pa.float64())})

    n_queries = max(1, asked.count())
    chunks = max(1, -(-n_queries // CHUNK_ROWS))
    cell = lambda b, c: (b * F.lit(chunks) + c).alias("cell")
    of_block = F.pmod(F.xxhash64("v"), F.lit(blocks))
    spread = groups.select("v", "ids", of_block.alias("b")).select("v", "ids", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"), "b")
    base = spread.select("v", "ids", cell(F.col("b"), F.col("c")))
    asks = queries.select("v", "key", F.pmod("key", F.lit(chunks)).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    asks = asks.select("v", "key", cell(F.col("b"), F.col("c")))
    hits = base.groupBy("cell").cogroup(asks.groupBy("cell")).applyInArrow(search, "key long, ids array<long>, score double")
    # The k + 1 best groups of each query hold its k best others.
    ranked = Window.partitionBy("key").orderBy(F.desc("score"), F.col("ids")[0])
    best = hits.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k + 1)
    pairs = asked.select(F.col("id").alias("query_id"), "key").join(best, "key").select(
        "query_id", F.explode("ids").alias("vec_id"), "score").where("query_id != vec_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
