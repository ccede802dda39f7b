"""Prefix trie of conversations from sorted sequences, their common prefixes and a sparse table of range minima.

Each turn is a digest and each conversation the sequence of its digests. Sequences are sorted over the cluster, so the members of a prefix are
neighbours, and cut into blocks. In a block, ``lcp`` says how many turns a sequence shares with the one before it. A prefix of d turns that
starts at a row reaches left and right as long as the minimum of ``lcp`` stays at d or more: each candidate prefix finds both ends for itself
by a binary search over a sparse table of range minima (steps of halving length), all candidates of a block at once, without a stack.

All that a node has follows from its interval of members [l, r]: the smallest member by another sparse table; children and leaves from counts
of rows by ``lcp``; and the saved bytes of its subtree, which are the bytes that each member but the first shares with the member before it,
less the bytes above the node. Intervals that end inside a block are done. Those that reach its edge (at most two of each depth) give partial
sums that are added up over blocks by the prefix's fingerprint, so the root and a first turn that a third of all conversations share cost one
row a block. A block learns the sequences beside it from its partition, or from one (first, last) row a partition at partition edges.

A task holds the digests of one block, and of one conversation while its turns are put in order: 24 bytes a turn. The ids that end at a node
which several blocks share are hashed in a stream, in order, in one task a node and in constant memory, as the hash asks for.

Defined results: rows without a conv_id take no part; null roles and texts are empty; turns of equal number are ordered by role, then text;
repeated rows are turns of their own; an empty table has no nodes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointpanel.llm.words import mix
from pointpanel.session import stored

#: Conversations, and turns, of a block.
BLOCK_ROWS, BLOCK_TURNS = 4096, 400_000
#: Shared nodes that are sent to every task; more are joined by a shuffle.
BROADCAST_NODES = 200_000
WIDTH = 16
NO_IDS = hashlib.sha256(b"").hexdigest()
NODE = "fa long, fb long, depth long, up_a long, up_b long, conv_id long, parent_conv_id long, n long, children long, leaves long, bytes long, above long"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): the turns of each conversation, numbered from 1."""
    clean = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return clean.select("conv_id", F.row_number().over(w).cast("long").alias("pos"), "role", "text")


def forked(conversations: DataFrame, kept: Column, origin: Column) -> DataFrame:
    """(conv_id, depth, role, text) of conversations that begin with the first ``kept`` turns of conversation ``origin`` and go on with their own
    turns after as many; ``depth`` is null in the one row of a conversation that is left without turns. Both are columns of conv_id."""
    turns = stored(ordered_turns(conversations), "turns")
    lengths = stored(turns.groupBy("conv_id").agg(F.max("pos").alias("n")).withColumns({"_kept": kept, "_origin": origin}), "lengths")
    held = lengths.join(lengths.select(F.col("conv_id").alias("_origin"), F.col("n").alias("_there")), "_origin", "left").withColumn(
        "_taken", F.least("_kept", F.coalesce("_there", F.lit(0))))
    own = turns.join(held.select("conv_id", "_kept", "_taken"), "conv_id").where(F.col("pos") > F.col("_kept")).select(
        "conv_id", (F.col("_taken") + F.col("pos") - F.col("_kept")).alias("depth"), "role", "text")
    first = held.where("_taken > 0").select("conv_id", "_origin", "_taken").join(
        turns.withColumnRenamed("conv_id", "_origin"), "_origin").where(F.col("pos") <= F.col("_taken")).select(
        "conv_id", F.col("pos").alias("depth"), "role", "text")
    none = F.lit(None)
    bare = held.where((F.col("_taken") == 0) & (F.col("n") <= F.col("_kept"))).select(
        "conv_id", none.cast("long").alias("depth"), none.cast("string").alias("role"), none.cast("string").alias("text"))
    return own.unionByName(first).unionByName(bare)


def _sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): the digests of a conversation's turns, one after the other, and the bytes of their texts."""
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    one = F.when(F.col("depth").isNotNull(), F.struct(
        "depth", digest.alias("digest"), F.octet_length("text").cast("long").alias("size")))
    listed = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return listed.select("conv_id", F.unhex(F.array_join("ts.digest", "")).alias("key"), F.col("ts.size").alias("sizes"))


def _blocked(sequences: DataFrame) -> DataFrame:
    """The sequences in order, with their partition, block and place, and at the edges of blocks the key of the row beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block, rows, turns, place, last, held = 0, 0, 0, 0, None, None

        def out(chunk: pa.Table, follower: bytes | None) -> pa.RecordBatch:
            nonlocal block, rows, turns, place, last
            keys = chunk.column("key").to_pylist()
            blocks, before, after = [], [], []
            for k, key in enumerate(keys):
                turns_here = len(key) // WIDTH
                begins = rows > 0 and (rows >= BLOCK_ROWS or turns + turns_here > BLOCK_TURNS)
                if begins:
                    block, rows, turns = block + 1, 0, 0
                before.append(last if begins else None)
                follows = keys[k + 1] if k + 1 < len(keys) else follower
                rows, turns = rows + 1, turns + turns_here
                ends = follows is not None and (rows >= BLOCK_ROWS or turns + len(follows) // WIDTH > BLOCK_TURNS)
                after.append(follows if ends else None)
                blocks.append(block)
                last = key
            n = len(keys)
            places = np.arange(place, place + n)
            place += n
            table = chunk.append_column("part", pa.array(np.full(n, part))).append_column("block", pa.array(blocks, pa.int64())).append_column(
                "place", pa.array(places)).append_column("before", pa.array(before, pa.binary())).append_column("after", pa.array(after, pa.binary()))
            return table.combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            chunk = pa.Table.from_batches([*([held] if held is not None else []), batch]).combine_chunks()
            if chunk.num_rows > 1:
                yield out(chunk.slice(0, chunk.num_rows - 1), chunk.column("key")[-1].as_py())
            held = chunk.slice(chunk.num_rows - 1).to_batches()[0]
        if held is not None:
            yield out(pa.Table.from_batches([held]), None)

    schema = "conv_id long, key binary, sizes array<long>, part long, block long, place long, before binary, after binary"
    return sequences.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(run, schema)


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two sequences have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax()) // WIDTH


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds at i the minimum of the 2 ** k values from i on."""
    levels, step = [values], 1
    while 2 * step <= len(values):
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
        step *= 2
    return levels


def extents(levels: list[np.ndarray], rows: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last row of the interval around each row in which neighbours share ``depths`` turns; levels[0] is lcp."""
    n = len(levels[0])
    left, right = rows.copy(), rows.copy()
    for k in range(len(levels) - 1, -1, -1):
        step, level = 1 << k, levels[k]
        at = left - step + 1
        go = (at >= 1) & (level[np.maximum(at, 0)] >= depths)
        left = np.where(go, left - step, left)
        at = right + 1
        go = (at + step <= n) & (level[np.minimum(at, len(level) - 1)] >= depths)
        right = np.where(go, right + step, right)
    return left, right


def range_minimum(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The minimum from left to right, both included."""
    k = np.frexp(right - left + 1)[1] - 1
    out = np.empty(len(left), levels[0].dtype)
    for level in np.unique(k):
        own = k == level
        out[own] = np.minimum(levels[level][left[own]], levels[level][right[own] - (1 << int(level)) + 1])
    return out


def block_nodes(ids: np.ndarray, keys: list[bytes], sizes: np.ndarray, before: bytes | None, after: bytes | None) -> dict[str, np.ndarray | list]:
    """The nodes of a block: whole ones, parts of those that reach beyond it (``open``), and what ends at each node.

    ``before`` and ``after`` are the sequences beside the block.
    """
    n = len(keys)
    lengths = np.fromiter((len(k) // WIDTH for k in keys), np.int64, n)
    starts = np.cumsum(lengths) - lengths
    inner = np.array([0, *(shared_turns(a, b) for a, b in zip(keys[:-1], keys[1:]))], np.int64)
    ahead = -1 if before is None else shared_turns(before, keys[0])
    behind = -1 if after is None else shared_turns(keys[-1], after)
    levels, smallest = sparse_table(inner), sparse_table(ids)

    digests = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    depth_of = (np.arange(len(digests)) - np.repeat(starts, lengths) + 1).astype(np.uint64)
    with np.errstate(over="ignore"):
        marks = [mix(mix(digests[:, c] + mix(digests[:, 1 - c])) + depth_of * np.uint64(0x9E3779B97F4A7C15)) for c in (0, 1)]
    sums = [np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(m)]) if len(m) else np.zeros(1, np.uint64) for m in marks]
    total = np.concatenate([[0], np.cumsum(sizes)])
    mark = lambda c, row, d: (sums[c][starts[row] + d] ^ sums[c][starts[row]]).view(np.int64)
    size_to = lambda row, d: total[starts[row] + d] - total[starts[row]]

    # Candidates: the root, and each prefix of a row that the row before it does not have.
    fresh = lengths - inner
    rows = np.concatenate([[0], np.repeat(np.arange(n), fresh)])
    offset = np.arange(fresh.sum()) - np.repeat(np.cumsum(fresh) - fresh, fresh)
    depths = np.concatenate([[0], np.repeat(inner, fresh) + offset + 1])
    left, right = extents(levels, rows, depths)
    goes_left, goes_right = (left == 0) & (ahead >= depths), (right == n - 1) & (behind >= depths)
    open_ = goes_left | goes_right
    up = np.maximum(depths - 1, 0)
    up_left, up_right = extents(levels, rows, up)
    up_open = ((up_left == 0) & (ahead >= up)) | ((up_right == n - 1) & (behind >= up))

    # What each row adds to the nodes that hold it.
    lcp = inner.copy()
    lcp[0] = max(ahead, 0)
    following = np.append(inner[1:], behind)
    leaf = np.concatenate([[0], np.cumsum(following < lengths)])
    common = np.concatenate([[0], np.cumsum(size_to(np.arange(n), lcp))])
    branch = np.flatnonzero((lengths > inner) & (np.arange(n) > 0))
    codes = np.sort(inner[branch] * (n + 1) + branch)
    children = np.searchsorted(codes, depths * (n + 1) + right, side="right") - np.searchsorted(codes, depths * (n + 1) + left, side="right")
    children += (lcp[left] <= depths) & (depths < lengths[left])
    above = size_to(left, up)
    # Rows that end at a node stand first in its interval.
    same = np.append((inner[1:] == lengths[1:]) & (lengths[1:] == lengths[:-1]), False)
    stop = np.flatnonzero(~same)
    run_end = stop[np.searchsorted(stop, np.arange(n))]
    ending = lengths[left] == depths
    return {
        "fa": mark(0, left, depths), "fb": mark(1, left, depths), "depth": depths, "up_a": mark(0, left, up), "up_b": mark(1, left, up),
        "conv_id": range_minimum(smallest, left, right), "parent_conv_id": range_minimum(smallest, up_left, up_right), "up_open": up_open,
        "n": right - left + 1, "children": children, "leaves": leaf[right + 1] - leaf[left],
        "bytes": common[right + 1] - np.where(goes_left, common[left], common[left + 1]), "above": above, "open": open_,
        "ends": [(int(a), int(run_end[a]) + 1) if e else None for a, e in zip(left, ending)],
    }


def _hashed(rows: DataFrame) -> DataFrame:
    """(fa, fb, depth, ends_sha256) of rows (fa, fb, depth, conv_id): the ids of a node in order, hashed as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        names = ["fa", "fb", "depth", "ends_sha256"]

        def row(node, state) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, (*node, state.hexdigest())))], schema=pa.schema(
                [(c, pa.int64()) for c in names[:3]] + [("ends_sha256", pa.string())]))

        for batch in batches:
            table = np.column_stack([batch.column(c).to_numpy() for c in range(4)])
            cuts = np.flatnonzero(np.any(table[1:, :3] != table[:-1, :3], axis=1)) + 1 if len(table) else []
            for part in np.split(table, cuts):
                if not len(part):
                    continue
                own = tuple(part[0, :3].tolist())
                text = ",".join(map(str, part[:, 3].tolist()))
                if own != node:
                    if node is not None:
                        yield row(node, state)
                    node, state = own, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if node is not None:
            yield row(node, state)

    key = ["fa", "fb", "depth"]
    return rows.select(*key, "conv_id").repartition(*key).sortWithinPartitions(*key, "conv_id").mapInArrow(
        run, "fa long, fb long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node of the trie of ``turns``
    (conv_id, depth from 1 without gaps, role, text); a row without depth states a conversation without turns."""
    blocks = stored(_blocked(_sequences(turns)), "blocks")
    # One row a partition, which is what range partitioning itself sends to the driver.
    edges = sorted((r["part"], bytes(r["lo"]), bytes(r["hi"])) for r in blocks.groupBy("part").agg(
        F.min("key").alias("lo"), F.max("key").alias("hi")).collect())
    beside = {p: (edges[k - 1][2] if k else None, edges[k + 1][1] if k + 1 < len(edges) else None) for k, (p, _, _) in enumerate(edges)}
    beside = turns.sparkSession.sparkContext.broadcast(beside)

    def nodes(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("place").combine_chunks()
        keys, ids = block.column("key").to_pylist(), block.column("conv_id").to_numpy()
        sizes = block.column("sizes").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        before, after = block.column("before")[0].as_py(), block.column("after")[-1].as_py()
        outer = beside.value[key[0].as_py()]
        before = outer[0] if before is None and key[1].as_py() == 0 else before
        after = outer[1] if after is None else after
        found = block_nodes(ids, keys, sizes, before, after)
        open_ = found["open"]
        hashes = [None if o else NO_IDS if e is None else hashlib.sha256(",".join(map(str, ids[e[0]:e[1]].tolist())).encode()).hexdigest()
                  for o, e in zip(open_, found["ends"])]
        columns = {c: pa.array(found[c].astype(np.int64)) for c in ("fa", "fb", "depth", "up_a", "up_b", "conv_id")}
        unknown = found["up_open"] | (found["depth"] == 0)
        columns["parent_conv_id"] = pa.array(found["parent_conv_id"].astype(np.int64), mask=unknown)
        columns |= {c: pa.array(found[c].astype(np.int64)) for c in ("n", "children", "leaves", "bytes", "above")}
        table = pa.table(columns | {"kind": pa.array(np.where(open_, "open", "whole")), "ends_sha256": pa.array(hashes, pa.string())})
        # The ids that end at open nodes, as rows of their own.
        ends = [(k, ids[e[0]:e[1]]) for k, e in enumerate(found["ends"]) if e is not None and open_[k]]
        if ends:
            which = np.repeat([k for k, _ in ends], [len(own) for _, own in ends])
            more = table.take(pa.array(which)).set_column(5, "conv_id", pa.array(np.concatenate([own for _, own in ends]).astype(np.int64)))
            table = pa.concat_tables([table, more.set_column(more.schema.get_field_index("kind"), "kind", pa.array(["end"] * len(which)))])
        return table

    parts = stored(blocks.groupBy("part", "block").applyInArrow(nodes, f"{NODE}, kind string, ends_sha256 string"), "parts")
    key = ["fa", "fb", "depth"]
    sums = parts.where("kind = 'open'").groupBy(*key, "up_a", "up_b", "above").agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "bytes")))
    shared = stored(sums.join(_hashed(parts.where("kind = 'end'")), key, "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NO_IDS))), "shared")
    whole = parts.where("kind = 'whole'").drop("kind")
    missing = whole.where("parent_conv_id is null and depth > 0").drop("parent_conv_id").unionByName(shared.where("depth > 0"))
    parents = shared.select(F.col("fa").alias("up_a"), F.col("fb").alias("up_b"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    parents = F.broadcast(parents) if shared.count() <= BROADCAST_NODES else parents
    found = missing.join(parents, ["up_a", "up_b", "depth"]).unionByName(whole.where("parent_conv_id is not null or depth = 0")).unionByName(
        shared.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return found.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.greatest("leaves", F.lit(1)).alias("n_leaves"), (F.col("bytes") - (F.col("n") - 1) * F.col("above")).alias("saved_tokens"), "ends_sha256")
