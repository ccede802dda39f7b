"""Tensored MinHash, the prefix trie and the hard negatives against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointpanel.llm import minhash_tensor, prefix_trie, tree_negatives, words
from tests.llm.helpers import awkward, docs, prose

# --- tensored MinHash -------------------------------------------------------------------------------------------------


def pairs_of_words(text: str | None) -> set:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    return set(zip(found, found[1:])) if len(found) > 1 else {tuple(found)} if found else set()


def brute_components(texts: dict) -> dict:
    sets = {k: pairs_of_words(t) for k, t in texts.items()}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}


def edited(text: str, edits: int, seed: int) -> str:
    rng = random.Random(seed)
    found = text.split(" ")
    for _ in range(edits):
        found[rng.randrange(len(found))] = f"edit{rng.randrange(10**6)}"
    return " ".join(found)


def check_near_copies(frame, **how):
    rows = frame.select("doc_id", "text").collect()
    want = brute_components({r["doc_id"]: r["text"] for r in rows})
    got = {r["doc_id"]: r for r in minhash_tensor.near_copies(frame, **how).collect()}
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert {k: r["n_shingles"] for k, r in got.items()} == {r["doc_id"]: len(pairs_of_words(r["text"])) for r in rows}
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_near_copies_chains_and_thresholds(spark):
    base = prose(300, 5)
    rows = [(100, base), (90, base), (80, base.upper()), (70, base + " ")]
    text = base
    for k in range(12):  # a chain whose ends do not link
        text = edited(text, 6, k)
        rows.append((200 + k, text))
    rows += [(300 + k, edited(prose(300, 6), e, k)) for k, e in enumerate([0, 2, 4, 8, 12, 16, 40, 80])]
    rows += [(400, "a b"), (401, "A\tb"), (402, "a b c"), (403, "word"), (404, "WORD"), (405, "")]
    # Tables enough to find pairs right at the threshold for certain.
    check_near_copies(docs(spark, rows), rows=2, side=16)


def test_entries_of_unlike_sets_are_paired_exactly(spark, monkeypatch):
    """With one minhash a key most entries hold several components, and no leader settles them."""
    monkeypatch.setattr(minhash_tensor, "LEADERS", 0)
    shared = prose(60, 9)
    rows = [(k, shared + "\n" + prose(40, 50 + k)) for k in range(25)]
    rows += [(100 + k, edited(rows[k % 3][1], 3, k)) for k in range(10)]
    check_near_copies(docs(spark, rows), rows=1, side=4)


def test_a_group_is_joined_before_its_lists_are_met(spark, monkeypatch):
    """Stragglers of a large group meet a few of its sets first, so few pairs are left for the exact rule."""
    monkeypatch.setattr(minhash_tensor, "LEADERS", 0)
    left = []

    def counted(*args, exact=minhash_tensor._exact_pairs):
        pairs = exact(*args)
        left.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash_tensor, "_exact_pairs", counted)
    base = prose(120, 4)
    check_near_copies(docs(spark, [(k, edited(base, 2, k)) for k in range(30)]), rows=1, side=4)
    assert sum(left) < 100


def test_near_copies_of_awkward_rows(spark):
    got = minhash_tensor.near_copies(awkward(spark)).collect()
    assert len(got) == 13
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)] and by[7] == [(1, 7, True)]
    assert [c for _, c, _ in by[1] + by[2]] == [1, 1, 1] and by[2][0][2] is False
    assert {(c, kept) for _, c, kept in by[None]} == {(None, True)}
    assert minhash_tensor.near_copies(docs(spark, [])).count() == 0


def test_half_keys_agree_as_often_as_sets_do():
    rng = np.random.default_rng(2)
    both = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    a, b = (np.concatenate([both, rng.integers(0, 1 << 63, 100, dtype=np.uint64)]) for _ in range(2))
    x, y = minhash_tensor.half_keys([a, b], 1, 200)
    assert abs((x == y).mean() - 0.8) < 0.06  # 800 of 1000
    assert len(set(x.tolist())) == 400


def test_slices_keep_rows_and_bound_bytes():
    texts = ["x" * n for n in (10, 5000, 3, 0, 2500, 2600, 7)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["k", "text"])
    got = list(words.slices(iter([batch, batch.slice(0, 0)]), 3, 4000))
    assert [k for b in got for k in b.column(0).to_pylist()] == list(range(7)) and all(b.num_rows <= 3 for b in got)
    assert all(b.num_rows == 1 or sum(map(len, b.column(1).to_pylist())) <= 4000 for b in got)


# --- the prefix trie --------------------------------------------------------------------------------------------------


def brute_fork(rows):
    """Rebuilt conversations {id: [(role, text), ...]} by the query's rule."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def brute_trie(conversations: dict) -> set:
    members, ends = {}, {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    out = set()
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)
        out.add((
            min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children(p), sum(children(q) == 0 for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q),
            hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()))
    return out


TURNS = "conv_id long, turn long, role string, text string, n long"


def some_conversations(seed: int, n: int):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "é", "", None, "long " * 5])) for t in range(rng.randrange(0, 5))]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1040) for t in range(12)]  # one conversation under many ids
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (None, 1, "user", "lost"), (3, 2, "system", "tie"), (3, 2, "system", "tie")]
    return rows


def trie_of(frame):
    kept, origin = F.expr("crc32(cast(cast(conv_id as string) as binary)) % 9"), F.expr("conv_id - conv_id % 5")
    return prefix_trie.prefix_trie(prefix_trie.forked(frame, kept, origin))


@pytest.mark.parametrize("block", [4096, 3, 1])
def test_trie_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", block)
    rows = some_conversations(1, 120)
    frame = spark.createDataFrame([(*r, None) for r in rows], TURNS).repartition(5)
    got = [tuple(r) for r in trie_of(frame).collect()]
    want = brute_trie(brute_fork(rows))
    assert len(got) == len(set(got)) and set(got) == want


def test_trie_blocks_cut_by_turns(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", 20)
    rows = [(c, t, "user", "x" * min(t, 40)) for c in (0, 1, 2, 5, 6) for t in range(300)] + [(8, 0, "user", "alone")]
    frame = spark.createDataFrame([(*r, None) for r in rows], TURNS)
    assert {tuple(r) for r in trie_of(frame).collect()} == brute_trie(brute_fork(rows))


def test_trie_of_none_and_of_turnless(spark):
    assert trie_of(spark.createDataFrame([], TURNS)).count() == 0
    kept = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    (row,) = trie_of(spark.createDataFrame([(kept, 0, "user", "gone", None)], TURNS)).collect()
    assert tuple(row) == (kept, 0, None, 1, 0, 1, 0, hashlib.sha256(str(kept).encode()).hexdigest())


def test_extents_and_minima():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 64, 100):
        lcp = rng.integers(0, 6, n)
        lcp[0] = 0
        levels = prefix_trie.sparse_table(lcp)
        rows, depths = np.repeat(np.arange(n), 6), np.tile(np.arange(1, 7), n)
        left, right = prefix_trie.extents(levels, rows, depths)
        for i, d, a, b in zip(rows, depths, left, right):
            while i > 0 and lcp[i] >= d:
                i -= 1
            assert a == i
            while i + 1 < n and lcp[i + 1] >= d:
                i += 1
            assert b == i
        assert (prefix_trie.range_minimum(levels, left, right) == [lcp[a : b + 1].min() for a, b in zip(left, right)]).all()


# --- hard negatives ---------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, id long, cell long"


def brute_negatives(rows) -> set:
    clean = {}
    for i, v, label, *_ in rows:
        if i is not None and v and label is not None and len(v) == 6 and all(x is not None and np.isfinite(x) and abs(x) < 65536 for x in v):
            whole = tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)
            own = ((label + 1) % 10 if i % 7 == 0 else label, whole)
            clean[i] = min(clean.get(i, own), own)
    out = set()
    for a in (i for i in clean if i % 100 == 0):
        score = {i: sum(x * y for x, y in zip(clean[a][1], clean[i][1])) for i in clean if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if clean[i][0] == clean[a][0]][:5]:
            hard = [i for i in order if clean[i][0] != clean[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            out |= {(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(hard)}
    return out


def mined(spark, rows) -> list:
    frame = spark.createDataFrame([(*r, None, None)[:5] for r in rows], VECTORS)
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return [tuple(r) for r in tree_negatives.hard_negatives(frame, F.col("id") % 100 == 0, label).collect()]


def random_vectors(seed: int, n: int):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, 6))
    return [(i, (centres[i % 13 % 10] + 0.3 * rng.normal(size=6)).round(2).tolist(), i % 13 % 10) for i in range(n)]


@pytest.mark.parametrize("block,chunk", [(8192, 2048), (50, 3)])
def test_negatives_against_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(tree_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(tree_negatives, "CHUNK_ROWS", chunk)
    rows = random_vectors(1, 1500)
    rows += [(5000 + i, rows[100][1], i % 2) for i in range(40)]  # equal vectors: ties by id
    got = mined(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows) and got


def test_negatives_of_awkward_rows(spark):
    ok = [1.0, 2.0, 0.5, -1.0, 0.25, 3.0]
    rows = [(0, ok, 1), (100, None, 1), (200, [float("nan"), *ok[1:]], 1), (300, [None, *ok[1:]], 2), (400, ok[:3], 1), (500, [], 1), (600, ok, None),
            (None, ok, 1), (700, [1e30, *ok[1:]], 1), (3, ok, 1), (3, ok, 2), (4, ok, 2), (5, [0.9 * x for x in ok], 2), (6, [0.5 * x for x in ok], 2),
            (8, [0.0] * 6, 1), (900, [-x for x in ok], 4), (9, [-2.0 * x for x in ok], 4), (800, [0.0] * 6, 3), (10, ok, 3)]
    got = mined(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows)
    assert (0, 4) in {r[:2] for r in got}
    assert mined(spark, []) == []


def test_tree_bounds_hold_and_save_work():
    rng = np.random.default_rng(3)
    centres = rng.integers(-400, 400, (30, 8))
    anchors = np.concatenate([c + rng.integers(-3, 4, (10, 8)) for c in centres])
    rows = rng.integers(-400, 400, (2000, 8))
    order, parent, edge = tree_negatives.spanning_tree(anchors.astype(float))
    assert sorted(order) == list(range(300)) and parent[order[0]] == -1
    place = np.empty(300, int)
    place[order] = np.arange(300)
    up = np.where(parent[order] < 0, -1, place[parent[order]])
    assert (up < np.arange(300)).all()
    bounds = tree_negatives.Bounds(rows, anchors[order], up, edge[order])
    for k in range(300):
        low, high = bounds.of(k)
        own = rows @ anchors[order][k]
        assert (low <= own).all() and (own <= high).all()
        bounds.settle(k, np.flatnonzero((low < 500_000) & (high > 400_000)), low, high)
        assert len(bounds.held) <= 12
    assert bounds.scored < 0.3 * 300 * 2000 and not bounds.held
