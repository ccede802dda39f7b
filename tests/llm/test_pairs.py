"""The Jaccard join and the nearest-neighbour search against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointpanel.llm import graph, jaccard_join, projection_search
from tests.llm.helpers import awkward, components, docs, prose, shingles


def edited(text: str, edits: int, seed: int) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def check_components(frame):
    rows = frame.select("doc_id", "text").where("doc_id is not null").collect()
    want = components({r["doc_id"]: r["text"] for r in rows})
    sizes = {r["doc_id"]: len(shingles(r["text"])) for r in rows}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(frame).collect() if r["doc_id"] is not None}
    assert got == {k: (sizes[k], want[k]) for k in want}


def test_components_of_copies_chains_and_thresholds(spark):
    base, other = prose(300, 5), prose(300, 6)
    rows = [(100, base), (90, base), (80, base.upper())]
    # A chain whose ends do not link, distances around the threshold, and a tight group with a ring outside.
    text = base
    for k in range(12):
        text = edited(text, 5, k)
        rows.append((200 + k, text))
    rows += [(300 + k, edited(other, e, k)) for k, e in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20])]
    rows += [(400 + k, prose(120, 100 + k) + "\n" + prose(60, 9)) for k in range(30)]  # one passage in unlike texts
    rows += [(500, "a b c"), (501, "A  B\tc"), (502, "a b c d e"), (503, "")]
    check_components(docs(spark, rows))


def test_ring_members_link_where_heads_do_not(spark):
    words = [f"v{k}" for k in range(600)]
    line = lambda a, b: " ".join(words[a:b])
    # Windows over one sequence: near ones link, far ones only through others.
    rows = [(k, line(4 * k, 4 * k + 200)) for k in range(60)]
    check_components(docs(spark, rows))


def test_a_tree_of_copies_in_dense_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "DENSE", 3)
    monkeypatch.setattr(jaccard_join, "LEADERS", 1)
    rng = random.Random(4)
    texts = [prose(150, 77)]
    while len(texts) < 50:
        texts.append(edited(rng.choice(texts), rng.randrange(1, 6), len(texts)))
    check_components(docs(spark, list(enumerate(texts))))


def test_shingles_of_one_set_are_not_stored(spark, monkeypatch):
    """Index lists keep what several sets share, so what they write follows the copies and not all shingles."""
    rows = {}

    def counted(df, label, stored=jaccard_join.stored):
        out = stored(df, label)
        rows.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", counted)
    texts = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(40)]
    check_components(docs(spark, list(enumerate([*texts, edited(texts[0], 1, 3)]))))
    assert max(n for counts in rows.values() for n in counts) < 300


def test_awkward_rows(spark):
    got = jaccard_join.similar_components(awkward(spark)).collect()
    assert len(got) == 13
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert by[3] == [(0, 3)] and by[4] == [(0, 4)] and by[5] == [(0, 5)] and by[7] == [(1, 7)]
    assert {c for _, c in by[1] + by[2]} == {1} and {c for _, c in by[None]} == {None}
    assert jaccard_join.similar_components(docs(spark, [])).count() == 0
    kept = jaccard_join.keep_first(awkward(spark))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted([1, 3, 4, 5, 0, 0, 6, 7, 8, 9, 10])


def test_kept_rows_of_repeated_ids(spark):
    """Decided by row: an unlike text stays though its id has a near copy too, and one row of each group stays."""
    one, other = prose(80, 1), prose(80, 2)
    rows = [(1, one), (1, one), (5, one), (5, other), (8, prose(80, 3)), (8, prose(80, 3)), (9, prose(80, 3) + " x"), (4, ""), (4, "")]
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.keep_first(docs(spark, rows, clash=True)).collect()]
    assert sorted(kept) == sorted([(1, one), (5, other), (8, prose(80, 3)), (4, "")])


def test_graph_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100}


def test_prefixes_and_positions_never_miss():
    """Of linked sets of n and m shingles sharing k, the first shared one stands in both prefixes and leaves room for the rest."""
    for n in range(1, 120):
        for m in range(n, 160):
            least = -(-80 * (n + m) // 180)  # shingles a link must share
            if least <= n:
                assert n - least <= jaccard_join.prefix_length(n, 80) - 1 and m - least <= jaccard_join.prefix_length(m, 80) - 1


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, k):
    clean = {}
    for i, v, _ in rows:
        ok = i is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok:
            clean.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = {}
    for i in (i for i in clean if i % 20 == 0):
        best = {j: max(float(a @ b) for a in clean[i] for b in clean[j]) for j in clean if j != i}
        out[i] = sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k]
    return out


def test_search_recall_ties_and_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist(), 0) for i in range(600)]
    rows += [(1000 + i, rows[20][1], 0) for i in range(60)]  # equal vectors, more than an answer holds
    rows += [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] + [1.0] * 15, 0), (2060, [None] + [1.0] * 15, 0),
             (2080, [float("inf")] + [1.0] * 15, 0), (2100, [1.0] * 3, 0), (2120, [], 0), (None, [1.0] * 16, 0), rows[40]]
    want = brute(rows, 20)
    got: dict = {}
    for r in projection_search.nearest(vectors(spark, rows), F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert [v for v, _ in got[20]] == [v for v, _ in want[20]] == [1000 + i for i in range(20)]
    for q, answers in got.items():
        assert len(answers) == 20 and answers == sorted(answers, key=lambda e: (-e[1], e[0])) and q not in dict(answers)


def test_search_of_few_and_none(spark):
    got = projection_search.nearest(vectors(spark, [(0, [1.0, 0.0], 0), (1, [0.5, 0.0], 0)]), F.col("id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 0.5)]
    assert projection_search.nearest(vectors(spark, []), F.col("id") % 20 == 0).count() == 0


def test_blocks_and_chunks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(300)]
    frame = vectors(spark, rows)
    answers = lambda: sorted(map(tuple, projection_search.nearest(frame, F.col("id") % 20 == 0, 5).collect()))
    whole = answers()
    monkeypatch.setattr(projection_search, "BLOCK_ROWS", 70)
    monkeypatch.setattr(projection_search, "CHUNK_ROWS", 4)
    assert len({(r[0], r[2]) for r in whole} & {(r[0], r[2]) for r in answers()}) >= 0.95 * len(whole)


@pytest.mark.parametrize("p", [0.5, 0.95])
def test_chi_square_quantile(p):
    sample = np.random.default_rng(1).chisquare(8, 200_000)
    assert abs((sample < projection_search.chi_square_quantile(p, 8)).mean() - p) < 0.005
