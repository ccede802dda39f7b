"""Frames of awkward rows for the tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Further columns whose names clash with those that operators use inside or return.
CLASHES = ["score", "kept", "n_lines", "_gone", "_words", "tokens", "weight", "place", "head", "a", "b", "x", "y", "ids", "block", "length"]


def prose(n: int, seed: int, vocabulary: int = 4000) -> str:
    rng = random.Random(seed)
    words = ["w" + "abcdefghij"[k % 10] + str(k) for k in range(vocabulary)]
    out = [rng.choice(words) for _ in range(n)]
    return "\n".join(" ".join(out[k : k + 12]).capitalize() + "." for k in range(0, n, 12))


def docs(spark, rows, clash: bool = False):
    """Documents of (doc_id, text[, source]) rows, with clashing columns if asked."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
    frame = spark.createDataFrame(full, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        for name in CLASHES:
            frame = frame.withColumn(name, F.lit("clash"))
    return frame


def awkward(spark, clash: bool = True):
    """Nulls in each column, empty, blank and very long texts, repeated rows and ties."""
    long_text = prose(30_000, 1)
    rows = [(1, prose(100, 2)), (1, prose(100, 2)), (2, prose(100, 2)), (3, None), (4, ""), (5, " \n\t\n "), (None, prose(40, 3)),
            (None, None), (6, long_text, None), (7, "word"), (8, "x" * 50_000), (9, "a b c d\ne é ß 漢字", "t"), (10, prose(90, 4), "t")]
    return docs(spark, rows, clash)


def shingles(text: str | None) -> set:
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def components(texts: dict) -> dict:
    """Smallest id reachable by links of at least 0.8, by comparing everything that shares a shingle."""
    sets = {k: shingles(t) for k, t in texts.items()}
    holders: dict = {}
    for k, own in sets.items():
        for g in own:
            holders.setdefault(g, []).append(k)
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k in sorted(sets):
        for o in sorted({o for g in sets[k] for o in holders[g] if o < k}):
            both = len(sets[k] & sets[o])
            if 100 * both >= 80 * (len(sets[k]) + len(sets[o]) - both):
                a, b = root(k), root(o)
                parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in sets}
