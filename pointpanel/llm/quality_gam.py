"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn over the features, each on one feature's bins, so that every feature ends as a lookup table; pairs of
features that explain what is left get tables of their own. A score is a sum of table entries through the logistic function.

Features are counts over the whole text, computed in tasks. The model is fitted on a bounded sample of labelled rows
(``SAMPLE_ROWS``, chosen by a hash of the id); every document is scored.

Defined results: null and empty texts score like any text of zero counts; rows that repeat a doc_id are scored one by one; a null
doc_id is scored, is held out and never learned from; null labels are ignored, and of several labels the largest counts; without
labels of both kinds every score is the share of positive labels (0.5 without labels). Further columns pass through where a
pipeline filters, and are ignored by the scorer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointpanel.llm.words import coded_words, hash_strings, slices
from pointpanel.session import stored

#: At most so many labelled rows are fitted on.
SAMPLE_ROWS = 40_000
ROWS_AT_ONCE = 1000
FEATURES = [
    "log_words", "log_bytes", "word_bytes", "capital_share", "letter_share", "digit_share", "symbol_share", "bar_share",
    "exclaim_share", "stop_share", "comma_share", "wide_share", "distinct_share", "repeat_share", "top_share", "line_words", "dup_line_share",
]
#: Classes of bytes, counted for each text.
CLASSES = ["upper", "lower", "digit", "symbol", "bar", "exclaim", "stop", "comma", "wide", "newline"]


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, len(CLASSES), np.int64)
    for name, chars in {
        "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&<>@^~=+\\{}[]_", "bar": b"|",
        "exclaim": b"!", "stop": b".?", "comma": b",;:", "wide": range(128, 256), "newline": b"\n",
    }.items():
        kinds[list(chars)] = CLASSES.index(name)
    return kinds


def text_features(texts: pa.Array) -> np.ndarray:
    """The features of each text, one row each."""
    kinds = _byte_classes()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    counts = np.zeros((n, len(CLASSES) + 1))
    for i in range(n):
        counts[i] = np.bincount(kinds[data[offsets[i] : offsets[i + 1]]], minlength=len(CLASSES) + 1)
    size = np.diff(offsets).astype(float)
    of = {name: counts[:, k] for k, name in enumerate(CLASSES)}
    codes, distinct, bounds = coded_words(texts, lower=False)
    words = np.diff(bounds).astype(float)
    hashes = hash_strings(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    lines = pc.split_pattern(texts, "\n")
    line_bounds = lines.offsets.to_numpy() - lines.offsets[0].as_py()
    line_codes = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    unique, repeats, top, dup_lines = (np.zeros(n) for _ in range(4))
    for i in range(n):
        a, b = bounds[i], bounds[i + 1]
        if b > a:
            found = np.unique(codes[a:b], return_counts=True)[1]
            unique[i], top[i], repeats[i] = len(found), found.max(), same[a + 1 : b].sum()
        own = line_codes[line_bounds[i] : line_bounds[i + 1]]
        dup_lines[i] = 1 - len(np.unique(own)) / max(len(own), 1)
    size1, words1 = np.maximum(size, 1), np.maximum(words, 1)
    return np.column_stack([
        np.log1p(words), np.log1p(size), size / words1, of["upper"] / np.maximum(of["upper"] + of["lower"], 1),
        (of["upper"] + of["lower"]) / size1, of["digit"] / size1, of["symbol"] / size1, of["bar"] / words1, of["exclaim"] / words1,
        of["stop"] / words1, of["comma"] / words1, of["wide"] / size1, unique / words1, repeats / words1, top / words1,
        words / (of["newline"] + 1), dup_lines,
    ])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS_AT_ONCE):
            x = text_features(batch.column(1))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Gam:
    """Lookup tables: ``edges[f]`` cuts feature f into bins of ``tables[f]``; ``pairs[(f, g)]`` is a table over coarser bins of both."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        coarse = []
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
            coarse.append(np.searchsorted(self.coarse[f], x[:, f], side="right"))
        for (f, g), table in self.pairs.items():
            total += table[coarse[f], coarse[g]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Edges at quantiles of the values, each value once."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _step(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float = 1.0) -> np.ndarray:
    """The Newton steps of a tree over ordered bins: the best split of any leaf is taken until there are ``leaves`` of them."""
    out = np.zeros(len(grad))
    parts = [(0, len(grad))]
    gain_of = lambda g, h: g * g / (h + ridge)
    while len(parts) < leaves:
        best = None
        for k, (a, b) in enumerate(parts):
            g, h = np.cumsum(grad[a:b]), np.cumsum(hess[a:b])
            if len(g) < 2:
                continue
            gains = gain_of(g[:-1], h[:-1]) + gain_of(g[-1] - g[:-1], h[-1] - h[:-1]) - gain_of(g[-1], h[-1])
            gains[(h[:-1] < 1) | (h[-1] - h[:-1] < 1)] = -1
            at = int(np.argmax(gains))
            if gains[at] > 1e-9 and (best is None or gains[at] > best[0]):
                best = (gains[at], k, a + at + 1)
        if best is None:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    for a, b in parts:
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + ridge)
    return out


def _pair_step(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of depth two over a pair's bins (one cut of each feature, four leaves), and its gain."""
    def corners(x: np.ndarray) -> list[np.ndarray]:
        c = x.cumsum(0).cumsum(1)
        low, row, col, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [low, row - low, col - low, all_ - row - col + low]

    if min(grad.shape) < 2:
        return np.zeros_like(grad), 0.0
    g, h = corners(grad), corners(hess)
    gains = sum(a * a / (b + 1.0) for a, b in zip(g, h))
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    leaf = [a[i, j] / (b[i, j] + 1.0) for a, b in zip(g, h)]
    out = np.empty_like(grad)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return out, float(gains[i, j] - grad.sum() ** 2 / (hess.sum() + 1.0))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.15) -> Gam:
    """Fit the tables: first each feature in turn for ``rounds`` rounds, then the strongest pairs on what is left."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Gam(float(np.log(share / (1 - share))))
    for f in range(len(FEATURES)):
        model.edges.append(_cuts(x[:, f], 64) if len(x) else np.zeros(0))
        model.coarse.append(_cuts(x[:, f], 12) if len(x) else np.zeros(0))
        model.tables.append(np.zeros(len(model.edges[f]) + 1))
    if len(y) == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    wide = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.coarse)]
    margin = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, own in enumerate(bins):
            grad, hess = slopes()
            size = len(model.tables[f])
            step = rate * _step(np.bincount(own, grad, size), np.bincount(own, hess, size), leaves=3)
            model.tables[f] += step
            margin += step[own]
    shapes = [len(e) + 1 for e in model.coarse]

    def cells(f: int, g: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(wide[f] * shapes[g] + wide[g], values, shapes[f] * shapes[g]).reshape(shapes[f], shapes[g])

    grad, hess = slopes()
    gains = sorted(((_pair_step(cells(f, g, grad), cells(f, g, hess))[1], f, g)
                    for f in range(len(FEATURES)) for g in range(f)), reverse=True)
    model.pairs = {(f, g): np.zeros((shapes[f], shapes[g])) for gain, f, g in gains[:n_pairs] if gain > 1}
    for _ in range(pair_rounds):
        for f, g in model.pairs:
            grad, hess = slopes()
            step = rate * _pair_step(cells(f, g, grad), cells(f, g, hess))[0]
            model.pairs[f, g] += step
            margin += step[wide[f], wide[g]]
    return model


def fit_sample(measured: DataFrame, labels: DataFrame, learn, sample_rows: int = SAMPLE_ROWS) -> Gam:
    """Fit on at most ``sample_rows`` labelled rows for which ``learn`` holds, the same ones however the tables are partitioned."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("quality").cast("int").alias("y"))
    rows = measured.where(learn).join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x")).select("x", "y")
    sample = rows.limit(sample_rows).toArrow().to_pandas()
    x = np.array(sample["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, sample["y"].to_numpy(dtype=float))


def scored(measured: DataFrame, model: Gam) -> DataFrame:
    """(doc_id, score) of measured documents, by vectorised table lookups."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array(frame["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": model.score(x)})

    return measured.mapInPandas(run, "doc_id long, score double")


def held_out(remainder: int, modulus: int):
    """Whether crc32 of the id as text has this remainder; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; labels of held-out rows (crc32 mod 3 is 1) are not learned."""
    measured = stored(features(docs), "quality")
    out = held_out(1, 3)
    model = fit_sample(measured, labels, ~out, sample_rows)
    return scored(measured, model).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; every column stays, the text is measured once more at the filter."""
    measured = stored(features(docs), "quality")
    model = fit_sample(measured, labels, ~held_out(1, 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS_AT_ONCE):
            keep = model.score(text_features(batch.column(batch.schema.get_field_index("text")))) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
