"""Toxicity by class-conditional Kneser-Ney models.

Two word models, toxic and ordinary, are counted on a bounded sample of labelled rows: bigrams with absolute discount over unigram
continuation counts, and below both the shared backoff, the frequency of a word in all documents. Rare expressions therefore fall back
to the same probability in both models and say nothing. A toxic text is read as ordinary words with a small share of toxic ones, so the
log-likelihood ratio of a word is that of the mixture; its mean over the words of the text is the length-normalised comparison, and a
logistic curve fitted on a quarter of the sample, which is not counted, turns it into a score. The curve weighs each class by its count
among all learnable labels, so a score is at the rate of toxic labels of the whole table, however many of a class were drawn.

Bounds: at most ``SAMPLE_DOCS`` labelled rows of each class are learned from (chosen by a hash of the id), and the model holds their
words only. Backoff counts and scores cover all documents.

Defined results: null, empty and wordless texts have the ratio 0; rows that repeat a doc_id are scored one by one; a null doc_id is
scored, is held out and never learned from; null labels are ignored, and of several labels the largest counts; without labels of both
kinds every score is the share of toxic labels, 0 without labels; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointpanel.llm.words import coded_words, hash_strings, mix, slices
from pointpanel.session import stored

SAMPLE_DOCS = 6000
ROWS_AT_ONCE = 2000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Discounts of bigram counts and of unigram continuation counts. The high first one leaves only bigrams that come back often.
BIGRAM_DISCOUNT, UNIGRAM_DISCOUNT = 4, 1
#: The share of toxic words in a toxic text.
SHARE = 0.01
START = np.uint64(0x5BD1E9955BD1E995)


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each A-Z-lower-cased word without punctuation at its ends, bounds of each text)."""
    codes, distinct, bounds = coded_words(texts, lower=True)
    hashes = hash_strings(pc.utf8_trim(distinct.cast(pa.large_string()), characters=PUNCTUATION))
    return hashes[codes] if len(codes) else np.zeros(0, np.uint64), bounds


def _before(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The word before each word, a start mark for the first of a text."""
    previous = np.concatenate([[START], words[:-1]]) if len(words) else words
    firsts = bounds[:-1][np.diff(bounds) > 0]
    previous[firsts] = START
    return previous


def _bigrams(sample: DataFrame) -> DataFrame:
    """(v, w, t, o): counts of each bigram in the toxic and the ordinary texts of ``sample`` (text, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, ROWS_AT_ONCE):
            words, bounds = plain_words(batch.column(0))
            toxic = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(bounds)) == 1
            frame = pd.DataFrame({"v": _before(words, bounds).view(np.int64), "w": words.view(np.int64), "t": toxic, "o": ~toxic})
            yield pa.RecordBatch.from_pandas(
                frame.groupby(["v", "w"], as_index=False).sum().astype("int64"), preserve_index=False)

    return sample.select("text", "y").mapInArrow(run, "v long, w long, t long, o long").groupBy("v", "w").agg(
        F.sum("t").alias("t"), F.sum("o").alias("o"))


def _known_counts(docs: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each of the ``known`` word hashes occurs in all documents, and the number of words there."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        total, counts = 0, np.zeros(len(own), np.int64)
        for batch in slices(batches, ROWS_AT_ONCE):
            words, _ = plain_words(batch.column(0))
            total += len(words)
            at = np.searchsorted(own, words)
            at[at == len(own)] = 0
            if len(own):
                counts += np.bincount(at[own[at] == words], minlength=len(own))
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1], hit])), pa.array(np.concatenate([[total], counts[hit]]))], names=["k", "c"])

    found = docs.select("text").mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow().to_pandas()
    counts = np.zeros(len(known) + 1, np.int64)
    counts[found["k"].to_numpy(np.int64)] = found["c"].to_numpy(np.int64)  # -1 is the last place
    return counts[:-1], int(counts[-1])


@dataclass
class ToxicModel:
    """Sorted word hashes with both models' unigram probabilities; contexts with their backoff weights; strong bigrams."""

    words: np.ndarray
    unigram: np.ndarray  # 2 x words
    rare: np.ndarray  # 2: weights of the shared backoff, for words outside
    contexts: np.ndarray
    weights: np.ndarray  # 2 x contexts
    bigrams: np.ndarray
    strong: np.ndarray  # 2 x bigrams: discounted relative counts

    def ratios(self, words: np.ndarray, previous: np.ndarray) -> np.ndarray:
        """P(word | toxic) / P(word | ordinary) after the previous word."""
        p = np.repeat(self.rare[:, None], len(words), axis=1)
        at, hit = _find(self.words, words)
        p[:, hit] = self.unigram[:, at[hit]]
        at, hit = _find(self.contexts, previous)
        # Words outside the model keep the shared probability as a common factor, so strong bigrams, whose second words are all in the model, add to p alone.
        p[:, hit] *= self.weights[:, at[hit]]
        at, hit = _find(self.bigrams, bigram_key(previous, words))
        p[:, hit] += self.strong[:, at[hit]]
        return p[0] / p[1]

    def measure(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(mean mixture log-likelihood ratio, number of words) of each text."""
        words, bounds = plain_words(texts)
        logs = np.log1p(SHARE * (self.ratios(words, _before(words, bounds)) - 1)) if len(self.words) else np.zeros(len(words))
        n = np.diff(bounds)
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1), n


def bigram_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(v * np.uint64(0x9E3779B97F4A7C15) + w)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


def learn(docs: DataFrame, sample: DataFrame) -> ToxicModel:
    """Both models from ``sample`` (text, y), with backoff counts over all of ``docs``."""
    bigrams = stored(_bigrams(sample), "bigrams")
    d1, d2 = UNIGRAM_DISCOUNT, BIGRAM_DISCOUNT
    seen = lambda k: (F.col(k) > 0).cast("long")
    strong = f"t > {d2} or o > {d2}"
    continued = bigrams.groupBy("w").agg(F.sum(seen("t")).alias("t"), F.sum(seen("o")).alias("o"), F.bool_or(F.expr(strong)).alias("second"))
    totals = continued.agg(*(f(k).alias(f"{n}_{k}") for k in "to" for n, f in (
        ("all", F.sum), ("cut", lambda k: F.sum(F.least(F.col(k), F.lit(d1))))))).first().asDict()
    # A word that follows one other word only has no count left here, but is held if that pair is strong: both terms then have one scale.
    kept = continued.where(f"t > {d1} or o > {d1} or second").select("w", "t", "o").toArrow().to_pandas()
    if not totals["all_t"] or not totals["all_o"]:
        none, pair = np.zeros(0, np.uint64), np.zeros((2, 0))
        return ToxicModel(none, pair, np.ones(2), none, pair, none, pair)
    words = kept["w"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    words, n = words[order], kept[["t", "o"]].to_numpy(float)[order].T
    all_ = np.array([totals["all_t"], totals["all_o"]], float)[:, None]
    rare = np.array([totals["cut_t"], totals["cut_o"]], float)[:, None] / all_
    known, total = _known_counts(docs, words)
    shared = (known + 1) / (total + len(words) + 1)
    unigram = np.maximum(n - d1, 0) / all_ + rare * shared
    strong = bigrams.where(strong).select("v", "w", "t", "o")
    sums = bigrams.join(strong.select("v").distinct(), "v", "left_semi").groupBy("v").agg(
        *(F.sum(k).alias(f"n_{k}") for k in "to"), *(F.sum(F.least(F.col(k), F.lit(d2))).alias(f"cut_{k}") for k in "to")).toArrow().to_pandas()
    contexts = sums["v"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(contexts)
    contexts, sums = contexts[order], sums.iloc[order]
    counts, cut = sums[["n_t", "n_o"]].to_numpy(float).T, sums[["cut_t", "cut_o"]].to_numpy(float).T
    weights = np.where(counts > 0, cut / np.maximum(counts, 1), 1.0)
    pairs = strong.toArrow().to_pandas()
    v, w = (pairs[k].to_numpy(np.int64).view(np.uint64) for k in "vw")
    at, _ = _find(contexts, v)
    lift = np.maximum(pairs[["t", "o"]].to_numpy(float).T - d2, 0) / np.maximum(counts[:, at], 1)
    key = bigram_key(v, w)
    order = np.argsort(key)
    return ToxicModel(words, unigram, rare[:, 0], contexts, weights, key[order], lift[:, order])


def measured(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, ratio, words) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS_AT_ONCE):
            ratio, n = held.value.measure(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ratio), pa.array(n)], names=["doc_id", "ratio", "words"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ratio double, words long")


def calibrate(ratio: np.ndarray, y: np.ndarray, counts: tuple[int, int]) -> tuple[float, float, float]:
    """(unit, slope, offset) of the curve 1 / (1 + exp(-(offset + slope * asinh(ratio / unit)))).

    ``counts`` are the ordinary and toxic labels of the whole table, which the rows of each class stand for together.
    """
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(counts[1] / max(sum(counts), 1), 1e-6, 1 - 1e-6))
        return 1.0, 0.0, float(np.log(share / (1 - share)))
    here = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = (np.array(counts) / here * len(y) / sum(counts))[y.astype(int)]
    unit = max(float(np.quantile(np.abs(ratio[y == 0]), 0.9)), 1e-9)
    x = np.column_stack([np.ones(len(y)), np.arcsinh(ratio / unit)])
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2) * 0.01
        beta += np.linalg.solve(hess, x.T @ (weight * (y - p)) - 0.01 * beta)
    return unit, float(beta[1]), float(beta[0])


def classify(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted, ratio, words) of every document; labels of rows whose crc32 mod 5 is 0 are not learned."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").cast("int").alias("y")).where(~out)
    draw = F.xxhash64("doc_id", F.lit(9))
    chosen = [known.where(F.col("y") == y).orderBy(draw, "doc_id").limit(sample_docs) for y in (1, 0)]
    rows = stored(chosen[0].union(chosen[1]).withColumn("tune", F.pmod(draw, F.lit(4)) == 0), "labelled")
    # The sample has at most 2 * sample_docs narrow rows, so it may be broadcast.
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(rows.where("not tune")), "doc_id")
    found = stored(measured(docs, learn(docs, sample)), "toxicity")
    tuned = found.join(F.broadcast(rows.where("tune")), "doc_id").orderBy(draw, "doc_id", "ratio").limit(2 * sample_docs).select(
        "ratio", "y").toArrow().to_pandas()
    counts = known.agg(*(F.count_if(F.col("y") == y) for y in (0, 1))).first()
    unit, slope, offset = calibrate(tuned["ratio"].to_numpy(float), tuned["y"].to_numpy(float), tuple(counts))
    score = 1 / (1 + F.exp(-(F.lit(offset) + F.lit(slope) * F.asinh(F.col("ratio") / F.lit(unit)))))
    return found.withColumn("score", score).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "ratio", "words")
