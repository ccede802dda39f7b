"""Vectorised words, hashes and shingles of Arrow text columns, shared by the operators that run numpy inside tasks.

A word is a run of bytes other than ASCII space and 0x09-0x0D. Those bytes never occur inside a multi-byte character of
UTF-8, so a text is cut the same way as by code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

_U = np.uint64
#: Odd multipliers of the positions in a shingle.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


#: Bytes of text that a task looks at together; a longer text is looked at alone.
BYTES_AT_ONCE = 2 << 20
#: Rows of text that Spark hands to a Python worker at once. Its default of 10,000 whole texts is held several times, in buffers on both sides.
ARROW_ROWS = 500


@contextmanager
def small_batches(spark: SparkSession):
    """Hand texts to Python workers in small batches meanwhile; for jobs that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches: Iterator[pa.RecordBatch], rows: int, most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and, beyond the first row, ``most`` bytes of strings and lists."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.full(batch.num_rows, 16, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            elif pa.types.is_list(column.type):
                sizes += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + most, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def coded_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each word, the words coded, bounds): words ``bounds[i]:bounds[i + 1]`` belong to text i; null has none.

    With ``lower`` the coded words have A-Z lower-cased, so several codes may stand for one word. They are lowered after coding, since
    ``ascii_lower`` misreads arrays that are slices of others.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    offsets = parts.offsets.to_numpy()
    offsets = offsets - offsets[0]
    solid = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(solid)])
    coded = flat.filter(pa.array(solid)).dictionary_encode()
    words = pc.ascii_lower(coded.dictionary) if lower else coded.dictionary
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), words, before[offsets]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each A-Z-lower-cased word, bounds)."""
    codes, distinct, bounds = coded_words(texts, lower=True)
    return hash_strings(distinct)[codes], bounds


def hash_strings(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes that are the same in every process."""
    if not len(distinct):
        return np.zeros(0, dtype=_U)
    return pd.util.hash_array(distinct.to_numpy(zero_copy_only=False).astype(object), categorize=False).astype(_U)


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one, no word none."""
    words, bounds = word_hashes(texts)
    with np.errstate(over="ignore"):
        n = len(words) - width + 1
        grams = np.zeros(max(n, 0), dtype=_U)
        if n > 0:
            for j in range(width):
                grams += words[j : j + n] * _PLACES[j % len(_PLACES)] + _U(j)
            grams = mix(grams)
        sets = []
        for start, end in zip(bounds[:-1], bounds[1:]):
            if end - start >= width:
                sets.append(np.unique(grams[start : end - width + 1]))
            elif end > start:
                short = mix((words[start:end] * _PLACES[: end - start]).sum(dtype=_U, keepdims=True) + _U(end - start))
                sets.append(mix(short + _U(1)))
            else:
                sets.append(np.zeros(0, dtype=_U))
    return sets
