"""Best-fit packing with a swap-based local search.

Texts become pieces of at most ``capacity`` ids inside tasks. From then on only the pieces' lengths travel: they are dealt into blocks
of bounded size, and each block is packed by itself, best fit decreasing first. Then the emptiest sequence is dissolved: its pieces
move into gaps, or change places one for one or two for one with shorter pieces of fuller sequences; if it resists, the next ones are
tried. Each exchange raises the sum of
squared fills, so the search ends; a sequence that ends empty is saved.

Defined results: a null or empty text is the end id alone; rows that repeat a doc_id are packed one by one; no row is lost; the input
may have further columns, which are not returned.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointpanel.llm.words import coded_words, slices
from pointpanel.session import stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Cached words per worker; the cache is emptied when it is full.
CACHED_WORDS = 400_000
ROWS_AT_ONCE = 3000
#: Plain runs encoded together.
JOINED = 2000
#: Letters that neither normalisation nor lower-casing joins or splits, with at most one mark behind them.
PLAIN, MARKED = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,]?$", "[.,]$"


class WordTokenizer:
    """Ids of whole texts, with each distinct run between blanks encoded once: this vocabulary never looks across a blank.

    New runs of plain letters with at most one mark are joined by blanks and encoded many at a time. Each such part (letters, mark) ends in
    the only id whose token carries the word end, which tells the runs apart again. Other runs are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.first = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _encode(self, runs: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]

    def _learn(self, runs: list[str], plain: np.ndarray, marked: np.ndarray) -> np.ndarray:
        """Add new runs to the store, the plain ones first; their places there."""
        together = [runs[k] for k in np.flatnonzero(plain)]
        flat = self._encode([" ".join(together[k : k + JOINED]) for k in range(0, len(together), JOINED)])
        joined = np.concatenate(flat) if flat else np.zeros(0, "<u4")
        part_ends = np.flatnonzero(self.ends[joined]) + 1
        ends = part_ends[np.cumsum(1 + marked[plain]) - 1] if len(together) else part_ends
        others = [runs[k] for k in np.flatnonzero(~plain)]
        single = self._encode(others)
        sizes = np.concatenate([np.diff(ends, prepend=0), np.fromiter(map(len, single), np.int64, len(single))]).astype(np.int64)
        base = len(self.known)
        self.known.update(zip(together + others, range(base, base + len(runs))))
        self.flat = np.concatenate([self.flat, joined, *single])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        place = np.empty(len(runs), np.int64)
        place[plain] = base + np.arange(len(together))
        place[~plain] = base + len(together) + np.arange(len(others))
        return place

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, bounds of each text)."""
        codes, distinct, bounds = coded_words(texts, lower=False)
        runs = distinct.to_pylist()
        if len(self.known) > CACHED_WORDS:
            self._forget()
        place = np.array(list(map(self.known.get, runs, repeat(-1))), np.int64)
        fresh = place < 0
        new = distinct.filter(pa.array(fresh))
        place[fresh] = self._learn(new.to_pylist(), *(pc.match_substring_regex(new, p).to_numpy(zero_copy_only=False) for p in (PLAIN, MARKED)))
        stored_runs = pa.LargeListArray.from_arrays(pa.array(self.first), pa.array(self.flat))
        found = stored_runs.take(pa.array(place[codes]))
        ends = found.offsets.to_numpy()
        return found.flatten().to_numpy(), ends[bounds] - ends[0]


@lru_cache(maxsize=1)
def shared_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for all tasks that a worker process runs, with the words it knows."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each text; ``with_ids`` adds the ids themselves."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_tokenizer(tokenizer_path)
        for batch in slices(batches, ROWS_AT_ONCE):
            ids, bounds = encoder.ids(batch.column(1))
            rows: list[tuple] = []
            for doc, start, end in zip(batch.column(0).to_pylist(), bounds[:-1], bounds[1:]):
                own = np.append(ids[start:end], np.array([end_id], "<u4")).astype("<u4")
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int64)] if with_ids else [])))
            columns = list(zip(*rows)) or [[]] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int64())] if with_ids else [])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    schema = PIECES + (", ids array<long>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class Block:
    """The sequences of one block: per sequence the sorted (length, item) pairs and the fill."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.capacity = capacity
        self.items: list[list[tuple[int, int]]] = []
        self.fill: list[int] = []
        by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        rooms = 0  # bit r is set if a sequence has exactly r free places
        for item in np.argsort(-lengths, kind="stable"):
            size = int(lengths[item])
            fitting = rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                k = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, k = capacity, len(self.items)
                self.items.append([])
                self.fill.append(0)
            insort(self.items[k], (size, int(item)))
            self.fill[k] += size
            by_room[room - size].append(k)
            rooms |= 1 << (room - size)

    def search(self, sources: int = 32) -> None:
        """Dissolve underfull sequences, emptiest first. The search ends when the ids need as many sequences as are left, or when none of
        the ``sources`` emptiest ones yields."""
        used = sum(1 for own in self.items if own)
        least = -(-sum(self.fill) // self.capacity)
        open_ = sorted((k for k in range(len(self.items)) if self.fill[k] < self.capacity), key=lambda k: (self.fill[k], k))
        tried = 0
        while used > least and tried < min(sources, len(open_) - 1):
            source = open_[tried]
            while self.items[source] and self._improve(source, [k for k in open_ if k != source and self.fill[k] < self.capacity]):
                pass
            if self.items[source]:
                tried += 1
            else:
                used, tried = used - 1, 0
                open_ = sorted((k for k in open_ if self.items[k] and self.fill[k] < self.capacity), key=lambda k: (self.fill[k], k))

    def _improve(self, source: int, targets: list[int]) -> bool:
        """One round over the targets, fullest first; whether any exchange was made."""
        done = False
        for target in sorted(targets, key=lambda k: (-self.fill[k], k)):
            while (change := self._best(source, target)) is not None:
                self._exchange(source, target, *change)
                done = True
                if not self.items[source]:
                    return True
        return done

    def _best(self, source: int, target: int) -> tuple[list, list] | None:
        """The move, one-for-one or two-for-one exchange that fills the target most and raises the sum of squares."""
        room, own, other = self.capacity - self.fill[target], self.items[source], self.items[target]
        if not room:
            return None
        best, gain = None, 0
        at = bisect_right(own, (room, 1 << 62)) - 1
        if at >= 0:
            best, gain = ([own[at]], []), own[at][0]
        for back in other:
            at = bisect_right(own, (back[0] + room, 1 << 62)) - 1
            if at >= 0 and own[at][0] - back[0] > gain:
                best, gain = ([own[at]], [back]), own[at][0] - back[0]
            left, right = 0, len(own) - 1
            while left < right and gain < room:
                extra = own[left][0] + own[right][0] - back[0]
                if extra > room:
                    right -= 1
                else:
                    if extra > gain:
                        best, gain = ([own[left], own[right]], [back]), extra
                    left += 1
        return best if gain > self.fill[source] - self.fill[target] and gain > 0 else None

    def _exchange(self, source: int, target: int, go: list, back: list) -> None:
        for moved, a, b in [*((x, source, target) for x in go), *((x, target, source) for x in back)]:
            self.items[a].pop(bisect_left(self.items[a], moved))
            insort(self.items[b], moved)
            self.fill[a] -= moved[0]
            self.fill[b] += moved[0]


def pack(parts: DataFrame, capacity: int = 2048, block_rows: int = 8000) -> DataFrame:
    """``parts`` (a written table of pieces) with ``sequence_id`` and ``offset``.

    Blocks hold about ``block_rows`` pieces; a block wastes less than one sequence beyond the packing of its pieces, so bounded blocks
    cost about one sequence in a thousand.
    """
    blocks = max(1, -(-parts.count() // block_rows))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=False, ignore_index=True)
        lengths = rows["length"].to_numpy()
        block = Block(lengths, capacity)
        block.search()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, own in enumerate(block.items):
            at = 0
            for size, item in reversed(own):
                sequence[item], offset[item] = (int(key[0]) << 32) + k, at
                at += size
        return rows.drop(columns="_block").assign(sequence_id=sequence, offset=offset)

    dealt = parts.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(blocks)))
    schema = ", ".join(f"{n} {t}" for n, t in parts.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy("_block").applyInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return pack(stored(pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)


def sequences(placed_with_ids: DataFrame) -> DataFrame:
    """The packed sequences themselves: ids joined in the order of their offsets; a sequence holds at most its capacity."""
    return placed_with_ids.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
