"""The first matches of many criteria over one frame, when each keeps no more than its limit.

Rows are dealt into chunks and criteria into parts, and each pair of a chunk and a part is a cell: a task holds one at a time. In a cell the
rows of each field are sorted once, so what a comparison selects is a range of them, found by binary search; only the shortest range of a
criteria is tested on its other comparisons. A criteria leaves a cell with the first rows of its own order only, up to its limit. So no pair of a row
and a criteria is moved but these: what is moved grows with rows, criteria and limits, not with matches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pointpanel.functions.vocabulary import METRIC_COLUMN

#: Rows and criteria of a cell on average.
CELL_ROWS, CELL_CRITERIA = 65_536, 2_048

COMPARE = {"LessThan": np.less, "LessThanOrEqual": np.less_equal, "GreaterThan": np.greater, "GreaterThanOrEqual": np.greater_equal}


def _keys(values: np.ndarray) -> np.ndarray:
    """Doubles as integers in Spark's order: the two zeros are equal, NaN equals itself and is the largest."""
    bits = (np.where(np.isnan(values), np.nan, values) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


class _Rows:
    """The rows of a chunk, by id: their values, and the orders and places that some criteria asks for."""

    def __init__(self, table: pa.Table, fields: list[str]):
        self.table = table.sort_by("_row").combine_chunks()
        self.values, self.known, self.keys = {}, {}, {}
        for i, f in enumerate(fields):
            column = self.table.column(f"_m{i}")
            self.known[f] = column.is_valid().to_numpy()
            self.values[f] = column.fill_null(0.0).to_numpy()
            self.keys[f] = _keys(self.values[f])
        self._sorted, self._ranks, self._places = {}, {}, {}

    def _range(self, field: str, op: str, bound: int) -> np.ndarray:
        """The rows that one comparison selects."""
        if field not in self._sorted:
            at = np.flatnonzero(self.known[field])
            at = at[np.argsort(self.keys[field][at], kind="stable")]
            self._sorted[field] = at, self.keys[field][at]
        at, keys = self._sorted[field]
        cut = np.searchsorted(keys, bound, "left" if op in ("LessThan", "GreaterThanOrEqual") else "right")
        return at[:cut] if op in ("LessThan", "LessThanOrEqual") else at[cut:]

    def _at(self, place: str, name: str) -> np.ndarray:
        if (place, name) not in self._places:
            self._places[place, name] = pc.fill_null(pc.equal(self.table.column(place), name), False).to_numpy()
        return self._places[place, name]

    def rank(self, field: str | None, descending: bool) -> np.ndarray:
        """Each row's place in the order of ``screen.top_rows``: by the ticker where no field orders, and ties by the id."""
        if (field, descending) not in self._ranks:
            if field is None:
                order = pc.sort_indices(self.table.select(["_row", "ticker"]), sort_keys=[("ticker", "ascending"), ("_row", "ascending")],
                                        null_placement="at_start").to_numpy()
            elif field in self.keys:
                value = self.values[field]
                keys = np.where(self.known[field], _keys(-value if descending else value), 0)
                order = np.lexsort((keys, self.known[field] != descending))
            else:
                order = np.arange(self.table.num_rows)
            ranks = np.empty(len(order), np.int64)
            ranks[order] = np.arange(len(order))
            self._ranks[field, descending] = ranks
        return self._ranks[field, descending]

    def first(self, places: dict[str, str | None], comparisons: list[dict], field: str | None, descending: bool, limit: int | None) -> np.ndarray:
        """The rows inside ``places`` that satisfy all comparisons, the first ``limit`` in the order of ``field``."""
        none = np.empty(0, np.int64)
        if not comparisons or any(
                c is None or c["field"] not in self.keys or c["operator"] not in COMPARE or c["value"] is None for c in comparisons):
            return none
        tests = [(c["field"], c["operator"], _keys(np.array([c["value"]]))[0]) for c in comparisons]
        ranges = [self._range(*t) for t in tests]
        least = min(range(len(tests)), key=lambda k: len(ranges[k]))
        found = ranges[least]
        for place, name in places.items():
            if name is not None:
                found = found[self._at(place, name)[found]] if place in self.table.column_names else none
        for k, (f, op, bound) in enumerate(tests):
            if k != least:
                found = found[self.known[f][found] & COMPARE[op](self.keys[f][found], bound)]
        if limit is not None and len(found) > limit:
            found = found[np.argpartition(self.rank(field, descending)[found], limit)[:limit]] if limit > 0 else none
        return found


def _cell(fields: list[str], schema: pa.Schema):
    def first(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        chunk, at, of = _Rows(rows, fields), [], []
        for k, c in enumerate(asked.to_pylist()):
            found = chunk.first({p: c[f"_{p}"] for p in ("exchange", "sector")}, c["comparisons"] or [], c["sort_field"], bool(c["descending"]), c["limit"])
            at.append(found)
            of.append(np.full(len(found), k))
        at, of = np.concatenate(at), np.concatenate(of)
        values = np.zeros(len(at))
        known = np.zeros(len(at), bool)
        sorts = pc.index_in(asked.column("sort_field"), value_set=pa.array(fields, pa.string())).fill_null(-1).to_numpy()[of]
        for i, f in enumerate(fields):
            mine = sorts == i
            values[mine], known[mine] = chunk.values[f][at[mine]], chunk.known[f][at[mine]]
        return pa.table([asked.column("criteria_key").take(of), chunk.table.column("_row").take(at), chunk.table.column("ticker").take(at),
                         pa.array(values, mask=~known)], names=schema.names).cast(schema)

    return first


def first_matches(frame: DataFrame, criteria: DataFrame, row: str, metrics: list[str]) -> DataFrame:
    """(criteria_key, row, ticker, _value): rows of ``frame`` that satisfy each criteria, universe and comparisons, with the value that orders them.

    A criteria has all of its first ``limit`` rows among them, those of other chunks beside them. ``frame`` and ``criteria`` as in
    ``screen.screen_many``; ``frame`` has a unique column ``row`` and the metric columns of the fields in ``metrics``.
    """
    chunks, parts = -(-frame.count() // CELL_ROWS) or 1, -(-criteria.count() // CELL_CRITERIA) or 1
    places = [c for c in ("exchange", "sector") if c in frame.columns]
    cell = ["_chunk", "_part"]

    def dealt(name: str, n: int):
        return F.pmod(F.xxhash64(name), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    values = [F.col(METRIC_COLUMN[f]).cast("double").alias(f"_m{i}") for i, f in enumerate(metrics)]
    rows = frame.select(F.col(row).alias("_row"), "ticker", *places, *values).withColumn("_chunk", dealt("_row", chunks)).withColumn("_part", every(parts))
    asked = criteria.select(
        "criteria_key", *(F.col(c).alias(f"_{c}") for c in ("exchange", "sector")), "comparisons", "sort_field", "descending", "limit",
        dealt("criteria_key", parts).alias("_part")).withColumn("_chunk", every(chunks))
    # Tasks are numbered by the cells: the size of their input says little about their work.
    tasks = 2 * chunks * parts
    found = T.StructType([criteria.schema["criteria_key"], T.StructField(row, frame.schema[row].dataType),
                          T.StructField("ticker", frame.schema["ticker"].dataType), T.StructField("_value", T.DoubleType())])
    return rows.repartition(tasks, *cell).groupBy(*cell).cogroup(asked.repartition(tasks, *cell).groupBy(*cell)).applyInArrow(
        _cell(metrics, to_arrow_schema(found)), found)
