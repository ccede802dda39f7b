"""Daily price files: three header layouts, zipped or plain, and which file stands for which day.

Files are read as lines with their path. A file's own header line names its layout and the position of every column, so
all layouts go through one distributed read and no path list passes through the driver.
"""

from __future__ import annotations

import io
import zipfile
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointpanel.functions.dates import parse_date
from pointpanel.operators.identity import is_equity

# Header names per layout, in the order of FIELDS.
FIELDS = ["symbol", "series", "open", "high", "low", "close", "prev_close", "volume", "date", "isin"]
LAYOUTS = {
    "legacy": ["SYMBOL", "SERIES", "OPEN", "HIGH", "LOW", "CLOSE", "PREVCLOSE", "TOTTRDQTY", "TIMESTAMP", "ISIN"],
    "udiff": ["TckrSymb", "SctySrs", "OpnPric", "HghPric", "LwPric", "ClsPric", "PrvsClsgPric", "TtlTradgVol", "TradDt", "ISIN"],
    "full": ["SYMBOL", "SERIES", "OPEN_PRICE", "HIGH_PRICE", "LOW_PRICE", "CLOSE_PRICE", "PREV_CLOSE", "TTL_TRD_QNTY", "DATE1", None],
}

# How a file name gives its date, the identifier-bearing layout first.
NAME_PATTERNS = [
    (r"(?i)cm(\d{2}[A-Z]{3}\d{4})bhav", "ddMMMyyyy"),
    (r"_(\d{8})(?!\d)", "ddMMyyyy"),
    (r"(?<!\d)(\d{8})(?!\d)", "yyyyMMdd"),
]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of every line below ``path``."""
    return (
        spark.read.option("recursiveFileLookup", "true").text(path)
        .select(F.col("_metadata.file_path").alias("file"), "value")
    )


#: More columns than any known layout has.
MAX_CELLS = 64


def _cells(line: Column) -> Column:
    """The cells of a line without quotes. Only lines with a quote need the CSV reader, and only their cells come without outer blanks."""
    plain = F.split(line, ",")
    schema = ", ".join(f"c{i} string" for i in range(MAX_CELLS))
    read = F.from_csv(line, schema, {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    count = F.size(F.split(F.regexp_replace(line, '"[^"]*"', ""), ","))

    def cut(r: Column) -> Column:
        return F.slice(F.array(*[F.coalesce(F.trim(r[f"c{i}"]), F.lit("")) for i in range(MAX_CELLS)]), 1, F.least(count, F.lit(MAX_CELLS)))

    quoted = F.get(F.transform(F.array(read), cut), 0)  # a lambda's argument is read once, not once for each cell
    return F.when(line.contains('"'), quoted).otherwise(plain)


def _marked(line: Column) -> Column:
    return F.upper(line).contains("SYMBOL") | F.upper(line).contains("TCKRSYMB")


def _layout(h: Column) -> Column:
    """(n, one position per field) of a header's cells, null if no layout has them; 0 marks a field the layout lacks."""
    def has(layout):
        return reduce(and_, [F.array_contains(h, n.upper()) for n in LAYOUTS[layout] if n])

    def position(i):
        at = F.lit(None).cast("bigint")
        for layout in reversed(list(LAYOUTS)):
            n = LAYOUTS[layout][i]
            at = F.when(has(layout), F.array_position(h, n.upper()) if n else F.lit(0)).otherwise(at)
        return at

    known = reduce(lambda a, b: a | b, [has(x) for x in LAYOUTS])
    return F.when(known, F.struct(F.size(h).alias("n"), *[position(i).cast("int").alias(f"p_{f}") for i, f in enumerate(FIELDS)]))


def headers(lines: DataFrame) -> DataFrame:
    """(file, n, one position per field) of every file whose header is known; 0 marks a field the layout lacks."""
    marked = lines.filter(_marked(F.col("value"))).select("file", F.transform(_cells(F.upper("value")), lambda c: F.trim(c)).alias("h"))
    rows = marked.select("file", _layout(F.col("h")).alias("l")).filter(F.col("l").isNotNull()).select("file", "l.*")
    return rows.dropDuplicates(["file"])


def layouts(lines: DataFrame) -> DataFrame:
    """(file, lines, n, one position per field) of every file, in one pass over its lines; n is null where no known header is among them."""
    found = F.when(_marked(F.col("value")), _layout(F.transform(_cells(F.upper("value")), lambda c: F.trim(c))))
    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.get(F.collect_set(found), 0).alias("l")).select("file", "lines", "l.*")


def unknown_layouts(lines: DataFrame) -> DataFrame:
    """Files no layout fits; an ingest must stop on them or count them as failed."""
    return lines.select("file").distinct().join(headers(lines), "file", "left_anti")


def parse_eod(lines: DataFrame, keep: tuple[str, ...] = (), heads: DataFrame | None = None) -> DataFrame:
    """Equity rows of all files. Other series, trailers and unreadable rows are skipped, never the whole file. ``keep`` names columns of
    ``lines`` or ``heads`` to carry along. ``heads`` are the headers, where these are known: a row a file, so no line is moved to meet them."""
    return _parsed(lines.join(F.broadcast(headers(lines) if heads is None else heads), "file"), keep)


def parse_archives(archives: DataFrame) -> DataFrame:
    """``parse_eod`` of (path, content) zip archives in one pass: a member's header is found in its own row, so nothing is unpacked twice,
    joined or shuffled."""
    marks = F.filter("lines", _marked)
    known = F.filter(F.transform(marks, lambda v: _layout(F.transform(_cells(F.upper(v)), lambda c: F.trim(c)))), lambda x: x.isNotNull())
    found = unzip(archives).select("lines", F.explode(F.slice(known, 1, 1)).alias("l"))
    return _parsed(found.select(F.explode("lines").alias("value"), "l.*"))


def _parsed(joined: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Equity rows of lines that carry the positions of their file's header."""
    def row(c: Column) -> Column:
        def cell(field):
            p = F.col(f"p_{field}")
            return F.when(p > 0, F.trim(F.try_element_at(c, p)))

        def number(field, kind="double"):
            return cell(field).try_cast(kind)

        return F.struct(
            (F.size(c) >= F.col("n")).alias("whole"),
            cell("symbol").alias("symbol"),
            F.coalesce(cell("isin"), F.lit("")).alias("isin"),
            F.upper(cell("series")).alias("series"),
            parse_date(cell("date")).alias("date"),
            *[number(f).alias(f) for f in ("open", "high", "low", "close")],
            F.when(number("prev_close") != 0, number("prev_close")).alias("prev_close"),
            F.coalesce(number("volume", "bigint"), F.lit(0)).alias("volume"),
        )

    # The row comes out of a generator: no filter is pushed below it, where each would split and read the line anew. And it comes out of a
    # lambda: generated code for all of it would be one method, too long for the JVM to compile.
    read = F.explode(F.transform(F.array(_cells(F.col("value"))), row)).alias("r")
    rows = joined.select(*keep, read).where("r.whole").select("r.*", *keep).drop("whole")
    return rows.filter(is_equity(F.col("series"))).dropna(subset=["date", "open", "high", "low", "close"])


def date_of_name(path: Column) -> tuple[Column, Column]:
    """(date, preference) read from a file's name; the first pattern that yields a date counts."""
    name = F.element_at(F.split(path, "/"), -1)
    found = []
    for i, (pattern, fmt) in enumerate(NAME_PATTERNS):
        text = F.regexp_extract(name, pattern, 1)
        if "MMM" in fmt:
            text = F.concat(F.substring(text, 1, 2), F.initcap(F.substring(text, 3, 3)), F.substring(text, 6, 4))
        d = F.try_to_timestamp(text, F.lit(fmt)).cast("date")
        found.append(F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(i).alias("preference"))))
    hit = F.coalesce(*found)
    return hit["date"], hit["preference"]


def pick_files(listing: DataFrame) -> DataFrame:
    """One file per trading day out of a listing (path): the layout that carries identifiers first."""
    d, preference = date_of_name(F.col("path"))
    ok = F.lower("path").endswith(".csv") | F.lower("path").endswith(".csv.zip")
    return (
        listing.filter(ok).select("path", d.alias("date"), preference.alias("preference"))
        .filter(F.col("date").isNotNull())
        .groupBy("date").agg(F.min_by("path", F.struct("preference", "path")).alias("path"))
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths below ``root``; the contents are never read because only the path column is asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")


def unzip(archives: DataFrame) -> DataFrame:
    """(file, lines) of every csv member of (path, content) zip archives."""

    def extract(batches):
        for batch in batches:
            files, lines = [], []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for member in z.namelist():
                        if member.lower().endswith(".csv"):
                            files.append(f"{path}!{member}")
                            lines.append(z.read(member).decode("utf-8", "replace").splitlines())
                if len(files) >= MEMBERS:
                    yield _members(files, lines)
                    files, lines = [], []
            if files:
                yield _members(files, lines)

    return archives.select("path", "content").mapInArrow(extract, "file string, lines array<string>")


#: Members that a worker hands over at once: their whole text is in memory.
MEMBERS = 32


def _members(files: list[str], lines: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(lines, pa.list_(pa.string()))], ["file", "lines"])


def unzip_lines(archives: DataFrame) -> DataFrame:
    """(file, value) lines of every csv member of (path, content) zip archives."""
    return unzip(archives).select("file", F.explode("lines").alias("value"))


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    return unzip_lines(
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(root)
    )
