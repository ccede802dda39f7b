"""Line dedup: lines found in many documents go, except in the largest document id that holds them.

Lines are normalised, hashed to 128 bits and counted once per document; only hashes travel to the count, and a line that a third of
the documents share arrives pre-aggregated. The frequent hashes return to their documents by doc_id, and the texts are shuffled once.

Defined results: a null or empty text is one empty line; rows that repeat a doc_id count as one document, and all rows of the largest
doc_id keep the line; a null doc_id counts for nothing and loses nothing; further columns pass through, those named like the results
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit(1)).alias("b"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``; a key of at least ``min_chars`` code points found in at least
    ``min_docs`` documents loses its lines everywhere but in the largest doc_id."""
    docs = docs.drop("_doc", "_gone", "_stays")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    hashes = F.transform(lines, lambda line: F.when(F.length(line) >= min_chars, F.transform(
        F.array(line_key(line)), lambda key: F.when(F.length(key) >= min_chars, _hash(key)))[0]))
    held = (
        docs.where(F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("_doc"), F.explode(F.array_distinct(F.array_compact(hashes))).alias("_h"))
        .select("_doc", F.col("_h.a").alias("_a"), F.col("_h.b").alias("_b"))
    )
    frequent = (
        held.groupBy("_a", "_b").agg(F.count_distinct("_doc").alias("_n"), F.max("_doc").alias("_keeper"))
        .where(F.col("_n") >= min_docs).drop("_n")
    )
    gone = (
        held.join(frequent, ["_a", "_b"]).where(F.col("_doc") != F.col("_keeper"))
        .groupBy("_doc").agg(F.collect_set(F.struct(F.col("_a").alias("a"), F.col("_b").alias("b"))).alias("_gone"))
    )
    marked = docs.join(gone, docs["doc_id"] == gone["_doc"], "left")
    stays = F.when(F.col("_gone").isNull(), lines).otherwise(F.transform(
        F.filter(F.arrays_zip(lines.alias("line"), hashes.alias("h")),
                 lambda x: x["h"].isNull() | ~F.array_contains(F.col("_gone"), x["h"])),
        lambda x: x["line"]))
    return (
        marked.withColumn("_stays", stays)
        .withColumns({
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": (F.size(lines) - F.size("_stays")).cast("long"),
            "kept_text": F.array_join("_stays", "\n"),
        }).drop("_doc", "_gone", "_stays")
    )
