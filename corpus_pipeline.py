"""The composed training-data pipeline: each stage works on all that its predecessor kept.

Quality filter, line dedup, near duplicates (one document of each group stays), mixing of the sources to target weights, packing. The
stages but the last return the columns of documents. The result cannot be written in SQL: the first stage fits a model and the last
one tokenizes. Tests compare it with its operators called in turn, and each of these with its own oracle or brute force.

Defined results: null texts become empty texts after line dedup and are kept, mixed and packed as such (one separator); rows that repeat an id and
its text are one from the near-duplicate stage on, rows that repeat an id with other texts are documents of their own; rows without an id stay;
an empty table gives no rows; columns besides those of documents pass through until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointpanel.llm import jaccard_join, line_dedup, mixing, packing, quality_gam
from pointpanel.llm.registry import MIX_REPETITION, vocabulary
from pointpanel.llm.words import ARROW_ROWS
from pointpanel.session import scratch_path


def _settings(spark: SparkSession) -> None:
    """Whole texts reach the Python workers of a stage in batches of few rows, which bounds what an executor holds beside its heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least one half."""
    _settings(spark)
    return quality_gam.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without lines that many of them share; n_chars follows the text, null texts become empty."""
    cleaned = line_dedup.dedup_lines(docs).withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long"))
    return cleaned.select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates."""
    _settings(spark)
    return jaccard_join.keep_first(docs).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document at least once, those of smaller sources up to ``MIX_REPETITION`` times as often as those of the largest."""
    return mixing.mix(docs, repetition=MIX_REPETITION).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences."""
    _settings(spark)
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_shared_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and reread as the next stage's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        if stage is STAGES[-1][1]:
            return result
        path = scratch_path(spark, name.replace(" ", "-"))
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
