"""The queries of this subpackage and the SQL that checks those which SQL can express."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointpanel.llm import (
    jaccard_join, line_dedup, line_rules, minhash_tensor, mixing, packing, prefix_trie, projection_search, quality_gam, secret_scan, toxicity_kn,
    tree_negatives, warc_derive,
)


#: A document of a small source is seen at most so many times as often as one of the largest source.
MIX_REPETITION = 1.25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public tokenizer's file, found where each process has it installed."""
    return importlib.import_module("public_tokenizers").path(name)


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.col("at").cast("long").alias("word_index"), "found", "score", "is_secret", F.col("y").alias("rule_label"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc_derive.derive(warc_derive.responses(pages)).select(
        "page_id", *(F.col("headers")[name].alias(name.lower().replace("-", "_")) for name in warc_derive.FIELDS), "block")


def op4_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines",
        "n_failed_lines", "lost_chars", F.sha2("cleaned", 256).alias("cleaned_sha256"))


def op5_projection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_search.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op8_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_toxicity_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_kn.classify(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), repetition=MIX_REPETITION).select("doc_id", "source", "epoch", "place", "weight")


def op11_minhash_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_tensor.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, origin = F.expr("crc32(cast(cast(conv_id as string) as binary)) % 9"), F.expr("conv_id - conv_id % 5")
    return prefix_trie.prefix_trie(prefix_trie.forked(table(spark, sf_dir, "conversations"), kept, origin))


def op13_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return tree_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


QUERIES = {
    "op1_quality_gam": op1_quality_gam,
    "op2_secret_scan": op2_secret_scan,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_line_first": op4_line_first,
    "op5_projection_search": op5_projection_search,
    "op6_line_dedup": op6_line_dedup,
    "op7_swap_packing": op7_swap_packing,
    "op8_jaccard_components": op8_jaccard_components,
    "op9_toxicity_kn": op9_toxicity_kn,
    "op10_temperature_mix": op10_temperature_mix,
    "op11_minhash_tensor": op11_minhash_tensor,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_tree_negatives": op13_tree_negatives,
}
ORACLES: dict[str, str] = {}


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict:
    from pointpanel.llm import oracle_sql

    return dict(oracle_sql.ORACLES)
