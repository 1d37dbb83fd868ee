"""The queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from oscine.llm import common as C
from oscine.llm import centroids, decontamination, embedding_dedup, html_text, jaccard_join, line_dedup, mixing, prefix_trie, quality, resharding, substring_dedup, suffix_dedup, token_counts

#: Production parameters of the mixing query: shares of the tokens of all documents.
MIX_TARGETS = {"clean": 0.97, "low": 0.02, "toxic": 0.01}


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(C.load(spark, sf_dir, "documents"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(C.load(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(C.load(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(C.load(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(C.load(spark, sf_dir, "documents"), token_counts.read_pieces(token_counts.public_path()))


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "labels"), MIX_TARGETS)
    shares = [F.round(F.element_at("p", i + 1), 6).alias(f"p_{x}") for i, x in enumerate(mixing.DOMAINS)]
    return mixed.select("doc_id", "tokens", *shares, F.round("rate", 6).alias("rate"), "copies")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(C.load(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(C.load(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.md5(F.encode("kept_text", "UTF-8")).alias("kept_md5"))


def op8_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = resharding.reshard(C.load(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.load(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.with_overlaps(docs, C.load(spark, sf_dir, "benchmark"), "item_ids")
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(C.load(spark, sf_dir, "conversations"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster(C.load(spark, sf_dir, "embeddings")))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(C.load(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (pipeline, op1_html_text, op2_suffix_dedup, op3_substring_dedup, op4_token_counts, op5_mixing_sources, op6_jaccard_join, op7_line_dedup, op8_resharding, op9_decontamination, op10_quality_rules, op11_prefix_trie, op12_centroid_clustering, op13_embedding_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": line_dedup.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE, "op12_centroid_clustering": centroids.ORACLE, "op13_embedding_dedup": embedding_dedup.ORACLE}
