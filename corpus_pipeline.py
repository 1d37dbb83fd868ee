"""The corpus pipeline: quality rules, near-duplicate join, benchmark decontamination, mixing to target weights, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
docs. All stages but the last return the columns of docs; the last adds the shard and the slot in it. SQL can't express the
stages' methods (expectation-maximisation, sketches, a fitted classifier), so that ORACLE_SQL is None and tests hold each
stage against a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscine.llm import common as C
from oscine.llm import decontamination, jaccard_join, mixing, quality, resharding

ORACLE_SQL = None

#: Weights of the domains' tokens. The stage only lowers rates, from 1: what is confidently clean stays, and of the rest as much
#: as the weights allow.
MIX_TARGETS = {"clean": 0.95, "low": 0.05, "toxic": 0.0}


def _join_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of docs that have a verdict (row, own). Rows are told apart by id and text, so that ids may be null or stand in
    several rows; rows that are equal in both share a verdict. Columns of docs keep their names, whatever they are."""
    row, own = C.free_names(docs.columns, "__row", "__own")
    keyed = docs.withColumns({row: F.xxhash64("doc_id", "text"), own: F.xxhash64("text")})
    told = verdicts.select(F.col("row").alias(row), F.col("own").alias(own)).distinct()
    return keyed.join(told, [row, own], "left_semi").drop(row, own)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least doc_id stays; of rows equal in id and text, one."""
    found = jaccard_join.jaccard_join(docs, with_rows=True)
    each = found.groupBy("class_id", "doc_id", "row", "own").agg(F.count("*").alias("n"))
    first = each.groupBy("class_id").agg(F.min(F.struct("doc_id", "row", "own", "n")).alias("first"))
    row, own, n = C.free_names(docs.columns, "__row", "__own", "__n")
    told = first.select(F.col("first.row").alias(row), F.col("first.own").alias(own), F.col("first.n").alias(n))
    kept = docs.withColumns({row: F.xxhash64("doc_id", "text"), own: F.xxhash64("text")}).join(told, [row, own])
    # of rows equal in id and text the least in its columns stays, so that runs agree
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = kept.where(F.col(n) > 1).groupBy(row, own).agg(F.min_by(whole, F.to_json(whole)).alias("kept")).select("kept.*")
    return kept.where(F.col(n) == 1).drop(row, own, n).union(least)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    (items,) = C.free_names(docs.columns, "__found")
    found = decontamination.with_overlaps(docs, C.load(spark, sf_dir, "benchmark"), items)
    return found.where(F.size(items) == 0).drop(items)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay with their rate as probability, by hash."""
    mixed = mixing.mix(docs, C.load(spark, sf_dir, "labels"), MIX_TARGETS, most=1.0, keep="clean")
    return _join_rows(docs, mixed.where("copies > 0").select("row", "own"))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, and where each document goes: shard and slot, which take the place of columns of these names."""
    docs = docs.drop("shard", "slot")
    (n,) = C.free_names([*docs.columns, "size", "text_crc32", "own", "old_shard", "unit", "home", "block", "unit_bytes", "copies", "first", "begin", "middle"], "__n")
    numbered = C.materialize(docs.withColumn(n, F.monotonically_increasing_id()), "numbered")  # equal rows get places of their own
    placed = resharding.reshard(numbered, also=(n,)).select(n, "shard", "slot")
    return numbered.join(placed, n).drop(n)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder."""
    docs = C.load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
