"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscine.operators import scratch


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a folder that executors share."""
    path = scratch.folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _settled(stars: DataFrame) -> bool:
    """Whether every node hangs on one other that hangs on none."""
    ends = stars.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(stars.select("b", F.lit(0), F.lit(1)))
    wrong = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs + holds > 1")
    return wrong.isEmpty()


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node and component, the least node that a node is connected with, for every node of an edge. Large stars and small stars
    take turns: a node's larger neighbours are hung on the least of all its neighbours, then its smaller ones are, until every
    node hangs on the least of its component. Edges never become more than they were, and each round is written to the shared
    folder, so that plans stay short and a lost executor costs one round. Null ends are no edge."""
    pairs = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    alone = pairs.where("a = b").select(F.col("a").alias("node")).distinct()
    stars = written(pairs.where("a <> b").distinct(), "stars")
    while not _settled(stars):
        both = stars.union(stars.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "stars")
        center = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(center, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(center.select("a", F.col("m").alias("b"))).distinct()
        stars = written(small, "stars")
    hung = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = hung.union(roots)
    return found.union(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
