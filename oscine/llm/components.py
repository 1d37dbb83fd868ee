"""Connected components of a graph given by its edges, by joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscine.llm import common as C


def components(edges: DataFrame) -> DataFrame:
    """edges: a long, b long. Gives node, label for every node of an edge; label is the least node of its component.

    Each round takes the least label among a node's neighbours, hooks it to the node's own root too, and then jumps from a
    label to the label's label. All grouping is by minimum, so that a node with very many edges is summed up before it is
    shuffled. Rounds are written to the shared folder."""
    apart = edges.where("a <> b").select("a", "b").distinct()
    both = C.materialize(apart.union(apart.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = C.materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("there")), "b").groupBy("a").agg(F.min("there").alias("there"))
        seen = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("before"), F.least("label", "there").alias("least"))
        to_root = seen.select(F.col("before").alias("node"), F.lit(None).cast("long").alias("before"), "least")
        hooked = seen.union(to_root).groupBy("node").agg(F.max("before").alias("before"), F.min("least").alias("label"))
        above = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = hooked.join(above, "label").select("node", F.col("top").alias("label"), (F.col("top") != F.col("before")).alias("changed"))
        new = C.materialize(new, "labels")
        if new.where("changed").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
