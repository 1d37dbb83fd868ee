"""Files of bytes in splits, whatever their size: Spark's text reader, told to break lines at given bytes, cuts a file between
tasks, and each task finds its own first break. It gives the bytes between breaks unchanged, as it decodes nothing.

What it doesn't give is where a piece stands. Each split numbers its own bytes; only the splits' totals, a row each, meet over a
file, and are joined back. No byte of a file is shuffled for that. Compressed files aren't split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _within_splits(separator: int):
    """Adds to each piece its place among the bytes of its split, and the size of the piece before it there, null for the first."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, last = None, 0, None
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column("data")), np.int64)
            sources, splits = batch.column("source").to_pylist(), np.asarray(batch.column("split"))
            inner, before = np.zeros(len(sizes), np.int64), np.full(len(sizes), -1, np.int64)
            edges = [0, *(np.flatnonzero(splits[1:] != splits[:-1]) + 1).tolist(), len(sizes)]
            edges = sorted({*edges, *(i for i in range(1, len(sources)) if sources[i] is not sources[i - 1] and sources[i] != sources[i - 1])})
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if (sources[lo], int(splits[lo])) != key:
                    key, at, last = (sources[lo], int(splits[lo])), 0, -1
                ends = at + np.cumsum(sizes[lo:hi] + separator)
                inner[lo:hi] = ends - sizes[lo:hi] - separator
                before[lo:hi] = np.append(last, sizes[lo : hi - 1])
                at, last = int(ends[-1]), int(sizes[hi - 1])
            yield pa.record_batch({"source": batch.column("source"), "file_size": batch.column("file_size"), "split": batch.column("split"), "inner": inner, "before": pa.array(before, mask=before < 0), "data": batch.column("data")})

    return place


def pieces(spark: SparkSession, path: str, separator: bytes) -> DataFrame:
    """source, pos, before, file_size and data of what stands between separators: pos is where data begins in the file, before the
    size of the piece before it, null for the first of a file. A piece that ends with the file's last separator isn't there if it is empty."""
    lines = spark.read.option("encoding", "ISO-8859-1").text(path, lineSep=separator.decode("latin-1"))
    raw = lines.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("data"))
    inside = raw.mapInArrow(_within_splits(len(separator)), "source string, file_size long, split long, inner long, before long, data binary")
    ends = inside.groupBy("source", "split").agg(F.sum(F.length("data") + len(separator)).alias("size"), F.max_by(F.length("data"), "inner").cast("long").alias("last"))
    earlier = Window.partitionBy("source").orderBy("split")
    bases = ends.select(
        F.col("source"), F.col("split"), F.coalesce(F.sum("size").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lag("last").over(earlier).alias("carried")
    )
    placed = inside.join(bases, ["source", "split"])
    return placed.select("source", (F.col("base") + F.col("inner")).alias("pos"), F.coalesce("before", "carried").alias("before"), "file_size", "data")


def blocks(found: DataFrame, begin: str, size: str, keep: list[str], separator: bytes) -> DataFrame:
    """source, block, data and the kept columns: the files' bytes from begin on, cut into blocks of size bytes (columns of the
    pieces' rows); a cut last block is left out. A piece is taken apart by the blocks that it is in, with the separator after it, and parts of a
    block are joined in order."""
    more = F.col("pos") + F.length("data") < F.col("file_size")  # the last piece may end without a separator
    ended = found.withColumn("data", F.when(more, F.concat("data", F.lit(bytearray(separator)))).otherwise(F.col("data"))).where(F.length("data") > 0)
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - F.col(begin)) / F.col(size)))
    last = F.floor((F.col("pos") + F.length("data") - 1 - F.col(begin)) / F.col(size))
    parts = ended.withColumn("block", F.explode(F.when(last >= first, F.sequence(first, last))))
    start = F.col(begin) + F.col("block") * F.col(size)
    lo, hi = F.greatest("pos", start), F.least(F.col("pos") + F.length("data"), start + F.col(size))
    cut = parts.select("source", "block", *keep, size, lo.alias("lo"), F.substring("data", (lo - F.col("pos") + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    # a task's own parts of a block are joined there, before the few that two splits share meet
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("lo", "part"))), F.lit(bytearray()).cast("binary"), lambda a, p: F.concat(a, p["part"]))
    joined = cut.groupBy("source", "block", *keep, size).agg(whole.alias("data"))
    return joined.where(F.length("data") >= F.col(size)).select("source", "block", *keep, F.substring("data", F.lit(1), F.col(size)).alias("data"))
