"""Writers: recordings, result tables, and manifests of what was written."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oscine.sources.frames import CHANNELS, SYNC


def recordings(samples: DataFrame, path: str, mode: str = "error") -> None:
    """Samples as Parquet, a folder for each recording, which later reads prune by."""
    samples.repartition("recording_id").sortWithinPartitions("recording_id", "channel", "sample_idx").write.mode(mode).partitionBy("recording_id").parquet(path)


def frames_csv(decoded: DataFrame, path: str, mode: str = "error") -> None:
    """A line for each frame: its fields, and a column for each channel."""
    flags = [F.col(f"status.{c}").cast("int").alias(c) for c in decoded.schema["status"].dataType.names]
    codes = [F.col("adc")[c].alias(f"ch{c + 1:02d}") for c in range(CHANNELS)]
    decoded.select("frame_id", "timestamp", "crc_valid", *flags, *codes).write.mode(mode).option("header", True).csv(path)


def _without_sync(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands between the sync words of a file: nothing before the first, then each record's rest."""
    yield pa.record_batch({"body": pa.array([b""], pa.binary())})
    for batch in batches:
        yield pa.record_batch({"body": pa.array([None if r is None else r[len(SYNC) :] for r in batch.column(0).to_pylist()], pa.binary()).drop_null()})


def captures(records: DataFrame, path: str, order: list[str], raw: str = "raw", mode: str = "error") -> None:
    """Records as capture files, one for each task, each in order and all of them in order of the files' names: Spark's text writer
    with the sync word as its end of line, so that a file ends in a sync word without a record behind it."""
    ordered = records.repartitionByRange(*order).sortWithinPartitions(*order).select(raw)
    bodies = ordered.mapInArrow(_without_sync, "body binary").select(F.col("body").cast("string").alias("value"))
    bodies.write.mode(mode).option("encoding", "ISO-8859-1").option("lineSep", SYNC.decode("latin-1")).text(path)


def ordered_csv(table: DataFrame, path: str, order: list[str], mode: str = "error") -> None:
    """A result table as CSV files that are in order one after the other, by ranges of the order's columns."""
    results_csv(table.repartitionByRange(*order).sortWithinPartitions(*order), path, mode)


def results_csv(table: DataFrame, path: str, mode: str = "error") -> None:
    """A result table as CSV; columns that CSV can't hold are left out, and missing numbers are blank."""
    plain = [f.name for f in table.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary")]
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if dict(table.dtypes)[c] in ("double", "float") else F.col(c) for c in plain]
    table.select(*clean).write.mode(mode).option("header", True).csv(path)


def trial_sheet(order: DataFrame, path: str, mode: str = "error") -> None:
    """The order of trials as CSV, a mark on each trial that begins a session."""
    first = F.lag("session").over(Window.partitionBy().orderBy("session", "trial"))  # a plan of trials, not data
    order.withColumn("begins_session", ~F.col("session").eqNullSafe(first)).orderBy("session", "trial").coalesce(1).write.mode(mode).option("header", True).csv(path)


def results_json(table: DataFrame, path: str, mode: str = "error") -> None:
    table.write.mode(mode).json(path)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, sha256 and size of every file below a folder; files are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def latest(spark: SparkSession, folder: str) -> str | None:
    """The newest file of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.agg(F.max_by("path", "modificationTime").alias("p")).first()["p"]
