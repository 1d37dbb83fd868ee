"""Readers of recordings by the ending of a file's name; readers of other formats may be added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oscine.sources import frames, rhd

Reader = Callable[[SparkSession, str], DataFrame]
_READERS: dict[str, Reader] = {}


def register(ending: str, reader: Reader) -> None:
    """A reader gives source, channel, sample_idx, uv, fs."""
    _READERS[ending.lower()] = reader


def load(spark: SparkSession, path: str) -> DataFrame:
    """The recordings of a file or folder, read by the ending of its name."""
    for ending, reader in _READERS.items():
        if path.lower().rstrip("/").endswith(ending):
            return reader(spark, path)
    raise ValueError(f"no reader for {path}; known endings: {sorted(_READERS)}")


register(".bin", lambda spark, path: frames.recording(frames.decode(frames.read(spark, path), strict=True)))
register(".rhd", lambda spark, path: rhd.recording(spark, path))
register(".parquet", lambda spark, path: spark.read.parquet(path))
