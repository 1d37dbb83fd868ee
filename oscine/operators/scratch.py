"""Folders for what is written on the way, shared by driver and executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names; it goes when the program ends. Only a session on this machine
    alone may leave that unset, since a cluster's executors don't share a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.gettempdir()
    path = f"{root.rstrip('/')}/oscine-{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # the session has ended before
            pass

    atexit.register(remove)
    return path
