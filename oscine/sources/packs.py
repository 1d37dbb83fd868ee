"""Packs: folders of files with a manifest of their sizes and hashes, written by tasks and known from the commit on.

A task hashes what it writes while it writes it, into a folder of its attempt's own, and tells the driver path, place, size and
hash. The commit writes the manifest from what the successful attempts told, under another name first; so a reader sees all of
a pack or none of it, and an attempt that was given up has no entry. What was told is as long as the list of files; texts and
contents never pass the driver. Writing again replaces the manifest, not the files that an older one names."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"
ENTRIES = "path string, file string, bytes long, sha256 string"


def _store(folder: str):
    """The file system of a folder, and the folder in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


@dataclass
class _Told(WriterCommitMessage):
    part: str
    entries: list[tuple]


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, about: str):
        self.folder, self.about = folder.rstrip("/"), about

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, root = _store(self.folder)
        part = f"parts/{uuid.uuid4().hex}"
        store.create_dir(f"{root}/{part}", recursive=True)
        entries = []
        try:
            for k, row in enumerate(iterator):
                if not row["path"]:
                    raise ValueError("a file of a pack needs a path")
                content, file = bytes(row["content"] or b""), None
                if content:  # what is empty needs no file
                    file = f"{part}/{k}"
                    with store.open_output_stream(f"{root}/{file}") as out:
                        out.write(content)
                entries.append((row["path"], file, len(content), hashlib.sha256(content).hexdigest()))
        except BaseException:
            store.delete_dir(f"{root}/{part}")
            raise
        return _Told(part, entries)

    def commit(self, messages: list) -> None:
        entries = sorted((e for m in messages if m is not None for e in m.entries), key=lambda e: e[0])
        twice = {a[0] for a, b in zip(entries, entries[1:]) if a[0] == b[0]}
        if twice:
            self.abort(messages)
            raise ValueError(f"paths that stand twice in the pack: {sorted(twice)[:5]}")
        store, root = _store(self.folder)
        lines = [json.dumps({"path": p, "file": f, "bytes": n, "sha256": h}, ensure_ascii=False) for p, f, n, h in entries]
        with store.open_output_stream(f"{root}/_{MANIFEST}.new") as out:
            out.write("".join(f"{x}\n" for x in lines).encode())
        with store.open_output_stream(f"{root}/_about.json") as out:
            out.write(json.dumps({"about": json.loads(self.about), "files": len(lines), "bytes": sum(e[2] for e in entries)}).encode())
        store.move(f"{root}/_{MANIFEST}.new", f"{root}/{MANIFEST}")

    def abort(self, messages: list) -> None:
        store, root = _store(self.folder)
        for m in messages:
            if m is not None:
                store.delete_dir(f"{root}/{m.part}")


class PackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "oscine_pack"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not {"path", "content"} <= set(schema.names):
            raise ValueError("a pack's rows have path and content")
        return _Writer(self.options["path"], self.options.get("about", "{}"))


def write(files: DataFrame, folder: str, **about: object) -> None:
    """Writes rows of path and content as a pack; about goes to a file beside the manifest, with the numbers of files and bytes."""
    spark = files.sparkSession
    spark.dataSource.register(PackSource)
    files.select("path", "content").write.format("oscine_pack").mode("append").option("about", json.dumps(about)).save(folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path, file (null for an empty one), bytes and sha256 of the files of a pack."""
    return spark.read.schema(ENTRIES).json(f"{folder.rstrip('/')}/{MANIFEST}")


def _present(spark: SparkSession, folder: str) -> DataFrame:
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder.rstrip('/')}/parts")
    return stored.select(F.regexp_extract("path", r"(parts/[^/]+/[^/]+)$", 1).alias("file"), "content", F.sha2("content", 256).alias("found"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, sha256 and content of the files that the manifest names; others aren't the pack's."""
    named = manifest(spark, folder)
    stored = named.join(_present(spark, folder), "file").select("path", "bytes", "sha256", "content")
    return stored.union(named.where("file IS NULL").select("path", "bytes", "sha256", F.lit(bytearray())))


def verify(spark: SparkSession, folder: str, required: DataFrame | None = None) -> DataFrame:
    """path and verdict of what isn't as the manifest says: tampered, missing, stray (a file of no entry), or required (a path
    that must be there and has no entry)."""
    both = manifest(spark, folder).where("file IS NOT NULL").join(_present(spark, folder).drop("content"), "file", "full")
    verdict = F.when(F.col("path").isNull(), "stray").when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "tampered")
    wrong = both.select(F.coalesce("path", "file").alias("path"), verdict.alias("verdict")).where("verdict IS NOT NULL")
    if required is None:
        return wrong
    return wrong.union(required.select("path").join(manifest(spark, folder), "path", "left_anti").select("path", F.lit("required")))
