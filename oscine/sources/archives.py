"""ZIP archives as rows: a member is a row, found by the archive's own directory.

An archive is read by one task, a member at a time; many archives are many tasks. What can't be read, such as a member whose
checksum is wrong, gives a row that says so rather than an end to the job."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "archive string, member string, bytes long, content binary, error string"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for source, content in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows: list[tuple] = []
            try:
                with zipfile.ZipFile(io.BytesIO(content or b"")) as found:
                    for info in found.infolist():
                        if info.is_dir():
                            continue
                        try:
                            data, error = found.read(info), None
                        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, OSError, zipfile.zlib.error) as wrong:
                            data, error = None, str(wrong)
                        yield _batch([(source, info.filename, info.file_size, data, error)])
            except zipfile.BadZipFile as wrong:
                rows = [(source, None, None, None, str(wrong))]
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    return pa.record_batch([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in MEMBERS.split(", ")])


def of(files: DataFrame, archive: str, content: str) -> DataFrame:
    """archive, member, bytes, content and error of the members of archives held in a binary column; an archive that is none gives a row without
    member."""
    return files.select(F.col(archive).alias("archive"), F.col(content).alias("content")).mapInArrow(_members, MEMBERS)


def members(spark: SparkSession, path: str) -> DataFrame:
    """The same of archive files; Spark lists no files without bytes."""
    return of(spark.read.format("binaryFile").load(path), "path", "content")


def csv_rows(found: DataFrame, pattern: str, schema: str) -> DataFrame:
    """archive, member, line (from 1, below the header) and the named fields of the members whose name matches; a line that doesn't fit has null fields."""
    lines = found.where(F.col("member").rlike(pattern)).select("archive", "member", F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("line", "text"))
    rows = lines.where((F.col("line") > 0) & (F.trim("text") != ""))
    return rows.select("archive", "member", "line", F.from_csv("text", schema).alias("r")).select("archive", "member", "line", "r.*")


def json_rows(found: DataFrame, pattern: str, schema: str) -> DataFrame:
    """archive, member and the fields of the JSON members whose name matches."""
    return found.where(F.col("member").rlike(pattern)).select("archive", "member", F.from_json(F.decode("content", "UTF-8"), schema).alias("r")).select("archive", "member", "r.*")


def against(found: DataFrame, named: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """member and verdict of what differs between the members of a package and its manifest (member, sha256): tampered, missing
    (named and not there), extra (there and not named), unreadable, and required (a member that must be named and isn't)."""
    there = found.where("member IS NOT NULL").select("member", F.sha2("content", 256).alias("found"), F.col("error").isNotNull().alias("bad"))
    both = named.select("member", "sha256").join(there, "member", "full")
    verdict = F.when(F.col("bad"), "unreadable").when(F.col("sha256").isNull(), "extra").when(F.col("found").isNull(), "missing").when(F.col("found") != F.lower("sha256"), "tampered")
    wrong = both.select("member", verdict.alias("verdict")).where("verdict IS NOT NULL")
    if required is None:
        return wrong
    return wrong.union(required.select("member").join(named, "member", "left_anti").select("member", F.lit("required")))


def packed(files: DataFrame, key: str, name: str, content: str) -> DataFrame:
    """key and content: an archive of the rows of each key, members in order of name and with one fixed time, so that equal rows
    give equal bytes. A key's rows are one archive and so one task's work."""

    def pack(group: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by(name)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, data in zip(table.column(name).to_pylist(), table.column(content).to_pylist(), strict=True):
                z.writestr(zipfile.ZipInfo(n, (1980, 1, 1, 0, 0, 0)), data or b"", zipfile.ZIP_DEFLATED)
        return pa.table({key: pa.array([group[0].as_py()], group[0].type), "content": pa.array([out.getvalue()], pa.binary())})

    return files.select(key, name, content).groupBy(key).applyInArrow(pack, files.select(key).schema.add("content", "binary"))
