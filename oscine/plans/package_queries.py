"""Packs and archives of the documents' texts: what is written, read again and held against manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from oscine.operators import scratch
from oscine.plans.base import table
from oscine.sources import archives, packs

#: Documents of an archive.
IN_ARCHIVE = 64


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.format_string("%s/%08d.txt", "source", "doc_id").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def pack_roundtrip(spark, sf_dir):
    """Every text as a file of a pack: the manifest that the tasks' hashes make, and what a check of the stored bytes says."""
    folder = scratch.folder(spark, "pack")
    packs.write(_files(spark, sf_dir), folder, table="documents")
    wrong = packs.verify(spark, folder)
    return packs.manifest(spark, folder).join(wrong, "path", "left").select("path", "bytes", "sha256", F.coalesce("verdict", F.lit("ok")).alias("verdict"))


def archive_check(spark, sf_dir):
    """Texts in ZIP archives against a manifest that knows some of them otherwise, some not, and some that aren't there."""
    files = _files(spark, sf_dir).withColumn("archive", F.floor(F.col("doc_id") / IN_ARCHIVE))
    folder = scratch.folder(spark, "archives")
    zipped = archives.packed(files, "archive", "path", "content").select(F.format_string("%06d.zip", "archive").alias("path"), "content")
    packs.write(zipped, folder)
    found = archives.of(packs.read(spark, folder), "path", "content")
    digest = F.sha2("content", 256)
    named = files.where("doc_id % 10 <> 3").select(
        F.when(F.col("doc_id") % 10 == 7, F.concat("path", F.lit(".lost"))).otherwise(F.col("path")).alias("member"), F.when(F.col("doc_id") % 10 == 5, F.reverse(digest)).otherwise(digest).alias("sha256")
    )
    return archives.against(found, named)


SQL = {
    "pack_roundtrip": "SELECT printf('%s/%08d.txt', source, doc_id) AS path, octet_length(encode(coalesce(text, ''))) AS bytes, sha256(coalesce(text, '')) AS sha256, 'ok' AS verdict FROM documents",
    "archive_check": """WITH f AS (SELECT doc_id, printf('%s/%08d.txt', source, doc_id) AS path FROM documents)
        SELECT path AS member, CASE WHEN doc_id % 10 = 5 THEN 'tampered' ELSE 'extra' END AS verdict FROM f WHERE doc_id % 10 IN (3, 5, 7)
        UNION ALL SELECT path || '.lost', 'missing' FROM f WHERE doc_id % 10 = 7""",
}
QUERIES = {k: globals()[k] for k in SQL}
