"""Packs and archives: what is whole, tampered with, missing, extra, cut or given up."""

import hashlib
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from oscine.sources import archives, packs

FILES = [("a.txt", b"alpha"), ("b/c.csv", b"x,y\r\n1,2\r\n\r\n3,oops\n"), ("empty", b""), ("é \n odd", b"\x00\xff" * 500), ("meta.json", b'{"board": "A", "lots": [1, 2]}')]


def _df(spark, rows, parts=3):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary").repartition(parts)


def _stored(folder, path):
    for line in open(f"{folder}/manifest.json"):
        entry = json.loads(line)
        if entry["path"] == path:
            return f"{folder}/{entry['file']}"


def test_pack(spark, tmp_path):
    folder = str(tmp_path / "pack")
    packs.write(_df(spark, FILES), folder, seed=3)
    found = {r.path: (r.bytes, r.sha256) for r in packs.manifest(spark, folder).collect()}
    assert found == {p: (len(c), hashlib.sha256(c).hexdigest()) for p, c in FILES}
    assert {r.path: bytes(r.content) for r in packs.read(spark, folder).collect()} == dict(FILES)
    assert json.load(open(f"{folder}/_about.json")) == {"about": {"seed": 3}, "files": 5, "bytes": sum(len(c) for _, c in FILES)}
    required = spark.createDataFrame([("a.txt",), ("z.txt",)], "path string")
    assert {tuple(r) for r in packs.verify(spark, folder, required).collect()} == {("z.txt", "required")}
    with open(_stored(folder, "a.txt"), "ab") as f:
        f.write(b"!")
    os.remove(_stored(folder, "meta.json"))
    os.makedirs(f"{folder}/parts/left")
    with open(f"{folder}/parts/left/0", "wb") as f:
        f.write(b"of an attempt that was given up")
    assert {tuple(r) for r in packs.verify(spark, folder).collect()} == {("a.txt", "tampered"), ("meta.json", "missing"), ("parts/left/0", "stray")}
    packs.write(_df(spark, FILES[:2]), folder)  # again
    assert {r.path for r in packs.manifest(spark, folder).collect()} == {"a.txt", "b/c.csv"}


@pytest.mark.parametrize("bad", [[("a", b"1"), (None, b"2")], [("a", b"1"), ("b", b"2"), ("a", b"3")]])
def test_a_pack_that_fails_has_no_entry(spark, tmp_path, bad):
    folder = str(tmp_path / "pack")
    with pytest.raises(Exception, match="needs a path|stand twice"):
        packs.write(_df(spark, bad), folder)
    assert not os.path.exists(f"{folder}/manifest.json")
    assert not [f for f in os.listdir(f"{folder}/parts") if os.listdir(f"{folder}/parts/{f}")] if os.path.exists(f"{folder}/parts") else True


def test_a_task_that_fails_and_runs_again_has_one_entry(spark, tmp_path):
    """What an attempt wrote before it failed isn't named; the attempt that ends is."""
    writer = packs._Writer(str(tmp_path / "pack"), "{}")

    def rows(fail):
        yield {"path": "a", "content": b"1"}
        if fail:
            raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(rows(True))
    given_up, told = writer.write(rows(False)), writer.write(rows(False))
    writer.commit([told, None])
    assert [(r.path, r.file) for r in packs.manifest(spark, str(tmp_path / "pack")).collect()] == [("a", told.entries[0][1])]
    assert {tuple(r) for r in packs.verify(spark, str(tmp_path / "pack")).collect()} == {(given_up.entries[0][1], "stray")}
    assert len(os.listdir(tmp_path / "pack" / "parts")) == 2


def _zip(rows):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("folder/", b"")
        for n, c in rows:
            z.writestr(n, c)
    return out.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "good.zip").write_bytes(_zip(FILES))
    stored = io.BytesIO()
    with zipfile.ZipFile(stored, "w", zipfile.ZIP_STORED) as z:
        z.writestr("one", b"payload-payload")
        z.writestr("two", b"other")
    (tmp_path / "bad.zip").write_bytes(stored.getvalue().replace(b"payload-payload", b"payload-pAyload"))
    (tmp_path / "none.zip").write_bytes(b"no archive")
    found = archives.members(spark, f"{tmp_path}/*.zip").collect()
    by = {}
    for r in found:
        by.setdefault(r.archive.rsplit("/", 1)[1], []).append(r)
    assert {r.member: bytes(r.content) for r in by["good.zip"]} == dict(FILES) and {r.bytes for r in by["bad.zip"]} == {15, 5}
    assert {(r.member, r.content is None, r.error is None) for r in by["bad.zip"]} == {("one", True, False), ("two", False, True)}
    assert [(r.member, r.error is None) for r in by["none.zip"]] == [(None, False)]
    held = archives.of(spark.createDataFrame([("x", bytearray()), ("y", None)], "a string, c binary"), "a", "c").collect()
    assert [(r.member, r.error is None) for r in held] == [(None, False)] * 2


def test_members_against_a_manifest(spark, tmp_path):
    content = dict(FILES)
    (tmp_path / "good.zip").write_bytes(_zip([*FILES, ("extra.bin", b"1")]))
    members = archives.members(spark, str(tmp_path / "good.zip"))
    digest = {n: hashlib.sha256(c).hexdigest() for n, c in content.items()}
    named = [(n, d.upper()) for n, d in digest.items() if n != "empty"] + [("empty", digest["a.txt"]), ("gone", digest["a.txt"])]
    required = spark.createDataFrame([("a.txt",), ("order.csv",)], "member string")
    wrong = archives.against(members, spark.createDataFrame(named, "member string, sha256 string"), required)
    assert {tuple(r) for r in wrong.collect()} == {("empty", "tampered"), ("gone", "missing"), ("extra.bin", "extra"), ("order.csv", "required")}
    rows = archives.csv_rows(members, r"\.csv$", "x int, y int").orderBy("line").collect()
    assert [(r.member, r.line, r.x, r.y) for r in rows] == [("b/c.csv", 1, 1, 2), ("b/c.csv", 3, 3, None)]
    about = archives.json_rows(members, r"^meta\.json$", "board string, lots array<int>").first()
    assert (about.board, about.lots) == ("A", [1, 2])


def test_packed_archives_are_the_same_each_time(spark):
    files = spark.createDataFrame([(k % 3, f"m{k:02d}", bytearray(str(k).encode() * k)) for k in range(20)], "key int, name string, content binary")
    one, two = ({r.key: bytes(r.content) for r in archives.packed(files.repartition(n), "key", "name", "content").collect()} for n in (1, 4))
    assert one == two and set(one) == {0, 1, 2}
    back = archives.of(archives.packed(files, "key", "name", "content").withColumn("key", F.col("key").cast("string")), "key", "content")
    assert {(r.archive, r.member, bytes(r.content)) for r in back.collect()} == {(str(k % 3), f"m{k:02d}", str(k).encode() * k) for k in range(20)}
