"""RHD recordings as blocks of samples. A file is a header of typed fields and equal data blocks; the blocks are read by one
record type for all of them. Fixed values, from the file format: the magic number, the fields and the conversion."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscine.sources import byteranges

MAGIC = 0xC6912702
STEP_UV, ZERO = 0.195, 32768
#: Where files are broken into pieces; any byte would do.
SEPARATOR = b"\n"
KINDS = ("amplifier", "aux", "supply", "adc", "digital_in", "digital_out")
#: Header fields before the notes, and those of a group and a channel.
FIXED, GROUP, CHANNEL = "<hhfhffffffhff", "<hhh", "<hhhhhhhhhhff"
SCHEMA = "source string, fs double, channel int, name string, block_idx long, start_idx long, uv array<double>"


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, layout: str) -> tuple:
        values = struct.unpack_from(layout, self.data, self.at)
        self.at += struct.calcsize(layout)
        return values

    def text(self) -> str:
        (size,) = self.take("<I")
        if size in (0, 0xFFFFFFFF):
            return ""
        self.at += size
        return self.data[self.at - size : self.at].decode("utf-16-le", "replace").rstrip("\0")


def header(data: bytes) -> dict:
    """fs, the enabled channels by kind, samples of a block, and where the blocks begin."""
    c = Cursor(data)
    if len(data) < 4 or c.take("<I")[0] != MAGIC:
        raise ValueError("not an RHD file")
    major, minor, fs, *_ = c.take(FIXED)
    for _ in range(3):
        c.text()
    sensors = c.take("<h")[0] if (major, minor) >= (1, 1) else 0
    if (major, minor) >= (1, 3):
        c.take("<h")  # the board's mode
    if major >= 2:
        c.text()
    found: dict[str, list[str]] = {k: [] for k in KINDS}
    for _ in range(c.take("<h")[0]):
        c.text(), c.text()
        for _ in range(c.take(GROUP)[1]):
            name, _ = c.text(), c.text()
            _, _, kind, enabled, *_ = c.take(CHANNEL)
            if enabled and 0 <= kind < len(KINDS):
                found[KINDS[kind]].append(name)
    return {"fs": float(fs), "channels": found, "samples": 128 if major >= 2 else 60, "sensors": sensors, "begin": c.at}


def block_type(h: dict) -> np.dtype:
    n, many = h["samples"], {k: len(v) for k, v in h["channels"].items()}
    fields = [("t", "<i4", (n,)), ("amplifier", "<u2", (many["amplifier"], n)), ("aux", "<u2", (many["aux"], n // 4)), ("supply", "<u2", (many["supply"],)), ("temperature", "<i2", (h["sensors"],)), ("adc", "<u2", (many["adc"], n))]
    fields += [(k, "<u2", (n if many[k] else 0,)) for k in ("digital_in", "digital_out")]
    return np.dtype(fields)


#: Bytes at the beginning of a file among which the header must be.
HEADER_BYTES = 4 << 20


def _headers(table: pa.Table) -> pa.Table:
    """What the blocks are like, from the first pieces of a file."""
    table = table.sort_by("pos")
    data = SEPARATOR.join(table.column("data").to_pylist())
    h = header(data)
    return pa.table({"source": table.column("source").slice(0, 1), "begin": [h["begin"]], "size": pa.array([block_type(h).itemsize], pa.int32()), "about": [json.dumps(h)]})


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as rows, one for each channel."""
    known: dict[str, tuple[dict, np.dtype]] = {}
    for batch in batches:
        for source, about, b, data in zip(*(batch.column(k).to_pylist() for k in ("source", "about", "block", "data")), strict=True):
            if about not in known:
                h = json.loads(about)
                known[about] = h, block_type(h)
            h, kind = known[about]
            uv = STEP_UV * (np.frombuffer(data, kind)[0]["amplifier"].astype(np.float64) - ZERO)
            names = h["channels"]["amplifier"]
            n = len(names)
            yield pa.RecordBatch.from_pydict({
                "source": [source] * n, "fs": [h["fs"]] * n, "channel": pa.array(range(n), pa.int32()), "name": pa.array(names, pa.string()), "block_idx": pa.array([b] * n, pa.int64()),
                "start_idx": pa.array([b * h["samples"]] * n, pa.int64()), "uv": pa.array(list(uv), pa.list_(pa.float64())),
            })


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each channel and block of the files. Files are read in splits of any size, and a block is put together from
    what its splits have of it; only the header, of HEADER_BYTES at most, is looked at as a whole."""
    pieces = byteranges.pieces(spark, path, SEPARATOR)
    headers = pieces.where(F.col("pos") < HEADER_BYTES).select("source", "pos", F.substring("data", 1, HEADER_BYTES).alias("data")).groupBy("source").applyInArrow(_headers, "source string, begin long, size int, about string")
    return byteranges.blocks(pieces.join(headers, "source"), "begin", "size", ["about"], SEPARATOR).mapInArrow(_parsed, SCHEMA)


def recording(spark: SparkSession, path: str) -> DataFrame:
    """source, channel, sample_idx, uv, fs of the files, a row for each sample."""
    rows = read(spark, path).select("source", "fs", "channel", "start_idx", F.posexplode("uv").alias("at", "uv"))
    return rows.select("source", "channel", (F.col("start_idx") + F.col("at")).alias("sample_idx"), "uv", "fs")
