"""Framed binary captures: records of 256 bytes, big-endian, as rows.

Fixed values, from the wire format: offsets and sizes of the fields, the sync word, and the sample rates of the codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oscine.functions import scalars as S
from oscine.operators import detection as D
from oscine.operators.windowing import islands, numbered
from oscine.sources import byteranges

SIZE, CHANNELS, MAGIC, VERSION = 256, 64, 0xA55A, 1
SYNC = MAGIC.to_bytes(2, "big")
FIELDS = {"magic": (0, 2), "version": (2, 1), "status_raw": (3, 1), "frame_id": (4, 4), "timestamp": (8, 4), "channel_count": (12, 2), "rate_code": (14, 2)}
CODES_AT, AUX_AT, DIAGNOSTICS_AT, RESERVED_AT, RESERVED_SIZE, CRC_AT = 16, 144, 150, 166, 88, 254
DIAGNOSTICS = ("fifo_fill", "drop_count", "stall_count", "spi_err_count")
DEFAULT_RATE = 20_000
RATES = {1: 20_000, 2: 30_000, 3: 25_000}

_CRC = np.arange(256, dtype=np.int64) << 8
for _ in range(8):
    _CRC = np.where(_CRC & 0x8000, (_CRC << 1) ^ 0x1021, _CRC << 1) & 0xFFFF
_CRC = _CRC.astype(np.uint16)


def crc_of(records: np.ndarray) -> np.ndarray:
    """CRC-16/CCITT of each row of a table of bytes, all rows at once."""
    crc = np.full(len(records), 0xFFFF, np.uint16)
    for column in np.ascontiguousarray(records.T):
        crc = crc << 8 ^ _CRC[crc >> 8 ^ column]
    return crc


def _bytes(column: pa.Array, size: int) -> np.ndarray:
    """A table of the bytes of values that are all of one size."""
    fixed = column.cast(pa.binary(size))
    return np.frombuffer(fixed.buffers()[1] or b"", np.uint8, len(fixed) * size, fixed.offset * size).reshape(len(fixed), size)


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which values are records by their size, and these as a table of bytes."""
    fits = pc.fill_null(pc.equal(pc.binary_length(column), SIZE), False)
    return fits.to_numpy(zero_copy_only=False), _bytes(column.filter(fits), SIZE)


def frame_crc(raw: Column) -> Column:
    """CRC of the first 254 bytes of binary records; null for records of another size."""

    def check(column: pa.Array) -> pa.Array:
        fits, records = _whole(column)
        out = np.zeros(len(column), np.int32)
        out[fits] = crc_of(records[:, :CRC_AT])
        return pa.array(out, mask=~fits)

    return F.arrow_udf(check, "int")(raw)


def codes_of(raw: Column) -> Column:
    """The signed codes of binary records; null for records of another size."""

    def split(column: pa.Array) -> pa.Array:
        fits, records = _whole(column)
        codes = np.ascontiguousarray(records[:, CODES_AT:AUX_AT]).view(">i2").astype(np.int16)
        ends = np.concatenate([[0], np.cumsum(fits * CHANNELS)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.ravel()), mask=pa.array(~fits))

    return F.arrow_udf(split, "array<short>")(raw)


def number(raw: Column, at: int, size: int) -> Column:
    """An unsigned big-endian number in a binary column."""
    return F.conv(F.hex(F.substring(raw, at + 1, size)), 16, 10).cast("long")


def decode(records: DataFrame, raw: str = "raw", strict: bool = False) -> DataFrame:
    """Adds the fields of each record. strict: only records of the right sync word, version, checksum and clean reserved bits,
    so that what follows (gaps, drops) doesn't see the others."""
    r = F.col(raw)
    df = records.where(F.length(r) == SIZE).withColumns({k: number(r, at, n) for k, (at, n) in FIELDS.items()})
    bits = S.status_bits(F.col("status_raw").cast("int"))
    df = df.withColumns(
        {
            "status": F.struct(*[v.alias(k) for k, v in bits.items() if k != "reserved_clean"]),
            "adc": codes_of(r),
            "aux": F.array(*[number(r, AUX_AT + 2 * c, 2).cast("int") for c in range(3)]),
            "diag": F.struct(*[number(r, DIAGNOSTICS_AT + 4 * i, 4).alias(n) for i, n in enumerate(DIAGNOSTICS)]),
            "crc_received": number(r, CRC_AT, 2).cast("int"), "crc_computed": frame_crc(r),
            "reserved_clean": bits["reserved_clean"] & (F.hex(F.substring(r, RESERVED_AT + 1, RESERVED_SIZE)) == "00" * RESERVED_SIZE),
            "sample_rate": F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in RATES.items() for x in p]), F.col("rate_code").cast("int")), F.lit(0)),
        }
    ).withColumn("crc_valid", F.col("crc_received") == F.col("crc_computed"))
    if strict:
        return df.where((F.col("magic") == MAGIC) & (F.col("version") == VERSION) & F.col("crc_valid") & F.col("reserved_clean"))
    return df


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from sync words that stand close together, in order within each island: one begins a record if it comes a whole
    record after the one that began the last, and what stands between belongs to that."""
    source = begin = None
    held, out = b"", []
    for batch in batches:
        for of, at, first, data in zip(*(batch.column(k).to_pylist() for k in ("source", "at", "begins", "data")), strict=True):
            if first or of != source or at - begin >= SIZE:
                source, begin, held = of, at, b""
            elif at - begin != len(held):
                continue  # the record is whole
            held += SYNC + data[:SIZE]
            if len(held) >= SIZE:
                out.append((source, begin, held[:SIZE]))
                held = held[:SIZE]
        if out:
            yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["source", "pos", "raw"])
            out = []


def read(spark: SparkSession, path: str, aligned: bool = False) -> DataFrame:
    """source, pos, raw of the records of capture files of any size: from sync word to sync word where bytes are out of step. A
    file is read in splits, each of which finds its own sync words. A sync word with a record's room before and behind it begins one;
    only those that stand closer are sorted, and settled in order. aligned: files are whole records from the first byte, and are
    cut by Spark's own functions, a file at a time."""
    if aligned:
        files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), "content")
        starts = F.sequence(F.lit(0), F.length("content") - SIZE, F.lit(SIZE))
        cut = files.where(F.length("content") >= SIZE).select("source", "content", F.explode(starts).alias("pos"))
        return cut.select("source", F.col("pos").cast("long"), F.expr(f"substring(content, pos + 1, {SIZE})").alias("raw"))
    found = byteranges.pieces(spark, path, SYNC).where("pos > 0")  # the first piece of a file has no sync word before it
    rest = SIZE - len(SYNC)
    # the first sync word has no other before it, wherever it stands
    alone = (F.col("before").isNull() | (F.col("before") >= rest) | (F.col("before") + len(SYNC) == F.col("pos"))) & (F.length("data") >= rest)
    easy = found.where(alone).select("source", (F.col("pos") - len(SYNC)).alias("pos"), F.concat(F.lit(bytearray(SYNC)), F.substring("data", 1, rest)).alias("raw"))
    close = found.where(~alone).select("source", (F.col("pos") - len(SYNC)).alias("at"), "data").withColumn("block", F.floor(F.col("at") / (SIZE << 12)))
    grouped = islands(close, ["source"], "at", SIZE, "block").select("source", "at", "begins", "island", "data")
    hard = grouped.repartition("source", "island").sortWithinPartitions("source", "island", "at").mapInArrow(_assembled, "source string, pos long, raw binary")
    return easy.union(hard)


def build(rows: DataFrame, frame_id: str = "frame_id", timestamp: str = "timestamp", adc: str = "adc", status: int = 0) -> DataFrame:
    """Adds raw: well-formed records from frame numbers, timestamps and arrays of codes."""

    def field(value: Column, digits: int) -> Column:
        return F.lpad(F.hex(value.cast("long")), digits, "0")

    def joined(head: pa.Array, codes: pa.Array) -> pa.Array:
        there, flat = np.asarray(codes.is_valid()), codes.flatten()
        known = np.asarray(flat.is_valid())
        row = np.repeat(np.arange(len(codes)), pc.list_value_length(codes).fill_null(0).to_numpy())[known]
        n = np.bincount(row, minlength=len(codes))
        place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        values = flat.drop_null().to_numpy()[place < CHANNELS] & 0xFFFF
        grid = np.zeros((len(codes), CHANNELS), ">u2")
        grid[row[place < CHANNELS], place[place < CHANNELS]] = values
        out = np.zeros((len(codes), SIZE), np.uint8)
        out[:, :CODES_AT] = _bytes(head.fill_null(bytes(CODES_AT)), CODES_AT)
        out[:, CODES_AT:AUX_AT] = grid.view(np.uint8)
        out[:, CRC_AT:] = crc_of(out[:, :CRC_AT]).astype(">u2")[:, None].view(np.uint8)
        records = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SIZE), len(out), [None, pa.py_buffer(out)]).cast(pa.binary())
        return pc.if_else(pa.array(there & np.asarray(head.is_valid())), records, None)

    head = F.concat(F.lit(f"{MAGIC:04X}{VERSION:02X}{status:02X}"), field(F.col(frame_id), 8), field(F.col(timestamp), 8), field(F.lit(CHANNELS), 4), F.lit("0001"))
    record = F.arrow_udf(joined, "binary").asNondeterministic()  # so that a filter or a check behind it doesn't build it again
    return rows.withColumn("raw", record(F.unhex(head), F.col(adc).cast("array<long>")))


def cut(content: bytes) -> tuple[list[bytes], bytes]:
    """The records of a piece of a capture, from sync word to sync word, and the bytes at its end that the next piece may
    complete."""
    out, at = [], content.find(MAGIC.to_bytes(2, "big"))
    while 0 <= at <= len(content) - SIZE:
        out.append(content[at : at + SIZE])
        at = content.find(MAGIC.to_bytes(2, "big"), at + SIZE)
    done = at if at >= 0 else len(content) - content.endswith(MAGIC.to_bytes(2, "big")[:1])
    return out, content[done:]


def from_chunks(chunks: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """key, n, raw of the records of captures that come in pieces of any size; each capture's pieces are joined in order, and a
    record may begin in one and end in another."""

    def join(group: tuple, table: pa.Table) -> pa.Table:
        rest, records = b"", []
        for piece in table.sort_by(order).column(data).to_pylist():
            found, rest = cut(rest + (piece or b""))
            records += found
        return pa.table({key: pa.array([group[0].as_py()] * len(records), group[0].type), "n": pa.array(range(len(records)), pa.int64()), "raw": pa.array(records, pa.binary())})

    schema = chunks.select(key).schema.add("n", "long").add("raw", "binary")
    return chunks.select(key, order, data).groupBy(key).applyInArrow(join, schema)


def recording(decoded: DataFrame, source: str = "source", position: str = "pos") -> DataFrame:
    """source, channel, sample_idx, uv, fs of the frames of captures: a frame is a sample of each channel, and a rate code that
    isn't known counts as 20 kHz. Captures without a frame are an error."""
    if decoded.isEmpty():
        raise ValueError("no frame found")
    fs = F.when(F.col("sample_rate") > 0, F.col("sample_rate")).otherwise(DEFAULT_RATE)
    placed = numbered(decoded.withColumn("__block", F.floor(F.col(position) / (SIZE << 12))), [source], "__block", [position], "sample_idx")
    return samples(placed.withColumn("fs", fs), [source, "sample_idx", "fs"]).select(source, "channel", "sample_idx", "uv", "fs")


def capture_report(decoded: DataFrame, source: str = "source", position: str = "pos") -> DataFrame:
    """Counts of each capture: frames, bad ones, numbers that are missing among the good, times that run backward, first and
    last number and time, share dropped and bytes a second of the capture's own clock (ticks of a sample)."""
    rows = decoded.withColumn("__block", F.floor(F.col(position) / (SIZE << 12)))
    good = rows.where("crc_valid")
    dropped = D.gaps(good, [source], [position], "frame_id", "__block").groupBy(source).agg(F.sum("dropped").alias("dropped"))
    back = D.backward_steps(good, [source], [position], "timestamp", "__block").groupBy(source).agg(F.count_if("violation").alias("time_violations"))
    counts = rows.groupBy(source).agg(
        F.count("*").alias("frames"), F.count_if(~F.col("crc_valid")).alias("bad"), F.min_by("frame_id", F.when(F.col("crc_valid"), F.col(position))).alias("first_id"),
        F.max_by("frame_id", F.when(F.col("crc_valid"), F.col(position))).alias("last_id"), F.min_by("timestamp", F.when(F.col("crc_valid"), F.col(position))).alias("first_time"),
        F.max_by("timestamp", F.when(F.col("crc_valid"), F.col(position))).alias("last_time"), F.max("sample_rate").alias("fs"),
    )
    both = counts.join(dropped, source, "left").join(back, source, "left").fillna(0, ["dropped", "time_violations"])
    seconds = F.pmod(F.col("last_time") - F.col("first_time"), F.lit(1 << 32)) / F.nullif("fs", F.lit(0))
    return both.withColumns({"drop_rate": F.try_divide(F.col("dropped"), F.col("dropped") + F.col("frames") - F.col("bad")), "bytes_per_s": F.when(seconds > 0, F.col("frames") * SIZE / seconds).otherwise(0.0)})


def samples(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """Long samples: channel and uv of each code."""
    return decoded.select(*keys, F.posexplode("adc").alias("channel", "code")).withColumn("uv", S.adc_to_uv(F.col("code").cast("double")))
