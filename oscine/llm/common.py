"""Helpers shared by the text operators: reading tables, scratch tables, and hashing of words in Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words, blank and tab to carriage return.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names. Only a session on this machine alone may name none, since a
    cluster's executors don't share a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.gettempdir()
    path = f"{root.rstrip('/')}/oscine-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # the session has ended before
            pass

    atexit.register(remove)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and lost executors don't bring the work back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each with a number behind it where a table has one of that name (in any case) already."""
    taken = {c.lower() for c in columns}
    return [next(n for n in (w, *(f"{w}{k}" for k in range(len(columns) + 1))) if n.lower() not in taken) for w in wanted]


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, to size partitions by."""
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def parts(total: int, each: int, least: int = 12) -> int:
    """A number of partitions that grows with the input."""
    return max(least, -(-total // each))


# ---- hashing in tasks ----------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(_MULTIPLIER))
_powers: dict[object, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for key, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            table = np.full(max(n, 1 << 16), base, U64)
            table[0] = 1
            _powers[key] = np.cumprod(table, dtype=U64)
    return _powers["up"], _powers["down"]


_PRIME = U64((1 << 31) - 1)
_BASES = (1_103_515_245, 1_664_525_223)


def _prime_tables(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo the prime."""
    if len(_powers.get((base, 1), ())) < n:
        for sign in (1, -1):
            table = np.ones(1, U64)
            while len(table) < max(n, 1 << 16):
                table = np.concatenate([table, table * U64(pow(base, sign * len(table), int(_PRIME))) % _PRIME])
            _powers[base, sign] = table
    return _powers[base, 1], _powers[base, -1]


def span_pairs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, primes: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of codes[start:end] that don't depend on where the span stands, nor on each other: a polynomial modulo 2^64, and
    one or two modulo a prime, of 31 bits each. What collides for certain in the first, as long words of two letters in a
    certain order do, doesn't in the second."""
    up, down = _power_table(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, U64)
    part = codes * up[: len(codes)]
    np.cumsum(part, dtype=U64, out=sums[1:])
    size = (ends - starts).astype(U64)
    first = mix((sums[ends] - sums[starts]) * down[starts] + size)
    second, high = size << U64(1), np.empty_like(part)
    for k in range(primes):
        up, down = _prime_tables(len(codes) + 1, _BASES[k])
        if k:
            np.right_shift(codes, U64(33), out=part)
        else:
            np.bitwise_and(codes, _PRIME, out=part)
        part *= up[: len(codes)]
        np.right_shift(part, U64(31), out=high)
        part &= _PRIME
        part += high  # below 2^32, so that sums of 2^31 codes fit
        np.cumsum(part, dtype=U64, out=sums[1:])
        second = mix(second ^ ((sums[ends] - sums[starts]) % _PRIME * down[starts] % _PRIME))
    return first, second


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end], made from both hashes of the pair."""
    first, second = span_pairs(codes, starts, ends)
    return mix(first ^ second)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    if k > 6:  # differences of one running sum
        up, down = _power_table(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, U64)
        np.cumsum(codes * up[: len(codes)], dtype=U64, out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * down[:n])
    out = codes[:n].copy()
    for j in range(1, k):
        out *= U64(_MULTIPLIER)
        out += codes[j : j + n]
    return mix(out)


def byte_codes(buffer: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[buffer]


def text_slices(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column of about most bytes, a whole text at least: first row, row after the last, UTF-8 bytes, offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the buffer, and the first word of each text (one number more than texts)."""
    inside = ~_IS_SPACE[buffer]
    edge = np.zeros(len(buffer) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(buffer), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(buffer), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(byte_codes(buffer), starts, ends)


def owners(first: np.ndarray) -> np.ndarray:
    """For items whose text i holds first[i]:first[i+1], the text of each."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
