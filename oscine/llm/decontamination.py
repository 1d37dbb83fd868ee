"""Benchmark decontamination (operator 9): spaced seeds. Fixed masks over consecutive tokens leave some positions out, so that
a hit survives changed tokens there. Hashes of the benchmark's masked windows are joined with those of the documents; each hit
is verified along its diagonal, where some tokens may differ.

Tokens: runs of characters other than white space and ASCII punctuation, ASCII letters in lower case. A document overlaps an
item if, aligned at a hit, VERIFY consecutive tokens (all of the item, if it is shorter) differ in at most a fifth; items of
one to four tokens must thus be found as they are, and an item of one token is found wherever it stands (least_tokens leaves
out such items, if wanted). The masks hit every overlap that verification accepts. Null or empty texts overlap nothing; equal
texts overlap the same. Documents are read whole. An empty benchmark or table gives no overlaps. Extra columns stay as they
are; the column added has the name that the caller gives.

What the seeds may be is broadcast as a bitmap of bounded size, so that a document's windows that are no seed never leave
their task; a hit goes on with its stretch of the document. No benchmark is collected, whatever its size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscine.llm import common as C

#: Fixed masks: 1 counts, 0 is left out. Of VERIFY tokens, however the tolerated ones are placed, one mask at least is hit.
MASKS = ("1111111", "1101100111", "1110011011", "1010111011", "111101011")
#: The same for items of fewer tokens, by their number.
SHORT_MASKS = {
    1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",),
    5: ("1111", "11101", "11011", "10111"), 6: ("1111", "11011"), 7: ("11111", "111011", "110111"), 8: ("111011", "11111"), 9: ("1111011", "1101111"),
    10: ("1111011", "11001111", "110110011", "11110101", "10101111"), 11: ("1110111", "111001011", "1011111", "111111"), 12: ("11101011", "101100111", "111111"),
}
LEAST_TOKENS = 1
VERIFY, TOLERATED = 13, 0.2
#: Bits of the bitmap: so many for a seed, but not more in all; how many of them a seed sets.
BITS_EACH, MOST_BITS, PROBES = 64, 1 << 27, 4
#: Tokens of an item that are sent together, with what may be needed on either side.
CHUNK, AROUND = 1024, VERIFY - 1

_APART = np.zeros(256, bool)
_APART[list(C.SPACE_BYTES)] = True
_APART[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of the texts, and the first token of each text."""
    starts, ends, first = C.words(np.where(_APART[buffer], np.uint8(32), _LOWER[buffer]), offsets)
    return C.word_hashes(_LOWER[buffer], starts, ends), first


def _masked(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hashes of the windows of a mask that start at each token."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, C.U64)
    out = np.full(n, int(mask, 2) * 2654435761 % (1 << 64), C.U64)
    for j, x in enumerate(mask):
        if x == "1":
            out = out * C.U64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return C.mix(out)


def _masks(sizes: list[int]) -> list[str]:
    """The masks for items of the given sizes, which count as VERIFY at most."""
    return list(dict.fromkeys(mask for n in sizes for mask in SHORT_MASKS.get(n, MASKS)))


_SEEDS = "item long, id long, size int, begin int, tokens binary, seeds array<long>, places array<int>"


def _seeded(least_tokens: int):
    """Rows row, id, text of items to their chunks of tokens, with the masked windows that begin in each."""

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for lo, hi, buffer, offsets in C.text_slices(batch.column(2), 1 << 20):
                hashes, first = tokens(buffer, offsets)
                for k in range(lo, hi):
                    own = hashes[first[k - lo] : first[k - lo + 1]]
                    n = min(len(own), VERIFY)
                    if len(own) < max(1, least_tokens):
                        continue
                    found = [_masked(own, mask) for mask in SHORT_MASKS.get(n, MASKS)]
                    for at in range(0, len(own), CHUNK):
                        begin = max(0, at - AROUND)
                        part = [x[at : at + CHUNK] for x in found]
                        places = np.concatenate([at + np.arange(len(x)) for x in part])
                        chunk = own[begin : at + CHUNK + AROUND + len(MASKS[1])].tobytes()
                        rows.append((batch.column(0)[k].as_py() + at, batch.column(1)[k].as_py(), len(own), begin, chunk, np.concatenate(part).view(np.int64), places.astype(np.int32)))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            names = [x.split()[0] for x in _SEEDS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return seeded


def _slot(seeds: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return (C.mix(seeds + C.U64(probe)) if probe else seeds) & C.U64(bits - 1)


def _set(bits: int):
    """Rows seeds to the words of the bitmap that they set bits in."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column(0).flatten().to_numpy().view(C.U64)
            slots = np.unique(np.concatenate([_slot(seeds, probe, bits) for probe in range(PROBES)]))
            word, which = np.unique(slots >> C.U64(6), return_inverse=True)
            value = np.zeros(len(word), C.U64)
            np.bitwise_or.at(value, which, C.U64(1) << (slots & C.U64(63)))
            yield pa.RecordBatch.from_pydict({"word": pa.array(word.view(np.int64)), "bits": pa.array(value.view(np.int64))})

    return words


def _is_set(bitmap: np.ndarray, seeds: np.ndarray, probe: int) -> np.ndarray:
    slot = _slot(seeds, probe, len(bitmap) * 64)
    return bitmap[slot >> C.U64(6)] >> (slot & C.U64(63)) & C.U64(1) > 0


_HITS = "own long, own2 long, begin int, tokens binary, seeds array<long>, places array<int>"


def _hit(shared, masks: list[str]):
    """Rows own, own2, text of documents to their stretches that hits stand in, with what is needed around them."""

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for lo, _, buffer, offsets in C.text_slices(batch.column(2)):
                hashes, first = tokens(buffer, offsets)
                owner, at, until, seeds = C.owners(first), [], [], []
                for mask in masks:
                    found = _masked(hashes, mask)
                    some = np.flatnonzero(_is_set(bits, found, 0))
                    for probe in range(1, PROBES):
                        some = some[_is_set(bits, found[some], probe)]
                    some = some[owner[some] == owner[some + len(mask) - 1]]
                    at.append(some)
                    until.append(some + len(mask))
                    seeds.append(found[some])
                at, until, seeds = map(np.concatenate, (at, until, seeds))
                order = np.argsort(at, kind="stable")
                at, until, seeds = at[order], until[order], seeds[order]
                text = owner[at]
                lows, highs = np.maximum(at - AROUND, first[text]), np.minimum(until + AROUND, first[text + 1])
                reach = np.maximum.accumulate(highs) if len(highs) else highs
                new = np.ones(len(at), bool)
                new[1:] = (text[1:] != text[:-1]) | (lows[1:] > reach[:-1])
                edges = np.append(np.flatnonzero(new), len(at))
                rows = [(lo + int(text[a]), int(lows[a]), int(reach[b - 1]), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                which = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(which), batch.column(1).take(which), pa.array([r[1] - int(first[r[0] - lo]) for r in rows], pa.int32()),
                    pa.array([hashes[r[1] : r[2]].tobytes() for r in rows], pa.binary()), pa.array([seeds[a:b].view(np.int64) for *_, a, b in rows], pa.list_(pa.int64())),
                    pa.array([(at[a:b] - first[r - lo]).astype(np.int32) for r, _, _, a, b in rows], pa.list_(pa.int32())),
                ], [x.split()[0] for x in _HITS.split(", ")])

    return hit


def _overlaps(own: np.ndarray, own_begin: int, item: np.ndarray, item_begin: int, size: int, diagonal: int) -> bool:
    """Whether tokens of a text and of an item agree along a diagonal: place in the text less place in the item."""
    lo = max(own_begin, item_begin + diagonal)
    hi = min(own_begin + len(own), item_begin + diagonal + len(item))
    window = min(VERIFY, size)
    if hi - lo < window:
        return False
    same = own[lo - own_begin : hi - own_begin] == item[lo - diagonal - item_begin : hi - diagonal - item_begin]
    sums = np.concatenate([[0], np.cumsum(same)])
    return bool((sums[window:] - sums[:-window]).max() >= window - int(TOLERATED * window))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        begins, item_begins, sizes, diagonals = (batch.column(k).to_pylist() for k in ("begin", "item_begin", "size", "diagonal"))
        texts, items = (map(lambda x: np.frombuffer(x.as_buffer(), C.U64), batch.column(k)) for k in ("tokens", "item_tokens"))
        good = pa.array([_overlaps(*x) for x in zip(texts, begins, items, item_begins, sizes, diagonals, strict=True)], pa.bool_())
        yield batch.select(["own", "own2", "id"]).filter(good)


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """own, own2 (two hashes of a text) and items, the ids of the items that it overlaps, in order, of each text that has any."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("t")).where("id is not null and t is not null").distinct()
    items = items.select(F.xxhash64("id", "t").alias("row"), "id", "t")
    chunks = C.materialize(items.mapInArrow(_seeded(least_tokens), _SEEDS), "benchmark-seeds")
    masks = _masks(sorted(r[0] for r in chunks.select(F.least("size", F.lit(VERIFY))).distinct().collect())) or list(MASKS[:1])
    n = chunks.agg(F.sum(F.size("seeds"))).first()[0] or 0
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * n).bit_length()))
    seeds = chunks.select("item", F.explode(F.arrays_zip("seeds", "places")).alias("x")).select("item", F.col("x.seeds").alias("seed"), F.col("x.places").alias("item_place"))
    words = chunks.select("seeds").mapInArrow(_set(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(bits // 64, C.U64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(C.U64)
    shared = spark.sparkContext.broadcast(bitmap)

    keyed = docs.select(F.xxhash64(text).alias("own"), F.xxhash64(F.lit("again"), text).alias("own2"), F.col(text).alias("text"))
    hits = C.materialize(keyed.mapInArrow(_hit(shared, masks), _HITS).dropDuplicates(["own", "own2", "begin"]), "seed-hits")
    met = hits.select("own", "own2", "begin", F.explode(F.arrays_zip("seeds", "places")).alias("x"))
    met = met.select("own", "own2", "begin", F.col("x.seeds").alias("seed"), F.col("x.places").alias("place")).join(seeds, "seed")
    met = met.select("own", "own2", "begin", "item", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct()
    stretches = hits.select("own", "own2", "begin", "tokens")
    chunks = chunks.select("item", "id", "size", F.col("begin").alias("item_begin"), F.col("tokens").alias("item_tokens"))
    checked = met.join(stretches, ["own", "own2", "begin"]).join(chunks, "item").mapInArrow(_verified, "own long, own2 long, id long")
    return C.materialize(checked.groupBy("own", "own2").agg(F.array_sort(F.collect_set("id")).alias("items")), "overlaps")


def with_overlaps(docs: DataFrame, benchmark: DataFrame, column: str, text: str = "text", item_id: str = "item_id", item_text: str = "text", least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """Adds a column with the ids of the benchmark items that each row's text overlaps, in order. The texts that overlap
    something are few; where they fit Spark's limit for a broadcast join, the documents aren't shuffled."""
    own, again, ids = C.free_names(docs.columns, "__own", "__own2", "__items")
    found = overlaps(docs, benchmark, text, item_id, item_text, least_tokens).select(F.col("own").alias(own), F.col("own2").alias(again), F.col("items").alias(ids))
    keys = (F.xxhash64(F.col(f"`{text}`")) == F.col(own)) & (F.xxhash64(F.lit("again"), F.col(f"`{text}`")) == F.col(again))
    items = F.coalesce(ids, F.array().cast("array<long>")).alias(column)
    return docs.join(found, keys, "left").select(*[F.col(f"`{c}`") for c in docs.columns if c != column], items)
