"""The frame that both exact dedups over long repeats share: it brings the places that can hold equal windows together.

A window is length units (bytes or words) of one text. Of the grams of k units in a window the one of least hash is its
anchor; equal windows have equal anchors, so that the windows of an anchor can be compared apart from all others. The windows
in a row that share an anchor form a segment. The steps:

1. Texts are dealt to batches by hash. Each batch counts its anchors and sends them to buckets, packed, one count for each.
2. Buckets give back to each batch which of its anchors occur again anywhere.
3. Batches send each distinct segment of those anchors, once, with the place of its first occurrence, to shards by anchor.
   For an anchor that is very frequent, single windows go instead, by a hash of the window, so that no shard gets them all.
4. Shards find which windows are equal (by the method of the operator) and where each occurs first, and tell each batch in
   which of its segments which windows occur earlier.
5. Batches mark the units of those windows.

All of it is one plan; the texts are shuffled once and that shuffle is read three times. What goes to a bucket or a shard is
summed up within each batch first. Anchors only route; a false meeting of two of them costs time and changes nothing. Whole
segments of an anchor that are equal are told by the anchor's hash and one of the segment, and single windows of a frequent
anchor by two hashes, one modulo 2^64 and one modulo a prime (common.span_pairs), so that copies are settled before the index;
the index decides between different segments."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscine.llm import common as C

BATCH_BYTES, BUCKET_BYTES, SHARD_BYTES, SLICE_BYTES = 4 << 20, 24 << 20, 6 << 20, 1 << 20
#: Bytes of all texts up to which batches and shards have these sizes, and how many times as large they become at most.
GROWS_FROM, GROWS_TO = 1 << 30, 4
FREQUENT = 4096
CHUNK_UNITS = 1 << 17
_STEP, _PLACE = 1 << 21, C.U64((1 << 22) - 1)
_LOW16 = C.U64(0xFFFF)
_RUN = np.dtype([("h", "u8"), ("c", "u8"), ("lo", "i4"), ("hi", "i4")])


@dataclass(frozen=True)
class Rule:
    """What the two operators differ in. in_order: an occurrence earlier in the same document counts too."""

    length: int
    words: bool
    in_order: bool
    classes: Callable[[np.ndarray, np.ndarray, int], np.ndarray]
    k: int

    def units(self, buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.words:
            return C.byte_codes(buffer), offsets
        starts, ends, first = C.words(buffer, offsets)
        return C.word_hashes(buffer, starts, ends), first


def gram_units(total: int, length: int, bits_each: float, least: int) -> int:
    """Units of a gram that rarely occurs twice by chance in so many units."""
    return int(min(length // 2 + 1, max(least, math.ceil((math.log2(max(total, 2)) + 7) / bits_each))))


def parts(total: int) -> tuple[int, int, int]:
    """Numbers of batches, buckets and shards. Each batch sends a packet to each shard: both grow with the root of the input, so that
    packets don't become smaller and more for each byte as long as memory allows it."""
    times = min(GROWS_TO, max(1.0, math.sqrt(total / GROWS_FROM)))
    return C.parts(total, int(BATCH_BYTES * times)), C.parts(total, BUCKET_BYTES), C.parts(total, int(SHARD_BYTES * times))


def _least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of every width keys in a row."""
    have, out = 1, keys
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def segments(codes: np.ndarray, first: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each segment."""
    n, out = len(codes) - length + 1, []
    for lo in range(0, max(n, 0), _STEP):
        hi = min(n, lo + _STEP)
        grams = C.gram_hashes(codes[lo : hi + length - 1], k)
        keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=C.U64)
        least = _least_of(keys, length - k + 1)
        least &= _PLACE
        ends = first[(first > lo) & (first < hi + length - 1)]
        whole = np.ones(hi - lo, bool)  # windows that no text ends in
        from_ = np.maximum(ends - length + 1, lo)
        whole[_spread(from_ - lo, np.minimum(ends, hi) - from_)] = False
        edge = np.ones(hi - lo, bool)
        edge[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
        begin = np.flatnonzero(edge)
        count = np.diff(np.append(begin, hi - lo))
        begin, count = begin[whole[begin]], count[whole[begin]]
        # the least of many hashes are small numbers; spread anew, they deal out evenly
        out.append((lo + begin, count, C.mix(grams[least[begin].astype(np.int64)] + C.U64(1))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, C.U64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class Found:
    """Segments of a batch: text and unit in it at which each begins, windows, anchor and content hashes, and the place in
    source, which is all units of the batch."""

    text: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    h: np.ndarray
    c: np.ndarray
    at: np.ndarray
    source: np.ndarray

    def pick(self, at: np.ndarray) -> Found:
        return Found(self.text[at], self.start[at], self.windows[at], self.h[at], self.c[at], self.at[at], self.source)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each, count numbers."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def find(rule: Rule, column: pa.ChunkedArray, frequent: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray] | None = None, contents: bool = True) -> Found:
    """The segments of a batch's texts; of frequent anchors (upper 48 bits, in order), the single windows. wanted: which to
    keep, by the upper 48 bits of the anchors that aren't frequent. contents: else c stays 0, which takes less; then no anchor
    may be frequent."""
    out, before = [], 0
    for lo, _, buffer, offsets in C.text_slices(column, SLICE_BYTES):
        codes, first = rule.units(buffer, offsets)
        start, windows, h = segments(codes, first, rule.length, rule.k)
        often = _in(h >> C.U64(16), frequent)
        keep = ~often if wanted is None else ~often & wanted(h >> C.U64(16))
        single = _spread(start[often], windows[often])
        start, windows = np.concatenate([start[keep], single]), np.concatenate([windows[keep], np.ones(len(single), np.int64)])
        end = start + windows + rule.length - 1
        h, c = h[keep], np.zeros(len(start), C.U64)
        if contents:
            other, c = C.span_pairs(codes, start, end, 1)
            c ^= other  # equal if both are
            h = np.concatenate([h, C.mix(other[len(c) - len(single) :])])
        owner = np.searchsorted(first, start, "right") - 1
        source = codes if rule.words else buffer
        out.append(Found(owner + lo, start - first[owner], windows, h, c, start + before, source))
        before += len(source)
    if not out:
        empty = np.zeros(0, np.int64)
        return Found(empty, empty, empty, empty.view(C.U64), empty.view(C.U64), empty, np.zeros(0, np.uint8))
    return Found(*[np.concatenate([getattr(x, k) for x in out]) for k in ("text", "start", "windows", "h", "c", "at", "source")])


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _group(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, the first of them first, and which of it begin a new pair of the first two."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    a, b = keys[0][order], keys[1][order]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def _part(h48: np.ndarray, n: int) -> np.ndarray:
    """Numbers below n that rise with the 48 bits."""
    return ((h48 >> C.U64(16)) * C.U64(n) >> C.U64(32)).astype(np.int64)


def _arrays(column: pa.ChunkedArray, dtype: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("place").to_numpy()


def _count(rule: Rule, buckets: int):
    def count(key: tuple, table: pa.Table) -> pa.Table:
        found = find(rule, table.column("text"), np.zeros(0, C.U64), contents=False)
        h48 = found.h >> C.U64(16)
        if rule.in_order:
            ids, times = np.unique(h48, return_counts=True)
        else:  # texts, not occurrences
            order, new = _group(h48, _ids(table)[found.text].view(C.U64))
            ids, times = np.unique(h48[order[new]], return_counts=True)
        packed = ids << C.U64(16) | np.minimum(times, 0xFFFF).astype(C.U64)
        part = _part(ids, buckets)
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        blobs = [x.tobytes() for x in np.split(packed, edges[1:])] if len(ids) else []
        return pa.table({"bucket": pa.array(part[edges], pa.int32()), "batch": pa.array([key[0].as_py()] * len(edges), pa.int32()), "data": pa.array(blobs, pa.binary())})

    return count


def _again(table: pa.Table) -> pa.Table:
    parts = _arrays(table.column("data"), np.uint64)
    packed = np.concatenate(parts)
    h48, times = packed >> C.U64(16), (packed & _LOW16).astype(np.int64)
    ids, which = np.unique(h48, return_inverse=True)
    total = np.bincount(which, times, len(ids))[which]
    flagged = h48 << C.U64(16) | (total >= FREQUENT).astype(C.U64)
    ends = np.cumsum([len(x) for x in parts])
    kept = [x[t > 1].tobytes() for x, t in zip(np.split(flagged, ends[:-1]), np.split(total, ends[:-1]), strict=True)]
    some = [i for i, x in enumerate(kept) if x]
    return pa.table({"batch": table.column("batch").take(pa.array(some, pa.int64())), "data": pa.array([kept[i] for i in some], pa.binary())})


_SENT = "shard int, batch int, h binary, place binary, start binary, windows binary, data binary, frequent binary"


def _pack(values: np.ndarray) -> bytes:
    """Bytes of an array, compressed, after its size; an array of numbers that rise slowly is given by its steps."""
    if values.dtype == np.int64:
        values = np.diff(values, prepend=0)
    data = np.ascontiguousarray(values).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(blob: pa.Scalar, dtype: type) -> np.ndarray:
    data = blob.as_py()
    values = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), dtype)
    return np.cumsum(values, dtype=np.int64) if dtype is np.int64 else values


def _send(rule: Rule, shards: int):
    def send(key: tuple, table: pa.Table, again: pa.Table) -> pa.Table:
        known = np.sort(np.concatenate([np.zeros(0, C.U64), *_arrays(again.column("data"), np.uint64)]))
        often = (known & C.U64(1)) > 0
        frequent, known = known[often] >> C.U64(16), known[~often] >> C.U64(16)
        names = [x.split()[0] for x in _SENT.split(", ")]
        rows: dict[str, list] = {k: [] for k in names}
        if len(known) or len(frequent):
            found = find(rule, table.column("text"), frequent, lambda h48: _in(h48, known))
            place = _ids(table)[found.text]
            order, new = _group(found.h, found.c, place, found.start)
            found, place = found.pick(order[new]), place[order[new]]
            part = _part(found.h >> C.U64(16), shards)
            order = np.lexsort((found.start, place, part))  # by place within a shard, which packs well
            found, place, part = found.pick(order), place[order], part[order]
            edges = np.flatnonzero(np.diff(part, prepend=-1))
            for lo, hi in zip(edges, [*edges[1:], len(part)], strict=True):
                for k, v in (("h", found.h), ("place", place), ("start", found.start), ("windows", found.windows.astype(np.int32))):
                    rows[k].append(_pack(v[lo:hi]))
                rows["shard"].append(int(part[lo]))
                rows["batch"].append(key[0].as_py())
                rows["data"].append(_pack(found.source[_spread(found.at[lo:hi], found.windows[lo:hi] + rule.length - 1)]))
                rows["frequent"].append(frequent.tobytes() if not lo else b"")
        return pa.table({k: pa.array(v, pa.int32() if k in ("shard", "batch") else pa.binary()) for k, v in rows.items()})

    return send


def _judge(rule: Rule):
    def judge(table: pa.Table) -> pa.Table:
        h, place, start, windows, parts = ([_unpack(x, t) for x in table.column(k)] for k, t in (("h", np.uint64), ("place", np.int64), ("start", np.int64), ("windows", np.int32), ("data", np.uint64 if rule.words else np.uint8)))
        counts = np.array([len(x) for x in h])
        c = []
        for own, part in zip(windows, parts, strict=True):
            own_ends = np.cumsum(own.astype(np.int64) + rule.length - 1)
            c.append(np.bitwise_xor(*C.span_pairs(part if rule.words else C.byte_codes(part), own_ends - own - rule.length + 1, own_ends, 1)))
        h, c, place, start, windows, units = map(np.concatenate, (h, c, place, start, windows, parts))
        ends = np.cumsum(windows.astype(np.int64) + rule.length - 1)
        begins = ends - windows - rule.length + 1
        order, new = _group(h, c, place, start)
        first = order[new]  # one of each distinct segment, the earliest
        edges = np.append(np.flatnonzero(new), len(order))
        row = np.repeat(np.arange(len(counts)), counts)
        # windows of one segment differ, as the anchor stands elsewhere in each: an anchor with one distinct segment needs no index
        apart = h[first[1:]] != h[first[:-1]]
        alone = np.append(True, apart) & np.append(apart, True)
        rep, mine = np.repeat(first, np.diff(edges)), order
        earlier = place[rep] < place[mine]
        if rule.in_order:
            earlier |= (place[rep] == place[mine]) & (start[rep] < start[mine])
        whole = mine[earlier & np.repeat(alone, np.diff(edges))]
        told = [(whole, np.zeros(len(whole), np.int64), windows[whole].astype(np.int64))]
        mixed = np.flatnonzero(~alone)
        sizes, lo = np.cumsum(windows[first[mixed]].astype(np.int64) + rule.length), 0
        while lo < len(mixed):
            # whole anchors, up to a bounded number of units
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CHUNK_UNITS)))
            while hi < len(mixed) and h[first[mixed[hi]]] == h[first[mixed[hi - 1]]]:
                hi += 1
            own, lo = mixed[lo:hi], hi
            at = first[own]
            many = windows[at].astype(np.int64)
            length = many + rule.length - 1
            codes = units[_spread(begins[at], length)]
            offsets = np.concatenate([[0], np.cumsum(length)])
            label = rule.classes(codes, offsets, rule.length)  # of each window, in the order of the segments
            owner, inner = np.repeat(np.arange(len(at)), many), _spread(np.zeros(len(at), np.int64), many)
            w_place, w_start = place[at][owner], start[at][owner] + inner
            rank = np.lexsort((w_start, w_place, label))
            head = np.ones(len(rank), bool)
            head[1:] = label[rank][1:] != label[rank][:-1]
            earliest = np.empty(len(rank), np.int64)
            earliest[rank] = rank[head][np.cumsum(head) - 1]
            best_place, best_start = w_place[earliest], w_start[earliest]
            # each batch's copy of a segment against the earliest place of each window
            copies = order[_spread(edges[own], edges[own + 1] - edges[own])]
            which = np.repeat(np.arange(len(own)), edges[own + 1] - edges[own])
            count = many[which]
            w = _spread(offsets[which] - which * (rule.length - 1), count)
            copy = np.repeat(np.arange(len(copies)), count)
            inner = _spread(np.zeros(len(copies), np.int64), count)
            mine = place[copies][copy]
            earlier = best_place[w] < mine
            if rule.in_order:
                earlier |= (best_place[w] == mine) & (best_start[w] < start[copies][copy] + inner)
            hit = np.flatnonzero(earlier)
            fresh = np.ones(len(hit), bool)
            fresh[1:] = (copy[hit][1:] != copy[hit][:-1]) | (inner[hit][1:] != inner[hit][:-1] + 1)
            begin = np.flatnonzero(fresh)
            low = inner[hit[begin]]
            told.append((copies[copy[hit[begin]]], low, low + np.diff(np.append(begin, len(hit)))))
        source, low, high = map(np.concatenate, zip(*told, strict=True))
        by_row = np.argsort(row[source], kind="stable")
        source = source[by_row]
        runs = np.empty(len(source), _RUN)
        runs["h"], runs["c"], runs["lo"], runs["hi"] = h[source], c[source], low[by_row], high[by_row]
        data = [x.tobytes() for x in np.split(runs, np.searchsorted(row[source], np.arange(1, len(counts))))]
        return pa.table({"batch": table.column("batch"), "data": pa.array(data, pa.binary()), "frequent": table.column("frequent")})

    return judge


def covered_units(rule: Rule, table: pa.Table, runs: np.ndarray, frequent: np.ndarray) -> list[np.ndarray]:
    """For each text of a batch, the first and last units (one after) of the windows that occur earlier."""
    found = find(rule, table.column("text"), frequent)
    place = _ids(table)[found.text]
    order, new = _group(found.h, found.c, place, found.start)
    first = order[new]
    which = np.cumsum(new) - 1
    mine, rep = order, first[which]
    later = place[rep] < place[mine]
    if rule.in_order:
        later |= (place[rep] == place[mine]) & (found.start[rep] < found.start[mine])
    whole = mine[later]
    spans = [(found.text[whole], found.start[whole], found.start[whole] + found.windows[whole] + rule.length - 1)]
    if len(runs):
        runs = runs[np.lexsort((runs["c"], runs["h"]))]
        # runs and distinct segments are both in order; all occurrences of a run's segment get it
        pair = np.dtype([("h", "u8"), ("c", "u8")])
        keys = np.empty(len(first), pair)
        keys["h"], keys["c"] = found.h[first], found.c[first]
        at = _match(keys, runs)
        edges = np.append(np.flatnonzero(new), len(order))
        count = edges[at + 1] - edges[at]
        occurrence = order[_spread(edges[at], count)]
        lo, hi = np.repeat(runs["lo"], count), np.repeat(runs["hi"], count)
        spans.append((found.text[occurrence], found.start[occurrence] + lo, found.start[occurrence] + hi + rule.length - 1))
    text, lo, hi = (np.concatenate(x) for x in zip(*spans, strict=True))
    by_text = np.argsort(text, kind="stable")
    edges = np.searchsorted(text[by_text], np.arange(table.num_rows + 1))
    both = np.stack([lo, hi], 1)[by_text]
    return [both[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _match(keys: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The place in keys (in order, all different) of each run's pair; each is there."""
    lo, hi = np.searchsorted(keys["h"], runs["h"], "left"), np.searchsorted(keys["h"], runs["h"], "right")
    for i in np.flatnonzero(hi - lo > 1):
        lo[i] += np.searchsorted(keys["c"][lo[i] : hi[i]], runs["c"][i])
    return lo


def _mark(rule: Rule, finish: Callable[[pa.Table, list[np.ndarray]], pa.Table]):
    def mark(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        runs = np.concatenate([np.zeros(0, _RUN), *_arrays(told.column("data"), _RUN)])
        frequent = np.unique(np.concatenate([np.zeros(0, C.U64), *_arrays(told.column("frequent"), np.uint64)]))
        return finish(table, covered_units(rule, table, runs, frequent))

    return mark


def marked(docs: DataFrame, make: Callable[[int], Rule], finish: Callable[[pa.Table, list[np.ndarray]], pa.Table], schema: str, doc_id: str, text: str) -> DataFrame:
    """make: the rule for so many bytes in all. finish: gets a batch's rows (doc_id, place, text) and the covered units of
    each text, and gives the rows of the result, which have the given schema."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = C.text_bytes(rows)
    rule, (batches, buckets, shards) = make(total), parts(total)
    rows = rows.withColumns({"place": F.coalesce("doc_id", F.lit(-(1 << 63))), "batch": F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(batches)).cast("int")})
    dealt = rows.repartitionById(batches, "batch")
    by_batch = dealt.groupBy("batch")
    counted = by_batch.applyInArrow(_count(rule, buckets), "bucket int, batch int, data binary").repartitionById(buckets, "bucket")
    again = counted.groupBy("bucket").applyInArrow(_again, "batch int, data binary").repartitionById(batches, "batch")
    sent = by_batch.cogroup(again.groupBy("batch")).applyInArrow(_send(rule, shards), _SENT).repartitionById(shards, "shard")
    told = sent.groupBy("shard").applyInArrow(_judge(rule), "batch int, data binary, frequent binary").repartitionById(batches, "batch")
    return by_batch.cogroup(told.groupBy("batch")).applyInArrow(_mark(rule, finish), schema)


def union_mask(spans: np.ndarray, size: int) -> np.ndarray:
    """Which of size units the spans cover."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, spans[:, 0], 1)
    np.add.at(steps, spans[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


def suffix_order(codes: np.ndarray, offsets: np.ndarray, packed: int = 1) -> np.ndarray:
    """The sorted suffixes of strings, each suffix up to its string's end, equal ones by place. codes: one for each unit, or
    for the packed units that begin there, 0 beyond the string's end. By doubling the compared length; suffixes that nothing
    equals any more are left alone. A rank is the number of suffixes before the first equal one, plus one."""
    n = len(codes)
    end = np.repeat(offsets[1:], np.diff(offsets))
    longest = int(np.diff(offsets).max(initial=0))
    rank = np.zeros(n, np.int64)
    tied, keys, have = np.arange(n), codes.astype(C.U64), 0
    while len(tied):
        order = np.argsort(keys)
        tied, keys = tied[order], keys[order]
        before = rank[tied]
        starts = np.ones(len(tied), bool)
        starts[1:] = before[1:] != before[:-1]
        head = np.flatnonzero(starts)
        place = np.maximum(before, 1) + np.arange(len(tied)) - np.repeat(head, np.diff(np.append(head, len(tied))))
        new = starts.copy()
        new[1:] |= keys[1:] != keys[:-1]
        rank[tied] = place[new][np.cumsum(new) - 1]
        have = have * 2 or packed
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        if have >= longest:
            break
        after = tied + have
        there = after < end[tied]
        keys = rank[tied].astype(C.U64) << C.U64(32)
        keys[there] |= rank[after[there]].astype(C.U64)
    out = np.empty(n, np.int64)
    out[rank - 1] = np.arange(n)
    if len(tied):  # equal to their ends
        tied = tied[np.argsort(rank[tied] << 32 | tied)]
        before = rank[tied]
        starts = np.ones(len(tied), bool)
        starts[1:] = before[1:] != before[:-1]
        head = np.flatnonzero(starts)
        out[before - 1 + np.arange(len(tied)) - np.repeat(head, np.diff(np.append(head, len(tied))))] = tied
    return out
