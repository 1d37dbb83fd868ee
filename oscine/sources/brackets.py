"""Bracketed texts as trees: an element is a row of its place, its parent and its head, and texts can be written back without some.

A text is taken apart in whole arrays, without a step for each character: quotes switch counting off, the running sum of brackets
is the depth, and at each depth opening and closing brackets take turns. A backslash before a quote makes it a character. Brackets
that nothing closes, or that close nothing, are no element."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
TREE = "first long, last long, depth int, parent long, head string"


def elements(data: bytes, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each element, in order: the byte at which it begins, the one behind its end, its depth from 0, and the number of its
    parent among them, -1 for none. starts: where texts begin, if data is many of them one after the other."""
    text = np.frombuffer(data, np.uint8)
    starts = np.zeros(1, np.int64) if starts is None else starts
    sizes = np.diff(np.append(starts, len(text)))
    own = np.repeat(np.arange(len(starts)), sizes)
    places = np.arange(len(text))
    slash = text == 92
    # a backslash counts if an even number stands before it in the text
    run = places - np.maximum(np.maximum.accumulate(np.where(slash, -1, places)), starts[own] - 1) if len(text) else np.zeros(0, int)
    escaped = np.zeros(len(text), bool)
    escaped[1:] = run[:-1] % 2 == 1
    escaped[starts[sizes > 0]] = False

    def summed(steps: np.ndarray) -> np.ndarray:
        """Running sums, from each text's start on."""
        total = np.append(0, np.cumsum(steps))
        return total[1:] - total[starts[own]]

    quoted = summed((text == 34) & ~escaped) % 2 == 1
    step = np.where(quoted, 0, (text == 40).astype(np.int64) - (text == 41))
    after = summed(step)
    at = np.flatnonzero(step)
    depth = np.where(step[at] > 0, after[at] - 1, after[at])
    order = np.lexsort((at, depth, own[at]))
    opens, level, of = step[at[order]] > 0, depth[order], own[at[order]]
    pair = np.flatnonzero(opens[:-1] & ~opens[1:] & (level[:-1] == level[1:]) & (of[:-1] == of[1:]))
    begin, end, level = at[order[pair]], at[order[pair + 1]] + 1, level[pair]
    place = np.argsort(begin)
    begin, end, level = begin[place], end[place], level[place]
    parent = np.full(len(begin), -1)
    for d in np.unique(level)[1:]:
        mine, above = np.flatnonzero(level == d), np.flatnonzero(level == d - 1)
        if len(above):
            k = np.searchsorted(begin[above], begin[mine]) - 1
            inside = (k >= 0) & (end[above[np.maximum(k, 0)]] >= end[mine])
            parent[mine[inside]] = above[k[inside]]
    return begin, end, level, parent


def heads(data: bytes, begin: np.ndarray, end: np.ndarray) -> list[str]:
    """The first word in each element."""
    text = np.frombuffer(data, np.uint8)
    stops = np.flatnonzero(_SPACE[text] | (text == 40) | (text == 41)) if len(text) else np.zeros(0, int)
    out = []
    for a, b in zip((begin + 1).tolist(), end.tolist(), strict=True):
        stop = stops[np.searchsorted(stops, a)]
        out.append(data[a : min(int(stop), b - 1)].decode("utf-8", "replace"))
    return out


def nested(text: str | None, kind: str) -> list[str]:
    """The outermost elements (kind ...) of a text, whatever is nested in them."""
    data = (text or "").encode()
    opening = b"(" + kind.encode()
    if opening not in data:
        return []
    begin, end, _, _ = elements(data)
    out, upto = [], -1
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        if a >= upto and data.startswith(opening, a) and _SPACE[data[a + len(opening)]]:
            out.append(data[a:b].decode("utf-8", "replace"))
            upto = b
    return out


def tree(texts: DataFrame, source: str, text: str) -> DataFrame:
    """source and, for each element of its text: first and last byte (one behind), depth, parent (where the parent begins, null for
    none) and head."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [(value or "").encode() for value in batch.column(1).to_pylist()]
            ends = np.cumsum([len(e) for e in each], dtype=np.int64)
            lo = 0
            while lo < len(each):  # texts of a few megabytes at once
                base = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + (4 << 20), "right")))
                data, starts = b"".join(each[lo:hi]), np.append(base, ends[lo : hi - 1]) - base
                begin, end, depth, parent = elements(data, starts)
                of = np.searchsorted(starts, begin, "right") - 1
                above = np.where(parent >= 0, begin[np.maximum(parent, 0)] - starts[of], -1) if len(begin) else parent
                yield pa.record_batch({
                    source: batch.column(0).take(pa.array(of + lo, pa.int64())), "first": pa.array(begin - starts[of], pa.int64()), "last": pa.array(end - starts[of], pa.int64()), "depth": pa.array(depth, pa.int32()),
                    "parent": pa.array(above, pa.int64(), mask=above < 0), "head": pa.array(heads(data, begin, end), pa.string()),
                })
                lo = hi

    kind = texts.schema[source].dataType.simpleString()
    return texts.select(source, text).mapInArrow(parsed, f"{source} {kind}, {TREE}")


def without(texts: DataFrame, gone: DataFrame, source: str, text: str) -> DataFrame:
    """The texts, written without the elements that are gone (source, first, last); what lies in one of them goes with it. The
    rest stays byte for byte."""
    spans = gone.groupBy(source).agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("__gone"))  # of one text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, away in zip(batch.column(text).to_pylist(), batch.column("__gone").to_pylist(), strict=True):
                data, kept, at = (value or "").encode(), [], 0
                for span in away or ():
                    if span["first"] >= at:
                        kept.append(data[at : span["first"]])
                        at = span["last"]
                out.append(None if value is None else (b"".join(kept) + data[at:]).decode())
            yield pa.record_batch({source: batch.column(source), text: pa.array(out, pa.string())})

    both = texts.select(source, text).join(spans, source, "left")
    return both.mapInArrow(cut, texts.select(source, text).schema)
