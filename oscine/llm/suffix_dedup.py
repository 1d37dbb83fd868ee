"""Suffix-array dedup (operator 2): in each shard, intervals of the Burrows-Wheeler transform are extended backward by one
byte at a time, breadth first, which derives common prefixes by increasing length, and stops at the minimum length. What then
shares an interval is a repeated string of that length.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. Texts are UTF-8 bytes,
null counts as empty, and no string crosses a document's end. A null doc_id counts as smaller than any other. Rows that share
a doc_id don't make each other's strings go, as neither id is smaller. Repeated rows give repeated rows; an empty table gives
none; extra columns are not looked at."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from oscine.llm import anchors as A
from oscine.llm import common as C

LENGTH = 50
_PACKED, _BITS = 7, 9


def burrows_wheeler(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For strings that each end in a mark of their own: the symbols (0 for the marks), the sorted suffixes, and the transform."""
    sizes = np.diff(offsets)
    marked = offsets + np.arange(len(offsets))
    symbols = np.zeros(len(data) + len(sizes), np.uint16)
    symbols[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data.astype(np.uint16) + 1
    end = np.repeat(marked[1:], np.diff(marked))
    place = np.arange(len(symbols))
    packed = np.zeros(len(symbols), C.U64)
    for k in range(_PACKED):
        there = place + k < end
        packed[there] |= symbols[place[there] + k].astype(C.U64) << C.U64(_BITS * (_PACKED - 1 - k))
    order = A.suffix_order(packed, marked, _PACKED)
    before = symbols[np.maximum(order - 1, 0)].copy()
    starts = np.zeros(len(symbols), bool)
    starts[marked[:-1]] = True
    before[starts[order]] = 0
    return symbols, order, before


def intervals(symbols: np.ndarray, order: np.ndarray, transform: np.ndarray, length: int) -> np.ndarray:
    """The number of the interval of each row: rows share one if their suffixes share a prefix of the given length.

    Level by level: an interval of all suffixes that begin with some string w is extended backward by each symbol c that
    stands before one of them; the rows of cw follow one another. A border between two rows of the same first symbol is due at
    the next level if the rows they were extended from are in different intervals now. Only rows that are still joined to
    their neighbour are looked at, and the search ends when a level finds no border."""
    head = symbols[order]
    border = np.ones(len(order), bool)
    border[1:] = (head[1:] != head[:-1]) | (head[1:] == 0)
    source = np.argsort(transform, kind="stable")  # the row that each row was extended from
    joined = np.flatnonzero(~border)
    number = np.arange(len(order))  # an interval's number is its first row
    for _ in range(1, length):
        runs = np.flatnonzero(np.diff(joined, prepend=-2) > 1)
        number[joined] = np.repeat(joined[runs] - 1, np.diff(np.append(runs, len(joined))))
        apart = number[source[joined]] != number[source[joined - 1]]
        if not apart.any():
            break
        new = joined[apart]
        border[new], number[new] = True, new
        joined = joined[~apart]
    return np.cumsum(border)


def equal_windows(data: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """A number for each window of the strings, in order; equal windows have equal numbers."""
    symbols, order, transform = burrows_wheeler(data, offsets)
    of_row = intervals(symbols, order, transform, length)
    at = np.empty(len(order), np.int64)
    at[order] = of_row
    windows = np.diff(offsets) - length + 1
    return at[A._spread(offsets[:-1] + np.arange(len(windows)), windows)]


def rule(total: int, length: int = LENGTH) -> A.Rule:
    return A.Rule(length, False, False, equal_windows, A.gram_units(total, length, 2.0, 12))


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _finish(with_text: bool):
    def finish(table: pa.Table, spans: list[np.ndarray]) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for lo, hi, buffer, offsets in C.text_slices(table.column("text"), A.SLICE_BYTES):
            for i in range(lo, hi):
                data = buffer[offsets[i - lo] : offsets[i - lo + 1]]
                size, spans_left = len(data), 0
                if len(spans[i]):
                    gone = A.union_mask(spans[i], size)
                    spans_left = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    data = data[~gone]
                kept = data.tobytes()
                values = (size, size - len(kept), spans_left, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None)
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
        ids = table.column("doc_id")
        types = {"kept_sha256": pa.string(), "kept": pa.string()}
        return pa.table({"doc_id": ids} | {k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})

    return finish


def suffix_dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept of each row. kept, null unless asked for, is the remaining
    bytes as text; a character of which only some bytes remain is replaced there, while the hash is of the bytes."""
    return A.marked(docs, lambda total: rule(total, length), _finish(with_text), SCHEMA, doc_id, text)
