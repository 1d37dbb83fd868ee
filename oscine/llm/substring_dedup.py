"""Substring dedup (operator 3): each shard has a compressed FM-index, a wavelet tree over the Burrows-Wheeler transform of
its word sequences. The documents' segments are streamed against it: backward search gives, for each place, how far it
matches any other place, and the intervals of matches of at least the threshold are reported.

Words are [^\\x20\\x09-\\x0D]+, unchanged, compared by hashes of 64 bits. A window is LENGTH consecutive words of one document.
A word goes if a window that covers it also starts earlier: in a document with a smaller doc_id, or before in the same one.
Null and empty texts have no words. A null doc_id counts as smaller than any other; rows that share a doc_id count as one
document, in which their places are compared. Repeated rows give repeated rows; an empty table gives none; extra columns are
not looked at."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from oscine.llm import anchors as A
from oscine.llm import common as C

LENGTH = 20


class WaveletTree:
    """Ranks of symbols in a sequence, from one packed row of bits for each bit of the symbols."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.rows = []
        for bit in range(bits - 1, -1, -1):
            ones = (sequence >> bit) & 1 > 0
            padded = np.zeros(-(-(len(ones) + 1) // 64) * 64, bool)
            padded[: len(ones)] = ones
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1]
            self.rows.append((bit, packed, before, int((~ones).sum())))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where at stands in the last row among the places of the symbols."""
        for bit, packed, before, zeros in self.rows:
            word = at >> 6
            inside = packed[word] & ((C.U64(1) << (at & 63).astype(C.U64)) - C.U64(1))
            ones = before[word] + np.bitwise_count(inside)
            at = np.where((symbols >> bit) & 1 > 0, zeros + ones, at - ones)
        return at


class FMIndex:
    """An index of sequences of symbols from 1 up; each sequence ends in a mark, 0."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray):
        sizes = np.diff(offsets)
        marked = offsets + np.arange(len(offsets))
        whole = np.zeros(len(symbols) + len(sizes), np.int64)
        whole[np.arange(len(symbols)) + np.repeat(np.arange(len(sizes)), sizes)] = symbols
        order = A.suffix_order(whole, marked)
        starts = np.zeros(len(whole), bool)
        starts[marked[:-1]] = True
        transform = np.where(starts[order], 0, whole[order - 1])
        top = int(symbols.max(initial=0))
        self.size = len(whole)
        self.tree = WaveletTree(transform, max(1, top.bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(whole, minlength=top + 1))])
        every = np.arange(top + 1)
        self.base = self.first[:-1] - self.tree.descend(every, np.zeros(top + 1, np.int64))

    def back(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One step of backward search: the border of an interval, extended by a symbol before it."""
        return self.base[symbols] + self.tree.descend(symbols, at)


def matching(index: FMIndex, symbols: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For the matches that end before each given place: how many symbols match back from there in a place besides the own
    one, threshold at most, and the first row of the interval reached. A match that is unique isn't searched further."""
    found = np.zeros(len(ends), np.int64)
    low, high = np.zeros(len(ends), np.int64), np.full(len(ends), index.size)
    alive = np.arange(len(ends))
    for step in range(1, threshold + 1):
        symbol = symbols[ends[alive] - step]
        lo, hi = index.back(symbol, low[alive]), index.back(symbol, high[alive])
        more = hi - lo > 1
        alive = alive[more]
        low[alive], high[alive] = lo[more], hi[more]
        found[alive] = step
        if not len(alive):
            break
    return found, low


def equal_windows(hashes: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """A number for each window of the sequences, in order; equal windows have equal numbers."""
    symbols = np.unique(hashes, return_inverse=True)[1] + 1
    index = FMIndex(symbols, offsets)
    windows = np.diff(offsets) - length + 1
    ends = A._spread(offsets[:-1] + length, windows)
    found, row = matching(index, symbols, ends, length)
    return np.where(found >= length, row, index.size + np.arange(len(ends)))


def rule(total: int, length: int = LENGTH) -> A.Rule:
    return A.Rule(length, True, True, equal_windows, A.gram_units(total, length, 8, 4))


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _finish(with_text: bool):
    def finish(table: pa.Table, spans: list[np.ndarray]) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept")}
        for lo, hi, buffer, offsets in C.text_slices(table.column("text"), A.SLICE_BYTES):
            starts, ends, first = C.words(buffer, offsets)
            for i in range(lo, hi):
                a, b = first[i - lo], first[i - lo + 1]
                stay = ~A.union_mask(spans[i], b - a) if len(spans[i]) else slice(None)
                begin, end = starts[a:b][stay], ends[a:b][stay]
                kept = b" ".join(buffer[s:e].tobytes() for s, e in zip(begin, end, strict=True))
                values = (int(b - a), int(b - a) - len(begin), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None)
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
        types = {"kept_sha256": pa.string(), "kept": pa.string()}
        return pa.table({"doc_id": table.column("doc_id")} | {k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})

    return finish


def substring_dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept of each row; kept is null unless asked for."""
    return A.marked(docs, lambda total: rule(total, length), _finish(with_text), SCHEMA, doc_id, text)
