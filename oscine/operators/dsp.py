"""Filters and spectra over blocks: rows of series keys, a block number, and an array of samples. A block is filtered with a
part of its neighbours on either side, which is long enough for the filter to settle, so that a series of any length is worked
on block by block. Filters are kept as poles and zeros, and applied by their response at each frequency: narrow bands at a
high rate, whose coefficients multiplied out would make a recursion diverge, are as stable as wide ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_blocks(samples: DataFrame, keys: list[str], position: str, value: str, size: int) -> DataFrame:
    """block_idx, start_idx and the block's values in order."""
    ordered = F.array_sort(F.collect_list(F.struct(position, value)))
    rows = samples.groupBy(*keys, F.floor(F.col(position) / size).alias("block_idx")).agg(ordered.alias("rows"))
    return rows.select(*keys, "block_idx", (F.col("block_idx") * size).alias("start_idx"), F.transform("rows", lambda r: r[value]).alias("values"))


@dataclass(frozen=True)
class Filter:
    """Zeros, poles and gain of a digital filter."""

    zeros: np.ndarray
    poles: np.ndarray
    gain: float

    def response(self, hz: np.ndarray, fs: float) -> np.ndarray:
        at = np.exp(2j * np.pi * np.asarray(hz, float) / fs)[..., None]
        return self.gain * np.prod((at - self.zeros) / (at - self.poles), -1)

    def settles(self, share: float = 1e-6) -> int:
        """Samples after which so much of an impulse's response is left."""
        return int(np.ceil(np.log(share) / np.log(np.abs(self.poles).max())))


def butterworth(order: int, cut: float | tuple[float, float], kind: str, fs: float) -> Filter:
    """A digital Butterworth filter: analog prototype, band by transformation, bilinear map."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warped = 2 * fs * np.tan(np.pi * np.atleast_1d(np.asarray(cut, float)) / fs)
    if kind == "low":
        z, p, k = np.zeros(0), poles * warped[0], warped[0] ** order
    elif kind == "high":
        z, p, k = np.zeros(order), warped[0] / poles, np.real(1 / np.prod(-poles))
    else:
        width, middle = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - middle**2)
        z, p, k = np.zeros(order), np.concatenate([half + root, half - root]), width**order
    gain = k * np.real(np.prod(2 * fs - z) / np.prod(2 * fs - p))
    z = np.concatenate([(2 * fs + z) / (2 * fs - z), -np.ones(len(p) - len(z))])
    return Filter(z, (2 * fs + p) / (2 * fs - p), float(gain))


def apply_filter(f: Filter, x: np.ndarray, causal: bool = False) -> np.ndarray:
    """The rows of x filtered along the last axis: zero-phase, as forward and backward, or causal. The ends go on as their odd
    mirror image, for as long as the filter takes to settle; a longer one is repeated from its last value."""
    n, settle = x.shape[-1], f.settles()
    pad = min(n - 1, settle)
    left, right = 2 * x[..., :1] - x[..., pad:0:-1], 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]
    more = [(0, 0)] * (x.ndim - 1) + [(settle - pad, settle - pad)]
    wide = np.pad(np.concatenate([left, x, right], -1), more, "edge")
    size = 1 << (wide.shape[-1] + 2 * settle - 1).bit_length()
    # what is added up to the size goes from the last value to the first, without a step
    ramp = np.linspace(0, 1, size - wide.shape[-1] + 2)[1:-1]
    wide = np.concatenate([wide, wide[..., -1:] * (1 - ramp) + wide[..., :1] * ramp], -1)
    h = f.response(np.fft.rfftfreq(size), 1.0)
    y = np.fft.irfft(np.fft.rfft(wide) * (h if causal else np.abs(h) ** 2), size)
    return y[..., settle : settle + n]


def _by_length(names: list[str], values: str, change: Callable[[np.ndarray], np.ndarray]):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[np.asarray(v or [], float) for v in batch.column(c).to_pylist()] for c in ("__before", values, "__after")]
            joined = [np.concatenate(x) for x in zip(*rows, strict=True)]
            out: list = [None] * len(joined)
            for n in {len(x) for x in joined}:
                at = [i for i, x in enumerate(joined) if len(x) == n]
                done = change(np.stack([joined[i] for i in at])) if n > 1 else np.zeros((len(at), n))
                for i, y in zip(at, done, strict=True):
                    out[i] = y[len(rows[0][i]) : len(rows[0][i]) + len(rows[1][i])]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in names} | {values: pa.array(out, pa.list_(pa.float64()))})

    return apply


def filtered(blocks: DataFrame, keys: list[str], values: str, order: int, cut: float | tuple[float, float], kind: str, fs: float, size: int, causal: bool = False) -> DataFrame:
    """The blocks, of size samples each but a series' last, after a Butterworth filter, zero-phase unless causal. As many samples
    of the neighbour blocks go in as the filter takes to settle; each block is sent to the blocks that need it."""
    f = butterworth(order, cut, kind, fs)
    halo = f.settles()
    reach = -(-halo // size)
    # a block's neighbours come by its own series and place, not by a window over the whole series
    to = F.explode(F.array(*[F.lit(k) for k in range(-reach, reach + 1)]))
    sent = blocks.select(*keys, F.col("block_idx").alias("__from"), F.col(values).alias("__part"), to.alias("__to"))
    sent = sent.select(*keys, (F.col("__from") + F.col("__to")).alias("block_idx"), F.struct("__from", "__part").alias("__piece"))
    around = sent.groupBy(*keys, "block_idx").agg(F.array_sort(F.collect_list("__piece")).alias("__pieces"))

    def side(before: bool) -> Column:
        parts = F.filter("__pieces", lambda x: x["__from"] < F.col("block_idx") if before else x["__from"] > F.col("block_idx"))
        joined = F.flatten(F.transform(parts, lambda x: x["__part"]))
        return F.when(F.size(joined) <= halo, joined).otherwise(F.slice(joined, -halo if before else 1, halo))

    ready = blocks.join(around, [*keys, "block_idx"]).withColumns({"__before": side(True), "__after": side(False)})
    names = [c for c in blocks.columns if c != values]
    change = _by_length(names, values, lambda x: apply_filter(f, x, causal))
    return ready.select(*names, values, "__before", "__after").mapInArrow(change, blocks.select(*names, values).schema)


def welch(x: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power spectral density by Hann windows of half overlap, mean removed, averaged."""
    size = min(size, x.shape[-1])
    window = np.hanning(size + 1)[:-1]
    starts = range(0, x.shape[-1] - size + 1, max(1, size - size // 2))
    parts = np.stack([x[..., s : s + size] for s in starts], -2)
    spectrum = np.abs(np.fft.rfft((parts - parts.mean(-1, keepdims=True)) * window)) ** 2 / (fs * (window**2).sum())
    spectrum[..., 1 : (None if size % 2 else -1)] *= 2
    return np.fft.rfftfreq(size, 1 / fs), spectrum.mean(-2)


def welch_psd(values: Column, fs: float, size: int) -> Column:
    """Density array of an array column; frequencies are multiples of fs / size."""

    def density(column: pa.Array) -> pa.Array:
        return pa.array([None if v is None else welch(np.asarray(v, float), fs, size)[1].tolist() for v in column.to_pylist()], pa.list_(pa.float64()))

    return F.arrow_udf(density, "array<double>")(values)


def resampled(values: Column, n: int) -> Column:
    """Array column at another number of samples, by its Fourier coefficients."""

    def change(column: pa.Array) -> pa.Array:
        out = []
        for v in column.to_pylist():
            x = np.asarray(v or [], float)
            spectrum = np.fft.rfft(x) if len(x) else np.zeros(1)
            kept = np.zeros(n // 2 + 1, complex)
            m = min(len(kept), len(spectrum))
            kept[:m] = spectrum[:m]
            out.append((np.fft.irfft(kept, n) * n / len(x)).tolist() if len(x) else None)
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(change, "array<double>")(values)
