"""Spectra of short series. What is read off a spectrum comes in two forms: of rows (series keys, bin, hz, power), and of a
column that holds the powers of a series as an array, which needs no row but its own."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def periodogram(values: Column, fs: float) -> Column:
    """One-sided power spectral density of an array column, mean removed, by a Fourier transform of each array; bin k is at
    k * fs / n hertz."""

    def density(column: pa.Array) -> pa.Array:
        out = []
        for v in column.to_pylist():
            x = np.asarray(v or [], float)
            if not len(x):
                out.append(None)
                continue
            power = np.abs(np.fft.rfft(x - x.mean())) ** 2 / (len(x) * fs)
            power[1 : (len(x) + 1) // 2] *= 2
            out.append(power)
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(density, "array<double>")(values)


def _band(power: Column, lo: float, hi: float, width: float) -> tuple[Column, list[int]]:
    bins = [k for k in range(math.ceil(lo / width - 1e-9), math.floor(hi / width + 1e-9) + 1)]
    return F.slice(power, bins[0] + 1, len(bins)), bins


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def band_power(power: Column, lo: float, hi: float, width: float) -> Column:
    """Power between two frequencies, both included, of bins of the given width."""
    return _sum(_band(power, lo, hi, width)[0]) * width


def band_slope(power: Column, lo: float, hi: float, width: float) -> Column:
    """Slope of log power over log frequency in a band, by least squares."""
    part, bins = _band(power, max(lo, width), hi, width)
    x = np.log10(np.array(bins) * width)
    x -= x.mean()
    weights = F.array(*[F.lit(float(v)) for v in x / (x**2).sum()])
    return _sum(F.zip_with(part, weights, lambda p, w: F.log10(p + 1e-30) * w))


def power_edge(power: Column, width: float, share: float = 0.95) -> Column:
    """First frequency up to which the given share of the power lies."""
    goal = _sum(power) * share - 1e-12 * _sum(power)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("below"))

    def step(a: Column, x: Column) -> Column:
        return F.struct((a["sum"] + x).alias("sum"), (a["below"] + (a["sum"] + x < goal).cast("int")).alias("below"))

    return F.aggregate(power, start, step)["below"] * width


def band_flatness(power: Column, lo: float, hi: float, width: float) -> Column:
    """Geometric over arithmetic mean of the power in a band."""
    part, bins = _band(power, lo, hi, width)
    logs = F.transform(part, lambda x: F.ln(F.greatest(x, F.lit(1e-30))))
    return F.try_divide(F.exp(_sum(logs) / len(bins)), _sum(part) / len(bins))


def line_to_band(power: Column, line_hz: float, lo: float, hi: float, width: float) -> Column:
    """Power of the bin nearest a frequency and its neighbours, over the power of a band."""
    nearest = math.ceil(line_hz / width - 0.5)
    line = F.slice(power, max(0, nearest - 1) + 1, min(nearest, 1) + 2)
    return F.try_divide(_sum(line), _sum(_band(power, lo, hi, width)[0]))


def bandpower(psd: DataFrame, keys: list[str], lo: float, hi: float, width: float) -> DataFrame:
    """Power between two frequencies, both included."""
    return psd.where(F.col("hz").between(lo, hi)).groupBy(*keys).agg((F.sum("power") * width).alias("bandpower"))


def slope(psd: DataFrame, keys: list[str], lo: float, hi: float) -> DataFrame:
    """Slope of log power over log frequency in a band, by least squares."""
    band = psd.where(F.col("hz").between(lo, hi) & (F.col("hz") > 0))
    return band.groupBy(*keys).agg(F.regr_slope(F.log10(F.col("power") + 1e-30), F.log10("hz")).alias("slope"))


def edge(psd: DataFrame, keys: list[str], share: float = 0.95) -> DataFrame:
    """First frequency up to which the given share of the power lies."""
    so_far = F.sum("power").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("power").over(Window.partitionBy(*keys))
    return psd.withColumn("__share", so_far / whole).where(F.col("__share") >= share - 1e-12).groupBy(*keys).agg(F.min("hz").alias("edge_hz"))


def flatness(psd: DataFrame, keys: list[str], lo: float, hi: float) -> DataFrame:
    """Geometric over arithmetic mean of the power in a band."""
    floor = F.greatest(F.col("power"), F.lit(1e-30))
    return psd.where(F.col("hz").between(lo, hi)).groupBy(*keys).agg((F.exp(F.avg(F.ln(floor))) / F.avg("power")).alias("flatness"))


def line_ratio(psd: DataFrame, keys: list[str], line_hz: float, lo: float, hi: float, width: float) -> DataFrame:
    """Power of the bin nearest a frequency and its neighbours, over the power of a band."""
    near = psd.groupBy(*keys).agg(F.min(F.struct(F.abs(F.col("hz") - line_hz), "bin"))["bin"].alias("nearest"))
    line = F.sum(F.when(F.abs(F.col("bin") - F.col("nearest")) <= 1, F.col("power")).otherwise(0.0))
    band = F.sum(F.when(F.col("hz").between(lo, hi), F.col("power")).otherwise(0.0))
    return psd.join(near, keys).groupBy(*keys).agg(F.try_divide(line, band).alias("line_ratio"))
