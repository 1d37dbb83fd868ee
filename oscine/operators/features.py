"""Feature vectors of windows over all channels of a recording. Windows are rows of (series keys, window, channel, values); the
channels of one window meet in a task, which is channels times window length, whatever the length of the recording."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscine.operators import dsp

#: The order of a feature vector.
NAMES = (
    "rms_mean rms_std rms_max low_mean low_std mid_mean mid_std high_mean high_std slope_mean slope_std rate_mean rate_std rate_max "
    "kurtosis_mean pairwise_corr rms_cv rate_cv snr edge_hz clip_fraction line_ratio flatness"
).split()
#: Bands in hertz, the spike threshold and converter rail in microvolts, seconds between two spikes.
LOW, MID, HIGH, WIDE = (1.0, 30.0), (30.0, 300.0), (300.0, 3000.0), (5.0, 200.0)
SPIKE_UV, RAIL_UV, NEAR_RAIL, REFRACTORY_S, LINE_HZ, EDGE = -50.0, 6400.0, 0.95, 0.001, 60.0, 0.95
SEGMENT, LONG_SEGMENT = 2048, 4096


def _cv(x: np.ndarray) -> float:
    return float(x.std() / abs(x.mean())) if abs(x.mean()) >= 1e-15 else 0.0


def spike_rates(x: np.ndarray, fs: float) -> np.ndarray:
    """Falls below the threshold a second, of each row; one that comes too soon after the last one counted is none."""
    below = x < SPIKE_UV
    falls = below[:, 1:] & ~below[:, :-1]
    out = np.zeros(len(x))
    for k, row in enumerate(falls):
        last = -np.inf
        for i in np.flatnonzero(row):
            if i - last >= REFRACTORY_S * fs:
                out[k] += 1
                last = i
    return out / (x.shape[1] / fs)


def window_vector(x: np.ndarray, fs: float) -> np.ndarray:
    """The features of one window, channels by samples, in the order of NAMES."""
    n = x.shape[1]
    hz, power = dsp.welch(x, fs, min(SEGMENT, n))
    long_hz, long_power = dsp.welch(x, fs, min(LONG_SEGMENT, n))
    long_power = long_power.mean(0)

    def inside(freq: np.ndarray, band: tuple[float, float]) -> np.ndarray:
        return (freq >= band[0]) & (freq <= min(band[1], fs / 2))

    def high_pass(cut: float) -> np.ndarray:
        return dsp.apply_filter(dsp.butterworth(2, cut, "high", fs), x) if cut < fs / 2 and n > 12 else x

    rms = np.sqrt((high_pass(1.0) ** 2).mean(1))
    low, mid, high = (power[:, inside(hz, b)].sum(1) * (hz[1] - hz[0]) for b in (LOW, MID, HIGH))
    band = inside(hz, MID) & (hz > 0)
    slopes = np.zeros(len(x))
    if band.sum() >= 2:
        log_hz = np.log10(hz[band]) - np.log10(hz[band]).mean()
        slopes = (np.log10(power[:, band] + 1e-30) * log_hz).sum(1) / (log_hz**2).sum()
    rates = spike_rates(high_pass(300.0), fs)
    away = x - x.mean(1, keepdims=True)
    spread = (away**2).mean(1)
    flat = spread < 1e-30
    kurtosis = np.where(flat, 0.0, (away**4).mean(1) / np.where(flat, 1, spread) ** 2 - 3)
    # the mean over all pairs follows from the sum of the standardised channels
    unit = away[~flat] / np.sqrt(spread[~flat])[:, None]
    m = len(unit)
    corr = float(((unit.sum(0) ** 2).mean() - m) / (m * (m - 1))) if m > 1 else 0.0
    total = np.cumsum(power.mean(0))
    edge = float(hz[min(np.searchsorted(total / total[-1], EDGE), len(hz) - 1)]) if total[-1] >= 1e-30 else 0.0
    lines = 0.0
    for target in (LINE_HZ, 2 * LINE_HZ):
        k = int(np.abs(long_hz - target).argmin())
        lines += long_power[max(0, k - 1) : k + 2].sum()
    wide, spikes = long_power[inside(long_hz, WIDE)].sum(), np.maximum(long_power[inside(long_hz, HIGH)], 1e-30)
    return np.array([
        rms.mean(), rms.std(), rms.max(), low.mean(), low.std(), mid.mean(), mid.std(), high.mean(), high.std(), slopes.mean(), slopes.std(),
        rates.mean(), rates.std(), rates.max(), kurtosis.mean(), corr, _cv(rms), _cv(rates), high.mean() / rms.mean() ** 2 if rms.mean() ** 2 > 1e-15 else 0.0,
        edge, (np.abs(x) > NEAR_RAIL * RAIL_UV).mean(), lines / wide if wide * (long_hz[1] - long_hz[0]) >= 1e-30 else 0.0,
        np.exp(np.log(spikes).mean()) / spikes.mean() if len(spikes) >= 2 else 0.0,
    ])


#: The order of the short vector, and its band of high-gamma power.
SEVEN = "rms_mean rms_std spike_band_power high_gamma_power spectral_slope spike_rate_hz kurtosis".split()
GAMMA = (80.0, 300.0)


def short_vector(x: np.ndarray, fs: float) -> np.ndarray:
    """The seven features of a trial, channels by samples, in the order of SEVEN, each a mean over channels but rms_std."""
    n = x.shape[1]
    hz, power = dsp.welch(x, fs, min(LONG_SEGMENT, n))

    def filtered(cut: float) -> np.ndarray:
        return dsp.apply_filter(dsp.butterworth(2, cut, "high", fs), x) if cut < fs / 2 and n > 12 else x

    def within(band: tuple[float, float]) -> np.ndarray:
        return (hz >= band[0]) & (hz <= band[1])

    rms = np.sqrt((filtered(1.0) ** 2).mean(1))
    spikes, gamma = (power[:, within(b)].sum(1) * (hz[1] - hz[0]) for b in (HIGH, GAMMA))
    band = within(MID) & (hz > 0)
    slopes = np.zeros(len(x))
    if band.sum() >= 2:
        log_hz = np.log10(hz[band])
        slopes = np.polyfit(log_hz, np.log10(power[:, band] + 1e-30).T, 1)[0]
    away = x - x.mean(1, keepdims=True)
    spread = (away**2).mean(1)
    kurtosis = np.where(spread > 0, (away**4).mean(1) / np.where(spread > 0, spread, 1) ** 2 - 3, 0.0)
    return np.array([rms.mean(), rms.std(), spikes.mean(), gamma.mean(), slopes.mean(), spike_rates(filtered(300.0), fs).mean(), kurtosis.mean()])


def feature_vectors(windows: DataFrame, keys: list[str], fs: float, channel: str = "channel", values: str = "values", short: bool = False) -> DataFrame:
    """keys and the features of each window, the 23 or the seven of the short vector; keys name the window too. A window whose
    channels aren't equally long, or have fewer than two samples, has NaN for each."""
    schema, names, vector = windows.select(*keys).schema, SEVEN if short else NAMES, short_vector if short else window_vector
    for name in names:
        schema = schema.add(name, "double")

    def one(key: tuple, table: pa.Table) -> pa.Table:
        rows = [np.asarray(v or [], float) for v in table.sort_by(channel).column(values).to_pylist()]
        whole = len({len(r) for r in rows}) == 1 and len(rows[0]) > 1
        found = vector(np.stack(rows), fs) if whole else np.full(len(names), np.nan)
        return pa.table({k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key, strict=True)} | {k: pa.array([float(v)]) for k, v in zip(names, found, strict=True)})

    return windows.select(*keys, channel, values).groupBy(*keys).applyInArrow(one, schema)


def windows_of(samples: DataFrame, keys: list[str], position: str, value: str, width: int, step: int, channel: str = "channel") -> DataFrame:
    """keys, window_idx, channel, values: windows of width samples that begin every step samples; a cut tail gives none. The
    centre of a window in seconds is (window_idx * step + width / 2) / fs."""
    first = F.greatest(F.lit(0), F.ceil((F.col(position) - width + 1) / step)).cast("long")
    spread = samples.withColumn("window_idx", F.explode(F.sequence(first, F.floor(F.col(position) / step).cast("long"))))
    ordered = F.array_sort(F.collect_list(F.struct(position, value)))
    rows = spread.groupBy(*keys, "window_idx", channel).agg(ordered.alias("rows")).where(F.size("rows") == width)
    return rows.select(*keys, "window_idx", channel, F.transform("rows", lambda r: r[value]).alias("values"))


def around_onset(vectors: DataFrame, keys: list[str], onset_window: int, before: int, after: int) -> DataFrame:
    """The windows before and from an onset on, at most so many of each, with the side that they are on."""
    at = F.col("window_idx")
    side = F.when((at >= onset_window - before) & (at < onset_window), "baseline").when((at >= onset_window) & (at < onset_window + after), "post")
    return vectors.withColumn("side", side).where("side IS NOT NULL")


def trial_rows(vectors: DataFrame, keys: list[str], onset_window: int, after: int) -> DataFrame:
    """One row for each recording: the mean of each feature over the windows from the onset on."""
    post = around_onset(vectors, keys, onset_window, 0, after)
    return post.groupBy(*keys).agg(*[F.avg(x).alias(x) for x in NAMES], F.count("*").alias("n_windows"))
