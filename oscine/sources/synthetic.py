"""Generated recordings, by column functions only: every random number is a hash of seed, recording, channel and place, so
that rows come out alike however they are dealt out. And disturbances of recordings, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCENARIOS = ("baseline", "crosstalk", "neurotox", "full")


def uniform(*parts: Column | int | str) -> Column:
    """A number in (0, 1) that depends on its parts."""
    mixed = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.pmod(mixed, F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(*parts: Column | int | str) -> Column:
    return F.sqrt(-2 * F.ln(uniform("radius", *parts))) * F.cos(2 * math.pi * uniform("angle", *parts))


def recordings(spark: SparkSession, scenario: str, recordings: int = 1, channels: int = 4, fs: float = 2000.0, seconds: float = 2.0, seed: int = 0, noise_uv: float = 5.0, rate_hz: float = 10.0, amplitude_uv: float = 80.0) -> DataFrame:
    """recording_id, channel, sample_idx, uv. Noise, spikes (a Gaussian pulse at hashed places), and by scenario a coupled tone,
    or suppression of the spikes over the second half."""
    if scenario not in SCENARIOS:
        raise ValueError(f"scenario is one of {SCENARIOS}, not {scenario}")
    n = int(seconds * fs)
    base = spark.range(recordings * channels * n).select(
        F.floor(F.col("id") / (channels * n)).alias("recording_id"), F.pmod(F.floor(F.col("id") / n), F.lit(channels)).cast("int").alias("channel"), F.pmod("id", F.lit(n)).alias("sample_idx")
    )
    place = ("recording_id", "channel", "sample_idx")
    uv = noise_uv * normal(seed, *[F.col(c) for c in place])
    half = max(1, int(0.0005 * fs))
    for k in range(-half, half + 1):
        fires = uniform("spike", seed, F.col("recording_id"), F.col("channel"), F.col("sample_idx") - k) < rate_hz / fs
        share = F.when(F.col("sample_idx") - k >= n // 2, 0.4).otherwise(1.0) if scenario in ("neurotox", "full") else F.lit(1.0)
        uv = uv - F.when(fires & (F.col("sample_idx") >= k), amplitude_uv * math.exp(-0.5 * (2 * k / half) ** 2) * share).otherwise(0.0)
    if scenario in ("crosstalk", "full"):
        tone = 100.0 * F.sin(2 * math.pi * (fs / 20) / fs * F.col("sample_idx"))
        uv = uv + tone * F.when(F.col("channel") == 0, 1.0).when(F.col("channel") == 1, 0.01).otherwise(0.0)
    return base.withColumn("uv", uv)


def _hit(name: str, share: float, seed: int, *parts: str) -> Column:
    return uniform(name, seed, *[F.col(p) for p in parts]) < share


def disturb(samples: DataFrame, name: str, severity: float, seed: int, fs: float, n_samples: int) -> DataFrame:
    """samples with uv changed by a disturbance of a severity in [0, 1]; a row is changed by itself, or by a series' own sums."""
    if name not in DISTURBANCES:
        raise ValueError(f"disturbance is one of {sorted(DISTURBANCES)}, not {name}")
    return DISTURBANCES[name](samples, min(1.0, max(0.0, severity)), seed, fs, n_samples)


def _line(df, s, seed, fs, n):
    t, uv = F.col("sample_idx") / fs, F.col("uv")
    for h in range(1, 2 + int(2 * s)):
        uv = uv + (5 + 75 * s) / h * F.sin(2 * math.pi * 60 * h * t + s * 0.02 * h * (F.col("sample_idx") + 1))
    return df.withColumn("uv", uv)


def _drift(df, s, seed, fs, n):
    top = 5 + 50 * s
    slope = (2 * uniform("drift", seed, F.col("recording_id"), F.col("channel")) - 1) * top / max(1, n - 1)
    return df.withColumn("uv", F.col("uv") + slope * F.col("sample_idx"))


def _clip(df, s, seed, fs, n):
    top = 6400.0 * (1 - 0.7 * s)
    return df.withColumn("uv", F.greatest(F.lit(-top), F.least(F.lit(top), "uv")))


def _dropout(df, s, seed, fs, n):
    gone = _hit("dead", 0.1 * (1 + 2 * s), seed, "recording_id", "channel") & _hit("gone", 0.05 + 0.25 * s, seed, "recording_id", "channel", "sample_idx")
    return df.withColumn("uv", F.when(gone, 0.0).otherwise(F.col("uv")))


def _gain(df, s, seed, fs, n):
    gain = 1 + (0.05 + 0.25 * s) * normal("gain", seed, F.col("recording_id"), F.col("channel"))
    return df.withColumn("uv", F.col("uv") * F.greatest(F.lit(0.3), F.least(F.lit(2.0), gain)))


def _suppress(df, s, seed, fs, n):
    some = _hit("suppress", 0.5, seed, "recording_id", "channel") & (F.col("sample_idx") >= n // 3)
    return df.withColumn("uv", F.when(some, F.col("uv") * (1 - (0.15 + 0.45 * s))).otherwise(F.col("uv")))


def _fewer(df, s, seed, fs, n):
    spread = df.groupBy("recording_id", "channel").agg(F.stddev_pop("uv").alias("__std"))
    high = F.abs("uv") > (3 - 1.5 * s) * F.col("__std")
    return df.join(spread, ["recording_id", "channel"]).withColumn("uv", F.when(high, F.col("uv") * (1 - 0.6 * s)).otherwise(F.col("uv"))).drop("__std")


def _couple(df, s, seed, fs, n):
    leak = df.select("recording_id", (F.col("channel") + 1).alias("channel"), "sample_idx", F.col("uv").alias("__from"))
    both = df.join(leak, ["recording_id", "channel", "sample_idx"], "left")
    return both.withColumn("uv", F.col("uv") + (0.005 + 0.035 * s) * F.coalesce("__from", F.lit(0.0))).drop("__from")


def _quantise(df, s, seed, fs, n):
    step = 2 * 6400.0 / 2 ** (16 - round(8 * s))
    return df.withColumn("uv", F.bround(F.col("uv") / step) * step)


def _burst(df, s, seed, fs, n):
    size = max(1, int(fs * 0.01 * (1 + 2 * s)))
    on = _hit("burst", min(1.0, 3 * max(s, 0.1) * size / n), seed, "recording_id") | (F.pmod(F.floor(F.col("sample_idx") / size), F.lit(max(1, n // size // 3))) == 0)
    return df.withColumn("uv", F.col("uv") + F.when(on, (10 + 90 * s) * normal("burst", seed, F.col("recording_id"), F.col("channel"), F.col("sample_idx"))).otherwise(0.0))


def _noise(df, s, seed, fs, n):
    return df.withColumn("uv", F.col("uv") + 40 * s * normal("noise", seed, F.col("recording_id"), F.col("channel"), F.col("sample_idx")))


DISTURBANCES = {
    "line_noise": _line, "drift": _drift, "clipping": _clip, "channel_dropout": _dropout, "gain_mismatch": _gain, "partial_suppression": _suppress,
    "rate_decrease": _fewer, "coupling": _couple, "quantisation": _quantise, "emi_burst": _burst, "broadband_noise": _noise,
}


def dataset(spark: SparkSession, names: list[str], severities: list[float], per_cell: int, seed: int = 0, **shape: float) -> DataFrame:
    """Recordings for every disturbance and severity: name, severity and samples."""
    parts = []
    for k, (name, s) in enumerate((a, b) for a in names for b in severities):
        base = recordings(spark, "baseline", per_cell, seed=seed + k, **shape)
        n, fs = int(shape.get("seconds", 2.0) * shape.get("fs", 2000.0)), float(shape.get("fs", 2000.0))
        parts.append(disturb(base, name, s, seed + k, fs, n).withColumns({"name": F.lit(name), "severity": F.lit(float(s))}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
