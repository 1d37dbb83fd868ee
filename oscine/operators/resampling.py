"""Statistics that users give by name, over groups and by bootstrap.

A statistic is a function of sorted values and how often each counts, a row of counts for each resample, and gives a number for
each; so one function serves a group, given as its different values and their counts, and all resamples of it at once.

The bootstrap is that of little bags: a group is dealt by the hash of its rows into shards of about SHARD rows, each is resampled
to the whole group's size in one task, and the shards' intervals are averaged. A group of up to SHARD rows is one shard, which
is the plain bootstrap. No task holds more than a shard, whatever the group."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Statistic = Callable[[np.ndarray, np.ndarray], np.ndarray]

#: Rows of a shard, and counts that are held at once.
SHARD, HELD = 20_000, 1 << 21
_STATISTICS: dict[str, Statistic] = {}


def register(name: str, statistic: Statistic) -> None:
    """A statistic: values in order, counts (resamples by values) to a number for each resample."""
    _STATISTICS[name] = statistic


def known(name: str) -> Statistic:
    if name not in _STATISTICS:
        raise ValueError(f"no statistic {name}; known are {sorted(_STATISTICS)}")
    return _STATISTICS[name]


def mean(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return counts @ x / counts.sum(1)


def median(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The middle value, or the mean of the two in the middle."""
    ends = np.cumsum(counts, 1)
    n = ends[:, -1:]
    low, high = ((ends <= at).sum(1) for at in ((n - 1) // 2, n // 2))
    return (x[low] + x[high]) / 2


def trimmed(share: float) -> Statistic:
    """The mean without the share of the values at either end, rounded down."""

    def statistic(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        ends = np.cumsum(counts, 1)
        n = ends[:, -1:]
        cut = np.floor(n * share).astype(np.int64)
        kept = np.clip(ends, cut, n - cut) - np.clip(ends - counts, cut, n - cut)
        return kept @ x / kept.sum(1)

    return statistic


def spread(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Standard deviation of the population."""
    m = mean(x, counts)
    return np.sqrt(np.maximum(counts @ (x * x) / counts.sum(1) - m * m, 0))


for _name, _statistic in (("mean", mean), ("median", median), ("trimmed_mean", trimmed(0.1)), ("std", spread)):
    register(_name, _statistic)


def grouped(df: DataFrame, keys: list[str], value: str, *names: str) -> DataFrame:
    """keys, n and each named statistic of each group; null and NaN don't count. Values are counted before they are shuffled, and
    a task holds the different values of a group."""
    statistics = {n: known(n) for n in names}

    def found(key: tuple, table: pa.Table) -> pa.Table:
        x, counts = np.asarray(table.column("x")), np.asarray(table.column("n"))
        order = np.argsort(x)
        values = {n: pa.array([float(f(x[order], counts[order][None, :])[0])], pa.float64()) for n, f in statistics.items()}
        return pa.table({**{k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key, strict=True)}, "n": pa.array([int(counts.sum())]), **values})

    counted = df.select(*keys, F.col(value).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)").groupBy(*keys, "x").agg(F.count("*").alias("n"))
    schema = counted.select(*keys).schema.add("n", "long")
    for n in names:
        schema = schema.add(n, "double")
    return counted.groupBy(*keys).applyInArrow(found, schema)


def resampled(x: np.ndarray, n: int, statistic: Statistic, rounds: int, seed: int) -> np.ndarray:
    """The statistic of resamples of n values each, drawn from sorted values."""
    rng, step, out = np.random.default_rng(seed), max(1, HELD // max(len(x), 1)), []
    chances = np.full(len(x), 1 / len(x))
    for lo in range(0, rounds, step):
        out.append(statistic(x, rng.multinomial(n, chances, min(step, rounds - lo))))
    return np.concatenate(out)


def seed_of(seed: int, *key: object) -> int:
    return int.from_bytes(hashlib.blake2b(json.dumps([seed, *key], default=str).encode(), digest_size=8).digest(), "big")


def bootstrap(df: DataFrame, keys: list[str], value: str, row: list[str], name: str, rounds: int = 2000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """keys, n, estimate, low, high: a named statistic of each group with its percentile interval; row: columns that tell rows of a
    group apart. Numbers depend on seed, key and values alone, not on how rows are dealt to tasks; null and NaN don't count."""
    statistic = known(name)
    there = df.select(*keys, F.col(value).cast("double").alias("x"), F.xxhash64(*row).alias("spread")).where("x IS NOT NULL AND NOT isnan(x)")
    sizes = there.groupBy(*keys).agg(F.count("*").alias("n"))
    named = sizes.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    dealt = there.join(named, same).withColumn("shard", F.pmod("spread", F.ceil(F.col("n") / SHARD)))

    def of_shard(key: tuple, table: pa.Table) -> pa.Table:
        x, n = np.sort(np.asarray(table.column("x"))), int(table.column("n")[0].as_py())
        drawn = resampled(x, n, statistic, rounds, seed_of(seed, *[k.as_py() for k in key]))
        low, high = np.percentile(drawn, [50 * (1 - level), 50 * (1 + level)])
        own = float(statistic(x, np.ones((1, len(x)), np.int64))[0])
        return pa.table({**{k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key, strict=False)}, "n": pa.array([len(x)]), "estimate": [own], "low": [float(low)], "high": [float(high)]})

    schema = there.select(*keys).schema.add("n", "long").add("estimate", "double").add("low", "double").add("high", "double")
    shards = dealt.select(*keys, "shard", "x", "n").groupBy(*keys, "shard").applyInArrow(of_shard, schema)
    weighted = [(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in ("estimate", "low", "high")]
    return shards.groupBy(*keys).agg(F.sum("n").alias("n"), *weighted)
