"""Windows over samples, and what is summed up in them. Samples are long rows: series keys, a window number, a value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oscine.functions import scalars as S


def rms(value: str | Column) -> Column:
    value = S.col(value)
    return F.sqrt(F.avg(value * value))


def tumbling(samples: DataFrame, keys: list[str], window: str, least: int = 1, **aggregates: Column) -> DataFrame:
    """One row for each series and window; windows of fewer than least samples, such as a cut tail, are left out."""
    return samples.groupBy(*keys, window).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in aggregates.items()]).where(F.col("n") >= least)


def sliding(samples: DataFrame, keys: list[str], position: str, width: int, step: int, **aggregates: Column) -> DataFrame:
    """Windows of width positions that begin every step positions. Each sample goes to the windows that cover it, and is summed up
    there; windows that run over the last position of their series are left out after that."""
    first = F.greatest(F.lit(0), F.ceil((F.col(position) - width + 1) / step))
    covering = F.sequence(first.cast("long"), F.floor(F.col(position) / step).cast("long"))
    found = samples.withColumn("window_idx", F.explode(covering)).groupBy(*keys, "window_idx").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in aggregates.items()])
    last = samples.groupBy(*keys).agg(F.max(position).alias("__last"))
    return found.join(last, keys).where(F.col("window_idx") * step + width - 1 <= F.col("__last")).drop("__last")


def previous(rows: DataFrame, keys: list[str], block: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the value of the row before in the series' order, null for the first. block rises with the order: each block of a
    series is ordered by itself and gets the last value before it, so that a long series isn't one task."""
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    ends = rows.groupBy(*keys, block).agg(F.max_by(F.struct(value), F.struct(*order)).alias("__end"))
    ends = ends.select(*keys, block, F.lag(F.col("__end")[value]).over(Window.partitionBy(*keys).orderBy(block)).alias("__before"))
    marked = rows.withColumns({"__first": F.row_number().over(inside) == 1, "__lag": F.lag(value).over(inside)}).join(ends, [*keys, block])
    return marked.withColumn(name, F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__lag"))).drop("__first", "__lag", "__before")


def over_channels(per_channel: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, standard deviation of the population, maximum and coefficient of variation of a channel measure."""
    found = per_channel.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("max"))
    return found.withColumn("cv", S.safe_cv(F.col("mean"), F.col("std")))


def moving_average(samples: DataFrame, keys: list[str], order: list[str], value: str, width: int) -> Column:
    """Mean of the width samples about each, fewer at the ends of a series."""
    half = width // 2
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, width - 1 - half))


def robust_spread(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """median, and sigma as 1.4826 times the median distance from it, of each series: two passes of exact medians."""
    middle = samples.groupBy(*keys).agg(F.median(value).alias("median"))
    apart = samples.join(middle, keys).groupBy(*keys, "median").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return apart.select(*keys, "median", (F.col("mad") * 1.4826).alias("sigma"))


def clusters(flagged: DataFrame, keys: list[str], position: str, gap: int = 1) -> DataFrame:
    """Runs of flagged positions that are at most gap apart: first and last position, and number of rows, of each run."""
    order = Window.partitionBy(*keys).orderBy(position)
    new = (F.col(position) - F.lag(position).over(order) > gap).cast("int")
    marked = flagged.withColumn("cluster", F.sum(F.coalesce(new, F.lit(0))).over(order))
    return marked.groupBy(*keys, "cluster").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n"))


def epochs(samples: DataFrame, bounds: DataFrame, position: str) -> DataFrame:
    """Samples with the name of each epoch that they fall in; bounds: epoch, lo, hi (not included), a few rows."""
    return samples.join(F.broadcast(bounds), (F.col(position) >= F.col("lo")) & (F.col(position) < F.col("hi")))


def numbered(rows: DataFrame, keys: list[str], block: str, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row in its series, from 0; block rises with the order, and only blocks' counts meet."""
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, block).agg(F.count("*").alias("__n"))
    counts = counts.select(*keys, block, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    placed = rows.withColumn("__place", F.row_number().over(inside) - 1).join(counts, [*keys, block])
    return placed.withColumn(name, F.col("__base") + F.col("__place")).drop("__base", "__place")


def islands(events: DataFrame, keys: list[str], time: str, least: float, block: str) -> DataFrame:
    """Adds begins and island to events: one that comes least or more after the one before begins an island, which is known by
    the time of its first. What lies in one island doesn't depend on others. block rises with time."""
    rows = previous(events, keys, block, [time], time, "__last")
    begins = F.col("__last").isNull() | (F.col(time) - F.col("__last") >= least)
    rows = rows.withColumn("begins", begins).drop("__last").withColumn("__begins", F.when(F.col("begins"), F.col(time)))
    inside = Window.partitionBy(*keys, block).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(*keys, block).agg(F.max("__begins").alias("__end"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, block, F.max("__end").over(before).alias("__carried"))
    rows = rows.join(ends, [*keys, block]).withColumn("island", F.coalesce(F.max("__begins").over(inside), "__carried"))
    return rows.drop("__begins", "__carried")


def dead_time(events: DataFrame, keys: list[str], time: str, least: float, block: str) -> DataFrame:
    """The events that remain if one is dropped that comes less than least after the last one kept. Islands are worked on apart,
    each as a stream of sorted times of which only the last one kept is remembered. block rises with time."""
    rows = islands(events.select(*keys, time, block), keys, time, least, block)
    ordered = rows.select(*keys, time, "island", "begins").repartition(*keys, "island").sortWithinPartitions(*keys, "island", time, F.desc("begins"))
    return ordered.mapInArrow(_thinned(time, least), ordered.select(*keys, time).schema)


def greedy(times: np.ndarray, begins: np.ndarray, least: float, kept_at: float | None) -> np.ndarray:
    """Which of sorted times are kept: the first of an island always, others if they come least or more after the last one kept.
    kept_at: the last one kept before, for an island that began before. Islands of one need no step, others one for each kept."""
    kept = begins.copy()
    heads = np.flatnonzero(begins)
    edges = np.append(heads, len(times))
    many = np.diff(edges) > 1
    long = list(zip(heads[many].tolist(), edges[1:][many].tolist(), strict=True))
    if edges[0] > 0:
        long.insert(0, (-1, int(edges[0])))
    for a, b in long:
        last = times[a] if a >= 0 else kept_at
        i = a + 1
        while i < b:
            i += int(np.searchsorted(times[i:b], last + least))
            while i > a + 1 and times[i - 1] - last >= least:  # the sum may be rounded up
                i -= 1
            while i < b and times[i] - last < least:
                i += 1
            if i < b:
                kept[i], last = True, times[i]
                i += 1
    return kept


def _thinned(time: str, least: float):
    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            times = batch.column(time).to_numpy()
            kept = np.flatnonzero(greedy(times, np.asarray(batch.column("begins")), least, last))
            last = times[kept[-1]] if len(kept) else last
            yield batch.take(pa.array(kept)).select([x for x in batch.schema.names if x not in ("island", "begins")])

    return thin
