"""Change detection over window traces: rows of series keys, a window number from 0, and a metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oscine.operators.windowing import dead_time, previous


def baseline_z(trace: DataFrame, keys: list[str], order: str, value: str, baseline: int, name: str = "z") -> DataFrame:
    """Distance from the mean of the first windows in their standard deviations; null where those are all alike."""
    early = trace.where(F.col(order) < baseline).groupBy(*keys).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__std"))
    z = F.when(F.col("__std") >= 1e-15, (F.col(value) - F.col("__mean")) / F.col("__std"))
    return trace.join(early, keys, "left").withColumn(name, z).drop("__mean", "__std")


def cusum(scored: DataFrame, keys: list[str], order: str, drift: float, z: str = "z", name: str = "cusum") -> DataFrame:
    """Two-sided cumulative sum from the second window on, larger side. Each side's recursion max(0, S + x) is its running sum
    less the least running sum so far. All zero where there is no z."""
    series = Window.partitionBy(*keys).orderBy(order)
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    for side, sign in (("__up", 1), ("__down", -1)):
        x = F.when(F.col(order) == 0, 0.0).otherwise(sign * F.coalesce(z, F.lit(0.0)) - drift)
        scored = scored.withColumn("__sum", F.sum(x).over(so_far)).withColumn(side, F.col("__sum") - F.least(F.lit(0.0), F.min("__sum").over(so_far)))
        scored = scored.drop("__sum")
    there = F.count(z).over(Window.partitionBy(*keys)) > 0
    return scored.withColumn(name, F.when(there, F.greatest("__up", "__down")).otherwise(0.0)).drop("__up", "__down")


def first_alarm(trace: DataFrame, keys: list[str], order: str, stat: str, threshold: float, baseline: int) -> DataFrame:
    """alarm: the first window after the baseline with the statistic above the threshold, null if there is none; confidence:
    the statistic there, or else its maximum."""
    hit = (F.col(order) >= baseline) & (F.col(stat) > threshold)
    found = trace.groupBy(*keys).agg(F.min(F.when(hit, F.col(order))).alias("alarm"), F.min_by(stat, F.when(hit, F.col(order))).alias("at"), F.max(stat).alias("top"))
    return found.select(*keys, "alarm", F.coalesce("at", "top").alias("confidence"))


def runs_above(scored: DataFrame, keys: list[str], order: str, threshold: float, n: int, baseline: int, z: str = "z") -> DataFrame:
    """start: where the first run of n windows in a row with |z| above the threshold begins, after the baseline."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    above = F.sum((F.coalesce(F.abs(z), F.lit(0.0)) > threshold).cast("int")).over(frame)
    marked = scored.withColumn("__above", above)
    hit = (F.col("__above") == n) & (F.col(order) >= baseline + n - 1)
    found = marked.groupBy(*keys).agg(F.min(F.when(hit, F.col(order) - (n - 1))).alias("start"))
    z_there = scored.join(found, keys).groupBy(*keys, "start").agg(F.max(F.when(F.col(order) == F.col("start"), F.col(z))).alias("z_at_start"))
    return z_there


def latched(trace: DataFrame, keys: list[str], order: str, stat: str, threshold: float, release: float = 0.5) -> DataFrame:
    """Rows at which an alert fires: the statistic is above the threshold, and has been down to the release share of it since
    the last alert."""
    event = F.when(F.col(stat) > threshold, 1).when(F.col(stat) <= release * threshold, 0)
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marked = trace.withColumn("__event", event).withColumn("__last", F.last("__event", ignorenulls=True).over(before))
    return marked.where((F.col("__event") == 1) & (F.coalesce("__last", F.lit(0)) != 1)).drop("__event", "__last")


def sweep(trace: DataFrame, keys: list[str], order: str, stat: str, thresholds: list[float], cooldowns: list[int], block: int = 65536) -> DataFrame:
    """Alerts of every threshold and cooldown, as rows: keys, threshold, cooldown, order, stat. The trace is computed once and met
    by each threshold; a cooldown thins a threshold's latched alerts."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    every = trace.select(*keys, order, stat, grid.alias("threshold"))
    event = F.when(F.col(stat) > F.col("threshold"), 1).when(F.col(stat) <= 0.5 * F.col("threshold"), 0)
    before = Window.partitionBy(*keys, "threshold").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marked = every.withColumn("__event", event).withColumn("__last", F.last("__event", ignorenulls=True).over(before))
    alerts = marked.where((F.col("__event") == 1) & (F.coalesce("__last", F.lit(0)) != 1)).drop("__event", "__last")
    out = None
    for c in cooldowns:
        kept = dead_time(alerts.withColumn("__block", F.floor(F.col(order) / block)), [*keys, "threshold"], order, c, "__block") if c > 0 else alerts.select(*keys, "threshold", order)
        part = kept.withColumn("cooldown", F.lit(c).cast("long"))
        out = part if out is None else out.union(part)
    return out.join(alerts, [*keys, "threshold", order]).select(*keys, "threshold", "cooldown", order, stat)


def confirmed(trace: DataFrame, keys: list[str], order: str, p: str, valid: Column, k: int, n: int, least: float) -> DataFrame:
    """Adds confirmed: k of the next n windows, this one included, are valid and have p of at least least; and last_p, the last
    valid p among them."""
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, n - 1)
    marked = trace.withColumn("__p", F.when(valid, F.col(p)))
    yes = F.sum(F.coalesce((F.col("__p") >= least).cast("int"), F.lit(0))).over(ahead)
    return marked.withColumn("confirmed", yes >= k).withColumn("last_p", F.last("__p", ignorenulls=True).over(ahead)).drop("__p")


def triage(outlier: Column, confirmed: Column, p: Column, high: float, low: float) -> Column:
    """Decision list: outliers and the unconfirmed first, then by probability."""
    return F.when(outlier, "unknown").when(confirmed & (p >= high), "suppression-like").when(p <= low, "artifact-like").otherwise("uncertain")


def gaps(frames: DataFrame, keys: list[str], order: list[str], number: str, block: str) -> DataFrame:
    """Adds dropped: the frames missing before each, by a jump of the frame number. block rises with the order."""
    step = F.col(number) - F.col("__number")
    return previous(frames, keys, block, order, number, "__number").withColumn("dropped", F.when(step > 1, step - 1).otherwise(0).cast("long")).drop("__number")


def backward_steps(frames: DataFrame, keys: list[str], order: list[str], time: str, block: str, wrap: int = 1 << 32) -> DataFrame:
    """Adds violation: the time is less than the one before, unless it fell by more than half the counter's range."""
    back = F.col("__time") - F.col(time)
    marked = previous(frames, keys, block, order, time, "__time")
    return marked.withColumn("violation", F.coalesce((back > 0) & (back <= wrap // 2), F.lit(False))).drop("__time")
