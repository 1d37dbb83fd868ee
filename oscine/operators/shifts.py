"""Models under shifted data: a model is fitted once, and every shift at every severity is scored in one plan.

A shift is a name and how it changes columns, given the severity as a column. The grid is a small array that each row meets where
it is, so that rows aren't written or shuffled once for each shift."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oscine.functions import scalars as S
from oscine.operators import detection, learning
from oscine.operators import statistics as T

Shift = Callable[[Column], dict[str, Column]]
GRID = ["shift", "severity"]


def shifted(rows: DataFrame, shifts: dict[str, Shift], severities: list[float]) -> DataFrame:
    """Every row under every shift and severity, with the columns shift and severity; a shift sees the columns as they are in the
    row. The name "none" needs no entry: rows as they are, at severity 0."""
    grid = [("none", 0.0), *[(name, float(s)) for name in shifts for s in severities]]
    points = F.array(*[F.struct(F.lit(n).alias("shift"), F.lit(s).alias("severity")) for n, s in grid])
    every = rows.withColumn("__at", F.explode(points)).withColumns({"shift": F.col("__at.shift"), "severity": F.col("__at.severity")}).drop("__at")
    changes: dict[str, Column] = {}
    for name, shift in shifts.items():
        for column, value in shift(F.col("severity")).items():
            changes[column] = F.when(F.col("shift") == name, value).otherwise(changes.get(column, F.col(column)))
    return every.withColumns(changes)


def metrics(scores: DataFrame, p: str, y: str, keys: list[str], bins: int = 10, target: float = 0.9) -> DataFrame:
    """n, accuracy, auroc, fpr_at_tpr and ece of the scores of each of the keys' values."""
    own = scores.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(((F.col(p) >= 0.5) == (F.col(y) == 1)).cast("double")).alias("accuracy"))
    at = T.operating_counts(scores, p, y, keys)
    reached = F.when(F.col("tp") >= target * F.col("all_pos"), F.try_divide(F.col("fp"), F.col("all_neg")))
    fpr = at.groupBy(*keys).agg(F.coalesce(F.min(reached), F.lit(1.0)).alias("fpr_at_tpr"))
    binned = scores.groupBy(*keys, F.least(F.floor(F.col(p) * bins).cast("int"), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("m"), F.avg(p).alias("said"), F.avg(F.col(y).cast("double")).alias("was"))
    ece = binned.groupBy(*keys).agg((F.sum(F.col("m") * F.abs(F.col("said") - F.col("was"))) / F.sum("m")).alias("ece"))
    return own.join(T.auroc(scores, p, y, keys), keys).join(fpr, keys).join(ece, keys)


def evaluated(model, rows: DataFrame, label: str, shifts: dict[str, Shift], severities: list[float]) -> DataFrame:
    """The metrics of a fitted two-class model on rows under every shift and severity; the model is asked once for all."""
    scored = learning.predicted(model, shifted(rows, shifts, severities)).select(*GRID, label, F.col("p")[1].alias("score"))
    return metrics(scored, "score", label, GRID)


def worst(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The shift of least auroc and that of largest fpr_at_tpr (ties: by name and severity), and the mean auroc, without "none"."""
    keys = keys or []
    low = F.min(F.struct("auroc", *GRID))
    high = F.max_by(F.struct(*GRID), F.struct("fpr_at_tpr", *GRID))
    return found.where("shift <> 'none'").groupBy(*keys).agg(
        low["shift"].alias("worst_shift"), low["severity"].alias("worst_severity"), low["auroc"].alias("worst_auroc"), high["shift"].alias("most_false_shift"),
        F.max("fpr_at_tpr").alias("most_false"), F.avg("auroc").alias("mean_auroc"),
    )


def pivoted(found: DataFrame, metric: str, severities: list[float]) -> DataFrame:
    """A row for each shift with the metric at each severity, and how far its least is below that of no shift."""
    none = found.where("shift = 'none'").select(F.col(metric).alias("none"))
    columns = [F.max(F.when(F.col("severity") == s, F.col(metric))).alias(f"at_{str(s).replace('.', '_')}") for s in severities]
    rows = found.where("shift <> 'none'").groupBy("shift").agg(*columns, F.min(metric).alias("least"))
    return rows.join(F.broadcast(none), F.lit(True), "left").withColumn("drop", F.col("none") - F.col("least")).drop("least")  # one row


def detected(trace: DataFrame, keys: list[str], order: str, value: str, shifts: dict[str, Shift], severities: list[float], baseline: int, drift: float, threshold: float) -> DataFrame:
    """How a change detector fares on traces under every shift: series, how many gave an alarm, the interval of that share, mean
    latency from the end of the baseline, and the largest confidence."""
    every = shifted(trace, shifts, severities)
    series = [*keys, *GRID]
    scored = detection.cusum(detection.baseline_z(every, series, order, value, baseline), series, order, drift)
    alarms = detection.first_alarm(scored, series, order, "cusum", threshold, baseline)
    sums = alarms.groupBy(*GRID).agg(
        F.count("*").alias("series"), F.count("alarm").alias("alarms"), F.avg(F.col("alarm") - baseline).alias("latency"), F.max("confidence").alias("confidence")
    )
    low, high = S.wilson(F.col("alarms"), F.col("series"))
    return sums.withColumns({"low": low, "high": high})
