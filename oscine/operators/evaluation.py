"""Tables of models and checks: what holds for all rows of a model, models side by side, and gates that a release must pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_holdout(rows: DataFrame, held_out: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """A metric measured once for each model, on every row of it; rows of models without one keep their own, if they have it."""
    other = held_out.select(*keys, F.col(metric).alias("__held"))
    own = F.col(metric) if metric in rows.columns else F.lit(None)
    return rows.join(other, keys, "left").withColumn(metric, F.coalesce("__held", own)).drop("__held")


def side_by_side(results: dict[str, DataFrame], metric: str, keys: list[str]) -> DataFrame:
    """The rows of several models' results, with the model's name, its place among them by the metric, and how far it is behind the
    best."""
    rows = reduce(DataFrame.unionByName, (df.select(*keys, metric).withColumn("model", F.lit(name)) for name, df in results.items()))
    best = Window.partitionBy(*keys).orderBy(F.desc(metric), "model")
    return rows.withColumns({"place": F.row_number().over(best), "behind": F.first(metric).over(best) - F.col(metric)})


def gates(offenders: dict[str, DataFrame]) -> DataFrame:
    """name, offenders and whether it passed, of each gate; a gate is passed if its table of offenders is empty."""
    counts = [df.agg(F.count("*").alias("offenders")).select(F.lit(name).alias("gate"), "offenders") for name, df in offenders.items()]
    return reduce(DataFrame.unionByName, counts).withColumn("passed", F.col("offenders") == 0)


def of_trials(trials: DataFrame, kind: str, level: str | None = None) -> DataFrame:
    """The trials of a kind, and of a level if one is named."""
    found = trials.where(F.col("perturbation") == kind)
    return found if not level else found.where(F.col("level") == level)
