"""Intervals, calibration, ranking measures and tables of classifier results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calibration_bins(scores: DataFrame, p: str, y: str, bins: int = 10, closed: bool = True) -> DataFrame:
    """bin, n, confidence, accuracy; closed: a score of 1 falls into the last bin, else it is left out."""
    number = F.floor(F.col(p) * bins).cast("int")
    kept = scores if closed else scores.where(F.col(p) < 1)
    number = F.least(number, F.lit(bins - 1)) if closed else number
    return kept.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))


def calibration_error(binned: DataFrame) -> DataFrame:
    apart = F.abs(F.col("accuracy") - F.col("confidence"))
    return binned.agg((F.sum(F.col("n") * apart) / F.sum("n")).alias("ece"), F.max(apart).alias("mce"))


def operating_counts(scores: DataFrame, p: str, y: str, keys: list[str] | None = None, blocks: int = 256) -> DataFrame:
    """One row for each distinct score in [0, 1], from the highest: true and false positives when that score is the threshold,
    and all positives and negatives. Scores are summed up first, then counted on within blocks of scores; what lies above a
    block comes from the blocks' sums."""
    keys = keys or []
    block = F.floor(F.col("score") * blocks).cast("int")
    per = scores.groupBy(*keys, F.col(p).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg")).withColumn("block", block)
    inside = Window.partitionBy(*keys, "block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    sums = per.groupBy(*keys, "block").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    above = Window.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    zero = F.lit(0)
    ends = sums.select(
        *keys, "block", F.coalesce(F.sum("a").over(above), zero).alias("tp_above"), F.coalesce(F.sum("b").over(above), zero).alias("fp_above"),
        F.sum("a").over(whole).alias("all_pos"), F.sum("b").over(whole).alias("all_neg"),
    )
    counted = per.withColumns({"tp_own": F.sum("pos").over(inside), "fp_own": F.sum("neg").over(inside)}).join(ends, [*keys, "block"])
    return counted.select(*keys, "score", "pos", "neg", (F.col("tp_above") + F.col("tp_own")).alias("tp"), (F.col("fp_above") + F.col("fp_own")).alias("fp"), "all_pos", "all_neg")


def auroc(scores: DataFrame, p: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Chance that a positive scores above a negative, ties half; 0.5 if there is one class only."""
    keys = keys or []
    at = operating_counts(scores, p, y, keys)
    area = F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2
    found = at.withColumn("area", area).groupBy(*keys).agg(F.sum("area").alias("area"), F.max("all_pos").alias("a"), F.max("all_neg").alias("b"))
    return found.select(*keys, F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("area") / (F.col("a") * F.col("b"))).otherwise(0.5).alias("auroc"))


def fpr_at_tpr(scores: DataFrame, p: str, y: str, least: float = 0.9) -> DataFrame:
    """Least share of false positives at a threshold that finds the given share of positives; 1 if none does."""
    at = operating_counts(scores, p, y).where(F.col("tp") >= least * F.col("all_pos"))
    return at.agg(F.coalesce(F.min(F.try_divide(F.col("fp"), F.col("all_neg"))), F.lit(1.0)).alias("fpr"))


def confusion(pairs: DataFrame, truth: str, said: str, labels: list) -> DataFrame:
    """Counts for every pair of labels, 0 included."""
    every = pairs.sparkSession.createDataFrame([(x,) for x in labels], f"label {dict(pairs.dtypes)[truth]}")
    grid = every.select(F.col("label").alias(truth)).crossJoin(F.broadcast(every.select(F.col("label").alias(said))))
    counts = pairs.groupBy(truth, said).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(counts, [truth, said], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def exact_mean(value: str) -> Column:
    """The mean of doubles summed up as the decimals they are written as, so that it is the same in any order of the rows and a mean
    at a limit isn't beyond it. Where a number of the group doesn't fit such a decimal (infinite, not a number, very large or very
    small), the plain mean."""
    x = F.col(value)
    written = x.try_cast("decimal(38,18)")
    fit = F.count_if(~written.cast("double").eqNullSafe(x)) == 0
    return F.coalesce(F.when(fit, F.try_avg(written).cast("double")), F.avg(x))


def latency_summary(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """n, mean, standard deviation of the population, and exact quartiles by interpolation, of finite values."""
    x = F.col(value)
    there = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    quartiles = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = there.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), quartiles.alias("q"))
    return found.select(*(keys or []), "n", "mean", "std", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))


def mahalanobis(df: DataFrame, keys: list[str], measures: list[str], name: str = "d2", ridge: float = 1e-6, fitted_on: Column | None = None) -> DataFrame:
    """Adds the squared distance from the series' mean in the sample covariance of its measures, plus a ridge on the diagonal. The
    mean and covariance are summed up by series, over the rows that fitted_on selects, and only they meet the rows."""
    pairs = [(i, j) for i in range(len(measures)) for j in range(i, len(measures))]
    rows = df if fitted_on is None else df.where(fitted_on)
    found = rows.groupBy(*keys).agg(F.array(*[F.avg(m) for m in measures]).alias("__mean"), F.array(*[F.coalesce(F.covar_samp(measures[i], measures[j]), F.lit(0.0)) for i, j in pairs]).alias("__cov"))

    @F.pandas_udf("array<double>")
    def inverse(cov: pd.Series) -> pd.Series:
        def one(c: np.ndarray) -> list[float]:
            full = np.zeros((len(measures), len(measures)))
            for (i, j), v in zip(pairs, c, strict=True):
                full[i, j] = full[j, i] = v
            return np.linalg.inv(full + ridge * np.eye(len(measures))).ravel().tolist()

        return cov.map(one)

    fitted = found.select(*keys, "__mean", inverse("__cov").alias("__inverse"))
    away = [F.col(m) - F.col("__mean")[i] for i, m in enumerate(measures)]
    d2 = sum((F.col("__inverse")[i * len(measures) + j] * away[i] * away[j] for i in range(len(measures)) for j in range(len(measures))), F.lit(0.0))
    return df.join(fitted, keys).withColumn(name, d2).drop("__mean", "__inverse") if keys else df.crossJoin(F.broadcast(fitted)).withColumn(name, d2).drop("__mean", "__inverse")


def folds(df: DataFrame, label: str, key: str, k: int, seed: int) -> Column:
    """Stratified folds by a seeded hash of the key."""
    order = Window.partitionBy(label).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return F.pmod(F.row_number().over(order) - 1, F.lit(k))
