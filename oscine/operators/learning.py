"""Classifiers over feature columns, and resampling statistics."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def balanced(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weights that make every class count alike."""
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    total, classes = df.count(), counts.count()
    return df.join(F.broadcast(counts), label).withColumn(name, F.lit(float(total)) / (classes * F.col("__n"))).drop("__n")


def forest(df: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 6, leaf: int = 3, seed: int = 42):
    """A fitted pipeline of a random forest with balanced classes; labels are numbers from 0."""
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    model = RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)
    return Pipeline(stages=[assembler, model]).fit(balanced(df, label))


def predicted(model, df: DataFrame) -> DataFrame:
    """Adds p, the probabilities, label_hat and confidence."""
    p = vector_to_array("probability")
    scored = model.transform(df).withColumn("p", p)
    return scored.withColumn("label_hat", F.col("prediction").cast("int")).withColumn("confidence", F.array_max("p")).drop("features", "rawPrediction", "probability", "prediction")


def cross_validated(df: DataFrame, features: list[str], label: str, fold: str, **options) -> DataFrame:
    """Every row scored by a forest that was fitted on the other folds."""
    out = None
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        part = predicted(forest(df.where(F.col(fold) != k), features, label, **options), df.where(F.col(fold) == k))
        out = part if out is None else out.unionByName(part)
    return out


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, map(float, model.stages[-1].featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, rounds: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Mean and its percentile interval. Every row counts in each round as often as a Poisson number says that is hashed from the
    row's key and the round, so that groups of any size are summed up where they are."""
    from oscine.sources.synthetic import uniform

    chances, p, total = [], math.exp(-1), 0.0
    for k in range(8):
        total += p
        chances.append(total)
        p /= k + 1
    means = []
    for k in range(rounds):  # all rounds in one pass: two sums each, where the rows are
        u = uniform(seed, k, *[F.col(c) for c in df.columns])
        times = sum((F.when(u > c, 1).otherwise(0) for c in chances), F.lit(0))
        means.append(F.sum(F.col(value) * times) / F.nullif(F.sum(times), F.lit(0)))
    found = df.groupBy(*keys).agg(F.array(*means).alias("__means"))
    at = F.array_sort(F.filter("__means", lambda x: x.isNotNull()))

    def percentile(share: float) -> Column:
        place = (F.size("__sorted") - 1) * share
        low = F.floor(place).cast("int")
        a, b = F.element_at("__sorted", low + 1), F.element_at("__sorted", F.least(low + 2, F.size("__sorted")))
        return a + (b - a) * (place - low)

    bounds = found.withColumn("__sorted", at).select(*keys, percentile((1 - level) / 2).alias("low"), percentile((1 + level) / 2).alias("high"))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).join(bounds, keys)


def signed_rank_p(n: int, w: float) -> float:
    """Two-sided exact chance of a Wilcoxon signed-rank sum as far out as w, without ties."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for k in range(1, n + 1):
        ways[k:] += ways[:-k].copy()
    w = min(w, n * (n + 1) / 2 - w)
    return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2**n))


def wilcoxon(df: DataFrame, keys: list[str], difference: str, least: int = 6) -> DataFrame:
    """n, w, p and effect of each group's differences. Differences are counted by size before they are ranked; only the sums go
    to the exact table, or to the normal curve beyond 50 and where sizes are tied, whose spread ties make smaller."""
    there = df.where(F.col(difference) != 0).groupBy(*keys, F.abs(difference).alias("__size")).agg(F.count("*").alias("__t"), F.count_if(F.col(difference) > 0).alias("__up"))
    order = Window.partitionBy(*keys).orderBy("__size").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.sum("__t").over(order) - (F.col("__t") - 1) / 2
    t = F.col("__t").cast("double")
    sums = there.withColumn("__rank", rank).groupBy(*keys).agg(F.sum("__t").alias("n"), F.sum(F.col("__up") * F.col("__rank")).alias("w"), F.sum(t * t * t - t).alias("__ties"))

    @F.pandas_udf("double")
    def chance(n: pd.Series, w: pd.Series, ties: pd.Series) -> pd.Series:
        def one(k: int, x: float, tied: float) -> float | None:
            if k < least:
                return None
            if k <= 50 and not tied:
                return signed_rank_p(k, x)
            z = (x - k * (k + 1) / 4) / math.sqrt((k * (k + 1) * (2 * k + 1) - tied / 2) / 24)
            return 2 * (1 - NormalDist().cdf(abs(z)))

        return pd.Series([one(int(a), float(b), float(c)) for a, b, c in zip(n, w, ties, strict=True)])

    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        return p.map(lambda x: None if x is None or x != x else abs(NormalDist().inv_cdf(min(max(x / 2, 1e-300), 0.5))), na_action=None)

    tested = sums.withColumn("p", chance("n", "w", "__ties")).drop("__ties")
    return tested.withColumn("effect", quantile("p") / F.sqrt("n"))


def save(model: PipelineModel, path: str) -> None:
    """A fitted pipeline, so that it can be loaded by any session; what is there already is replaced."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def guarded(work, *arguments) -> tuple[str, str, object]:
    """status, reason, result of a stage that must not stop the others."""
    try:
        return "ok", "", work(*arguments)
    except Exception as problem:
        return "skipped", f"{type(problem).__name__}: {problem}"[:200], None

