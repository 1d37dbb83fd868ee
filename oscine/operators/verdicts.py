"""What detectors and reports amount to: alerts with reasons, methods side by side, and reports against ceilings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oscine.operators import detection


def with_reasons(scored: DataFrame, probabilities: str, names: list[str], positive: list[str], least: float = 0.5) -> DataFrame:
    """Adds reason_code (the likeliest name, of equal ones the first), reason_probs (all by name), p_positive (the sum of the positive
    names'), binary_label and confidence (the probability of the label). Null probabilities give nulls."""
    p = F.col(probabilities)
    labels = F.array(*[F.lit(n) for n in names])
    chosen = F.when(p.isNotNull(), F.element_at(labels, F.array_position(p, F.array_max(p)).cast("int")))
    each = [F.coalesce(p[i], F.lit(0.0)) for i, n in enumerate(names) if n in positive]
    total = F.when(p.isNotNull(), sum(each, F.lit(0.0)))
    label = F.when(total >= least, "positive").when(total < least, "negative")
    return scored.withColumns(
        {"reason_code": chosen, "reason_probs": F.map_from_arrays(labels, p), "p_positive": total, "binary_label": label, "confidence": F.greatest(total, 1 - total)}
    )


def false_suppressions(triaged: DataFrame, truth: str, label: str, artifacts: list[str], said: str = "suppression-like") -> DataFrame:
    """The rows of artifacts that triage calls suppressions."""
    return triaged.where(F.col(truth).isin(artifacts) & (F.col(label) == said))


def perturbed(trace: DataFrame, keys: list[str], order: str, value: str, baseline_s: float, window_s: float, threshold: float) -> DataFrame:
    """keys, detected, start and z_at_start: whether three windows in a row lie beyond the threshold, after a baseline of at least
    three windows, however short it is in seconds."""
    baseline = max(3, int(baseline_s / window_s))
    scored = detection.baseline_z(trace, keys, order, value, baseline)
    return detection.runs_above(scored, keys, order, threshold, 3, baseline).select(*keys, F.col("start").isNotNull().alias("detected"), "start", "z_at_start")


def ablation(found: dict[str, DataFrame], truth: DataFrame, keys: list[str], changed: str, label: str) -> DataFrame:
    """method, n, correct, accuracy, sensitivity and false_share of detectors (keys, detected) on series of which truth says
    whether they changed, beside a row of always guessing the most frequent label."""
    out = None
    for method, detected in found.items():
        both = truth.join(detected.select(*keys, "detected"), keys, "left").withColumn("said", F.coalesce("detected", F.lit(False)))
        hit = F.col("said") == F.col(changed)
        part = both.agg(
            F.count("*").alias("n"), F.count_if(hit).alias("correct"), F.try_divide(F.count_if(F.col("said") & F.col(changed)), F.count_if(changed)).alias("sensitivity"),
            F.try_divide(F.count_if(F.col("said") & ~F.col(changed)), F.count_if(~F.col(changed))).alias("false_share"),
        ).select(F.lit(method).alias("method"), "n", "correct", "sensitivity", "false_share")
        out = part if out is None else out.union(part)
    counts = truth.groupBy(label).agg(F.count("*").alias("c"))
    guess = counts.agg(F.sum("c").alias("n"), F.max("c").alias("correct")).select(F.lit("majority").alias("method"), "n", "correct", F.lit(None).cast("double"), F.lit(None).cast("double"))
    every = guess if out is None else out.union(guess)
    return every.withColumn("accuracy", F.try_divide("correct", "n"))


def against_ceilings(entries: DataFrame, bucket: str, ceilings: dict[str, int], otherwise: int = 0) -> DataFrame:
    """bucket, found, ceiling and over of each bucket of a report, each against its own ceiling, so that none hides another; what
    has no ceiling of its own is summed up in the bucket "residual". Buckets with a ceiling and no entry are there with 0."""
    known = F.create_map(*[F.lit(x) for pair in ceilings.items() for x in pair]) if ceilings else F.create_map().cast("map<string,int>")
    name = F.when(F.try_element_at(known, F.col(bucket).cast("string")).isNotNull(), F.col(bucket).cast("string")).otherwise("residual")
    counted = entries.groupBy(name.alias("bucket")).agg(F.count("*").alias("found"))
    limits = entries.sparkSession.createDataFrame([*ceilings.items(), ("residual", otherwise)], "bucket string, ceiling long")  # as many as ceilings
    both = limits.join(counted, "bucket", "left")
    return both.select("bucket", F.coalesce("found", F.lit(0)).alias("found"), "ceiling").withColumn("over", F.col("found") > F.col("ceiling"))


def nth(elements: DataFrame, group: str, order: list[Column | str], n: int) -> DataFrame:
    """The element with number n, from 0, of each group."""
    return elements.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).where(F.col("__n") == n).drop("__n")


def without(elements: DataFrame, id: str, gone: list[str]) -> DataFrame:
    """All elements but those named, as if they had been taken off the board."""
    return elements.where(~F.col(id).isin(gone))
