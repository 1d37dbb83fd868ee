"""Detectors and classifiers under shifted data."""

from __future__ import annotations

from pyspark.sql import functions as F

from oscine.operators import learning, shifts
from oscine.plans.base import DAILY_SQL, daily_rms, rounded, table

SEVERITIES = [0.3, 0.6, 0.9]
ONSET = 15


def _after(change):
    """A change of the daily RMS from the onset on."""
    return lambda s: {"rms": F.when(F.col("day") >= ONSET, change(s)).otherwise(F.col("rms"))}


TRACE_SHIFTS = {
    "gain": _after(lambda s: F.col("rms") * (1 + s)), "suppression": _after(lambda s: F.col("rms") * (1 - s * 0.8)), "drift": _after(lambda s: F.col("rms") * (1 + s * (F.col("day") - ONSET) / ONSET)),
    "offset": lambda s: {"rms": F.col("rms") + 20 * s},
}


def shift_detection(spark, sf_dir):
    """The CUSUM detector on the channels' daily RMS under every shift."""
    found = shifts.detected(daily_rms(spark, sf_dir), ["channel"], "day", "rms", TRACE_SHIFTS, SEVERITIES, 8, 0.5, 5.0)
    return rounded(found, "latency", "confidence", "low", "high")


FEATURES = ["words", "symbols", "capitals", "lines", "repeats", "word_size"]


def text_rows(spark, sf_dir):
    """doc_id, features and quality of the labelled documents."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, size = F.greatest(F.size(words), F.lit(1)), F.greatest(F.length(text), F.lit(1))
    measured = table(spark, sf_dir, "documents").select(
        "doc_id", F.ln(n.cast("double")).alias("words"), (F.regexp_count(text, F.lit("[#*$%&|<>]")) / size).alias("symbols"), (F.regexp_count(text, F.lit("[A-Z]")) / size).alias("capitals"),
        (F.regexp_count(text, F.lit("\n")) / n).alias("lines"), (1 - F.size(F.array_distinct(words)) / n).alias("repeats"), (size / n).alias("word_size"),
    )
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return measured.join(labels, "doc_id")


TEXT_SHIFTS = {
    "shouting": lambda s: {"capitals": F.col("capitals") + s * (0.6 - F.col("capitals"))}, "noise": lambda s: {"symbols": F.col("symbols") + s * 0.1 * F.pmod(F.xxhash64("doc_id"), F.lit(101)) / 100},
    "cut": lambda s: {"words": F.col("words") + F.ln(1.0001 - s)}, "unbroken": lambda s: {"lines": F.col("lines") * (1 - s), "word_size": F.col("word_size") * (1 + s)},
}


def quality_model(spark, sf_dir):
    """A forest fitted on half of the labelled documents, by hash, and the other half."""
    rows = text_rows(spark, sf_dir).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)))
    return learning.forest(rows.where("half = 0").drop("half"), FEATURES, "quality", trees=30, depth=5), rows.where("half = 1").drop("half")


def shift_suite(spark, sf_dir):
    """The classifier of text quality under every shift, fitted once."""
    model, held_out = quality_model(spark, sf_dir)
    return rounded(shifts.evaluated(model, held_out, "quality", TEXT_SHIFTS, SEVERITIES), "accuracy", "auroc", "fpr_at_tpr", "ece")


def shift_table(spark, sf_dir):
    """The shifts' AUROC by severity, beside that of no shift."""
    model, held_out = quality_model(spark, sf_dir)
    found = shifts.pivoted(shifts.evaluated(model, held_out, "quality", TEXT_SHIFTS, SEVERITIES), "auroc", SEVERITIES)
    return rounded(found, *[c for c in found.columns if c != "shift"])


SQL = {
    "shift_detection": f"""WITH {DAILY_SQL}, grid(shift, severity) AS (SELECT 'none', 0.0::DOUBLE UNION ALL SELECT s, v::DOUBLE FROM (VALUES ('gain'), ('suppression'), ('drift'), ('offset')) a(s), (VALUES (0.3), (0.6), (0.9)) b(v)),
        t AS (SELECT channel, shift, severity, day, CASE WHEN shift = 'offset' THEN rms + 20 * severity WHEN day < 15 OR shift = 'none' THEN rms WHEN shift = 'gain' THEN rms * (1 + severity)
          WHEN shift = 'suppression' THEN rms * (1 - severity * 0.8::DOUBLE) ELSE rms * (1 + severity * (day - 15) / 15) END AS rms FROM daily, grid),
        b AS (SELECT channel, shift, severity, avg(rms) AS mean, stddev_pop(rms) AS spread FROM t WHERE day < 8 GROUP BY ALL),
        z AS (SELECT t.*, CASE WHEN day = 0 THEN 0 ELSE (rms - mean) / spread - 0.5 END AS up, CASE WHEN day = 0 THEN 0 ELSE (mean - rms) / spread - 0.5 END AS down FROM t JOIN b USING (channel, shift, severity)),
        r AS (SELECT *, sum(up) OVER w AS u, sum(down) OVER w AS d FROM z WINDOW w AS (PARTITION BY channel, shift, severity ORDER BY day)),
        c AS (SELECT *, greatest(u - least(0, min(u) OVER w), d - least(0, min(d) OVER w)) AS stat FROM r WINDOW w AS (PARTITION BY channel, shift, severity ORDER BY day)),
        a AS (SELECT channel, shift, severity, min(day) FILTER (day >= 8 AND stat > 5) AS alarm, coalesce(arg_min(stat, day) FILTER (day >= 8 AND stat > 5), max(stat)) AS confidence FROM c GROUP BY ALL),
        s AS (SELECT shift, severity, count(*) AS series, count(alarm) AS alarms, avg(alarm - 8) AS latency, max(confidence) AS confidence FROM a GROUP BY ALL),
        w AS (SELECT *, alarms / series AS p, 1.96::DOUBLE ** 2 / series AS k FROM s)
        SELECT shift, severity, series, alarms, round(latency, 6) + 0.0 AS latency, round(confidence, 6) + 0.0 AS confidence, round(greatest(0, (p + k / 2 - sqrt(p * (1 - p) * k + k * k / 4)) / (1 + k)), 6) + 0.0 AS low,
          round(least(1, (p + k / 2 + sqrt(p * (1 - p) * k + k * k / 4)) / (1 + k)), 6) + 0.0 AS high FROM w""",
}
QUERIES = {f.__name__: f for f in (shift_detection, shift_suite, shift_table)}
