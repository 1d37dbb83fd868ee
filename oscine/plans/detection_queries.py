"""Change detection over the daily RMS of the event channels, and checks of frame order."""

from __future__ import annotations

from pyspark.sql import functions as F

from oscine.operators import detection as D
from oscine.plans.base import DAILY_SQL, MICROS_SQL, daily_rms, rounded, samples, seconds

BASELINE, DRIFT, THRESHOLD = 8, 0.5, 3.0
KEYS = ["channel"]


def _scored(spark, sf_dir):
    return D.baseline_z(daily_rms(spark, sf_dir), KEYS, "day", "rms", BASELINE)


def _traced(spark, sf_dir):
    return D.cusum(_scored(spark, sf_dir), KEYS, "day", DRIFT)


def baseline_z(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select("channel", "day", "z"), "z")


def cusum_trace(spark, sf_dir):
    return rounded(_traced(spark, sf_dir).select("channel", "day", "rms", "cusum"), "rms", "cusum")


def cusum_alarm(spark, sf_dir):
    return rounded(D.first_alarm(_traced(spark, sf_dir), KEYS, "day", "cusum", THRESHOLD, BASELINE), "confidence")


def zscore_runs(spark, sf_dir):
    return rounded(D.runs_above(_scored(spark, sf_dir), KEYS, "day", 1.0, 2, BASELINE), "z_at_start")


def detect_perturbation(spark, sf_dir):
    found = D.runs_above(_scored(spark, sf_dir), KEYS, "day", 0.5, 3, BASELINE)
    return rounded(found.select("channel", F.col("start").isNotNull().alias("detected"), "start", "z_at_start"), "z_at_start")


def detect_change(spark, sf_dir):
    """Both methods as rows, with the latency from an onset at the end of the baseline."""
    by_cusum = D.first_alarm(_traced(spark, sf_dir), KEYS, "day", "cusum", THRESHOLD, BASELINE).select("channel", F.lit("cusum").alias("method"), F.col("alarm").alias("onset"))
    by_z = D.runs_above(_scored(spark, sf_dir), KEYS, "day", 1.0, 2, BASELINE).select("channel", F.lit("zscore").alias("method"), F.col("start").alias("onset"))
    return by_cusum.unionByName(by_z).withColumn("latency", F.col("onset") - BASELINE)


def hysteresis_alerts(spark, sf_dir):
    return rounded(D.latched(_traced(spark, sf_dir), KEYS, "day", "cusum", 2.0).select("channel", "day", "cusum"), "cusum")


def _probable(spark, sf_dir):
    return _scored(spark, sf_dir).withColumn("p", F.abs("z") / (1 + F.abs("z"))).withColumn("valid", F.abs("z") < 4)


def k_of_n(spark, sf_dir):
    marked = D.confirmed(_probable(spark, sf_dir), KEYS, "day", "p", F.col("valid"), 2, 3, 0.5)
    return rounded(marked.select("channel", "day", "confirmed", "last_p"), "last_p")


def triage(spark, sf_dir):
    marked = D.confirmed(_probable(spark, sf_dir), KEYS, "day", "p", F.col("valid"), 2, 3, 0.5)
    label = D.triage(~F.col("valid"), F.col("confirmed"), F.col("p"), 0.55, 0.25)
    return marked.select("channel", "day", label.alias("label"))


def numbers():
    """Blocks of numbers, in which the rows of a series are put in order."""
    return F.floor(F.col("event_id") / 65536)


def frame_gaps(spark, sf_dir):
    frames = samples(spark, sf_dir)
    found = D.gaps(frames, KEYS, ["ts", "event_id"], "event_id", "day")
    return found.groupBy("channel").agg(F.count("*").alias("frames"), F.sum("dropped").alias("dropped"), F.max("dropped").alias("worst"))


def ts_violations(spark, sf_dir):
    frames = samples(spark, sf_dir).withColumns({"t": F.pmod(seconds(), F.lit(1 << 32)), "block": numbers()})
    found = D.backward_steps(frames, ["user_id"], ["event_id"], "t", "block")
    return found.groupBy("user_id").agg(F.count("*").alias("frames"), F.sum(F.col("violation").cast("long")).alias("violations"))


def capture_stats(spark, sf_dir):
    """Counts, first and last number and time of a capture, and what follows from them."""
    frames = D.gaps(samples(spark, sf_dir).withColumns({"t": seconds(), "block": numbers()}), ["channel"], ["event_id"], "event_id", "block")
    found = frames.groupBy("channel").agg(F.count("*").alias("frames"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.min_by("t", "event_id").alias("first_t"), F.max_by("t", "event_id").alias("last_t"), F.sum("dropped").alias("dropped"))
    duration = (F.col("last_t") - F.col("first_t")) / 1e6
    found = found.withColumn("drop_rate", F.col("dropped") / (F.col("dropped") + F.col("frames"))).withColumn("throughput", F.when(duration > 0, F.col("frames") * 256 / duration).otherwise(0.0))
    return rounded(found, "drop_rate", "throughput")


Z_SQL = f"""{DAILY_SQL}, base AS (SELECT channel, avg(rms) AS mean, stddev_pop(rms) AS std FROM daily WHERE day < {BASELINE} GROUP BY 1),
    scored AS (SELECT channel, day, rms, CASE WHEN std >= 1e-15 THEN (rms - mean) / std END AS z FROM daily JOIN base USING (channel))"""
C_SQL = f"""{Z_SQL}, x AS (SELECT *, CASE WHEN day = 0 THEN 0 ELSE coalesce(z, 0) - {DRIFT} END AS u, CASE WHEN day = 0 THEN 0 ELSE -coalesce(z, 0) - {DRIFT} END AS d FROM scored),
    p AS (SELECT *, sum(u) OVER w AS pu, sum(d) OVER w AS pd FROM x WINDOW w AS (PARTITION BY channel ORDER BY day)),
    traced AS (SELECT channel, day, rms, z, greatest(pu - least(0, min(pu) OVER w), pd - least(0, min(pd) OVER w)) AS cusum FROM p WINDOW w AS (PARTITION BY channel ORDER BY day))"""
ALARM_SQL = f"""alarm AS (SELECT channel, min(day) FILTER (day >= {BASELINE} AND cusum > {THRESHOLD}) AS alarm, max(cusum) AS top FROM traced GROUP BY 1)"""


def _run_sql(threshold: float, n: int) -> str:
    return f"""flagged AS (SELECT *, sum(CASE WHEN abs(z) > {threshold} THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c FROM scored),
    runs AS (SELECT channel, min(day) FILTER (c = {n} AND day >= {BASELINE + n - 1}) - {n - 1} AS start FROM flagged GROUP BY 1)"""


K_SQL = f"""{Z_SQL}, pr AS (SELECT *, abs(z) / (1 + abs(z)) AS p, abs(z) < 4 AS valid FROM scored),
    conf AS (SELECT *, sum(CASE WHEN valid AND p >= 0.5 THEN 1 ELSE 0 END) OVER w >= 2 AS confirmed, last_value(CASE WHEN valid THEN p END IGNORE NULLS) OVER w AS last_p FROM pr
    WINDOW w AS (PARTITION BY channel ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))"""
SQL = {
    "baseline_z": f"WITH {Z_SQL} SELECT channel, day, round(z, 6) + 0.0 AS z FROM scored",
    "cusum_trace": f"WITH {C_SQL} SELECT channel, day, round(rms, 6) AS rms, round(cusum, 6) + 0.0 AS cusum FROM traced",
    "cusum_alarm": f"WITH {C_SQL}, {ALARM_SQL} SELECT a.channel, a.alarm, round(coalesce(t.cusum, top), 6) + 0.0 AS confidence FROM alarm a LEFT JOIN traced t ON t.channel = a.channel AND t.day = a.alarm",
    "zscore_runs": f"WITH {Z_SQL}, {_run_sql(1.0, 2)} SELECT r.channel, r.start, round(s.z, 6) + 0.0 AS z_at_start FROM runs r LEFT JOIN scored s ON s.channel = r.channel AND s.day = r.start",
    "detect_perturbation": f"WITH {Z_SQL}, {_run_sql(0.5, 3)} SELECT r.channel, r.start IS NOT NULL AS detected, r.start, round(s.z, 6) + 0.0 AS z_at_start FROM runs r LEFT JOIN scored s ON s.channel = r.channel AND s.day = r.start",
    "detect_change": f"""WITH {C_SQL}, {ALARM_SQL}, {_run_sql(1.0, 2)}
        SELECT channel, 'cusum' AS method, alarm AS onset, alarm - {BASELINE} AS latency FROM alarm UNION ALL SELECT channel, 'zscore', start, start - {BASELINE} FROM runs""",
    "hysteresis_alerts": f"""WITH {C_SQL}, e AS (SELECT *, CASE WHEN cusum > 2.0 THEN 1 WHEN cusum <= 1.0 THEN 0 END AS ev FROM traced),
        l AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY channel ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
        SELECT channel, day, round(cusum, 6) AS cusum FROM l WHERE ev = 1 AND coalesce(before, 0) <> 1""",
    "k_of_n": f"WITH {K_SQL} SELECT channel, day, confirmed, round(last_p, 6) + 0.0 AS last_p FROM conf",
    "triage": f"""WITH {K_SQL} SELECT channel, day, CASE WHEN NOT valid THEN 'unknown' WHEN confirmed AND p >= 0.55 THEN 'suppression-like' WHEN p <= 0.25 THEN 'artifact-like' ELSE 'uncertain' END AS label FROM conf""",
    "frame_gaps": """WITH f AS (SELECT event_type AS channel, event_id - lag(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step FROM events)
        SELECT channel, count(*) AS frames, CAST(sum(CASE WHEN step > 1 THEN step - 1 ELSE 0 END) AS BIGINT) AS dropped, max(CASE WHEN step > 1 THEN step - 1 ELSE 0 END) AS worst FROM f GROUP BY 1""",
    "ts_violations": f"""WITH f AS (SELECT user_id, event_id, {MICROS_SQL} % 4294967296 AS t FROM events),
        g AS (SELECT user_id, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) - t AS back FROM f)
        SELECT user_id, count(*) AS frames, CAST(sum(CASE WHEN back > 0 AND back <= 2147483648 THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM g GROUP BY 1""",
    "capture_stats": f"""WITH f AS (SELECT event_type AS channel, event_id, {MICROS_SQL} AS t, event_id - lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS step FROM events),
        g AS (SELECT channel, count(*) AS frames, min(event_id) AS first_id, max(event_id) AS last_id, min_by(t, event_id) AS first_t, max_by(t, event_id) AS last_t,
        CAST(sum(CASE WHEN step > 1 THEN step - 1 ELSE 0 END) AS BIGINT) AS dropped FROM f GROUP BY 1)
        SELECT *, round(dropped / (dropped + frames), 6) AS drop_rate, round(CASE WHEN last_t > first_t THEN frames * 256 / ((last_t - first_t) / 1e6) ELSE 0 END, 6) AS throughput FROM g""",
}
QUERIES = {k: globals()[k] for k in SQL}
