"""Windows, features and scalar functions over the event samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from oscine.functions import scalars as S
from oscine.operators import windowing as W
from oscine.plans.base import DAILY_SQL, MICROS_SQL, SAMPLES_SQL, daily_rms, rounded, samples, seconds, table


def tumbling_rms(spark, sf_dir):
    return rounded(daily_rms(spark, sf_dir), "rms")


def sliding_rms(spark, sf_dir):
    return rounded(W.sliding(samples(spark, sf_dir), ["channel"], "day", 4, 2, rms=W.rms("uv")), "rms")


def channel_feature_agg(spark, sf_dir):
    s = samples(spark, sf_dir)
    found = s.groupBy("channel").agg(
        F.count("*").alias("n"), W.rms("uv").alias("rms"), F.avg("uv").alias("mean"), F.stddev_pop("uv").alias("std"),
        F.kurtosis("uv").alias("kurtosis"), F.max(F.abs("uv")).alias("peak"),
    )
    return rounded(found, "rms", "mean", "std", "kurtosis", "peak")


def window_features(spark, sf_dir):
    return rounded(W.over_channels(daily_rms(spark, sf_dir), ["day"], "rms"), "mean", "std", "max", "cv")


def pooled_rms(spark, sf_dir):
    return rounded(W.tumbling(samples(spark, sf_dir), [], "day", rms=W.rms("uv")), "rms")


def epoch_metrics(spark, sf_dir):
    bounds = spark.createDataFrame([("baseline", 2, 10), ("perturbed", 12, 20), ("recovery", 22, 30)], "epoch string, lo long, hi long")
    found = W.epochs(samples(spark, sf_dir), bounds, "day").groupBy("channel", "epoch").agg(F.count("*").alias("n"), W.rms("uv").alias("rms"), F.avg(S.clipped(F.col("uv") * 20)).alias("clip"))
    return rounded(found, "rms", "clip")


def adc_quantise(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("code", S.uv_to_adc(F.col("uv") * 20 - 3000))
    return rounded(s.select("event_id", "code", S.adc_to_uv("code").alias("back"), S.offset_binary_to_uv("code").alias("offset_uv")), "back", "offset_uv", digits=3)


def clip_fraction(spark, sf_dir):
    found = samples(spark, sf_dir).groupBy("channel", "day").agg(F.avg(S.clipped(F.col("uv") * 40)).alias("clip_fraction"), (F.max(F.abs(F.col("uv") * 40)) > 6000).alias("any_large"))
    return rounded(found, "clip_fraction")


def lerp(spark, sf_dir):
    x = (F.col("l_discount") * 12 - 0.1).alias("severity")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", x)
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", S.lerp(2.0, 9.0, "severity").alias("level"), S.lerp_int(1, 10, "severity").alias("level_int")), "level")


def moving_average(spark, sf_dir):
    trace = daily_rms(spark, sf_dir)
    return rounded(trace.select("channel", "day", W.moving_average(trace, ["channel"], ["day"], "rms", 5).alias("smooth")), "smooth")


def robust_threshold(spark, sf_dir):
    return rounded(W.robust_spread(samples(spark, sf_dir), ["channel"], "uv"), "median", "sigma")


def contiguous_clusters(spark, sf_dir):
    trace = daily_rms(spark, sf_dir)
    top = trace.groupBy("channel").agg(F.avg("rms").alias("mean"))
    return W.clusters(trace.join(top, "channel").where("rms > mean"), ["channel"], "day")


def cooldown_alerts(spark, sf_dir):
    return W.dead_time(samples(spark, sf_dir).where("uv > 60").withColumn("t", seconds()), ["user_id"], "t", 2 * 86_400_000_000, "day")


def refractory_rate(spark, sf_dir):
    kept = W.dead_time(samples(spark, sf_dir).where("uv > 100").withColumn("t", seconds()), ["channel"], "t", 3_600_000_000, "day")
    return rounded(kept.groupBy("channel").agg(F.count("*").alias("spikes"), (F.count("*") / 720.0).alias("rate_per_hour")), "rate_per_hour")


def edge_crossings(spark, sf_dir):
    """Falling below a threshold: this sample is below it and the one before was not."""
    crossed = W.previous(samples(spark, sf_dir), ["channel"], "day", ["ts", "event_id"], "uv", "before").where("uv < 5 AND before >= 5")
    return crossed.groupBy("channel", "day").agg(F.count("*").alias("crossings"))


def crosstalk_db(spark, sf_dir):
    power = samples(spark, sf_dir).groupBy("channel").agg(F.avg(F.col("uv") * F.col("uv")).alias("power"))
    source = power.where("channel = 'click'").select(F.col("power").alias("reference"))
    return rounded(power.crossJoin(F.broadcast(source)).select("channel", S.isolation_db(F.col("power"), F.col("reference")).alias("isolation_db")), "isolation_db")


def pairwise_corr(spark, sf_dir):
    d = daily_rms(spark, sf_dir).select("channel", "day", "rms")
    other = d.select(F.col("channel").alias("channel_b"), "day", F.col("rms").alias("rms_b"))
    both = d.join(other, "day").where("channel < channel_b")
    spread = F.nullif(F.stddev_pop("rms") * F.stddev_pop("rms_b"), F.lit(0.0))
    return rounded(both.groupBy("channel", "channel_b").agg(F.count("*").alias("n"), (F.covar_pop("rms", "rms_b") / spread).alias("corr")), "corr")


def standard_scaler(spark, sf_dir):
    d = daily_rms(spark, sf_dir)
    fitted = d.groupBy("channel").agg(F.avg("rms").alias("mean"), F.stddev_pop("rms").alias("std"))
    scaled = d.join(F.broadcast(fitted), "channel").select("channel", "day", F.when(F.col("std") > 0, (F.col("rms") - F.col("mean")) / F.col("std")).otherwise(0.0).alias("scaled"))
    return rounded(scaled, "scaled")


def mixing_matrix(spark, sf_dir):
    """Coupling x + M x over channels at each window, by a join with the rows of the matrix."""
    d = daily_rms(spark, sf_dir).select("channel", "day", "rms")
    matrix = spark.createDataFrame([("click", "view", 0.1), ("click", "error", 0.05), ("view", "signup", 0.2)], "channel string, source string, gain double")
    leak = matrix.join(d.select(F.col("channel").alias("source"), "day", F.col("rms").alias("src")), "source").groupBy("channel", "day").agg(F.sum(F.col("gain") * F.col("src")).alias("leak"))
    return rounded(d.join(leak, ["channel", "day"], "left").select("channel", "day", (F.col("rms") + F.coalesce("leak", F.lit(0.0))).alias("mixed")), "mixed")


def dataset_summary(spark, sf_dir):
    counts = samples(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return counts.crossJoin(counts.agg(F.min("n").alias("least"), F.sum("n").alias("total")))


_ROUND = "round({}, 6) + 0.0"
SQL = {
    "tumbling_rms": f"WITH {DAILY_SQL} SELECT channel, day, n, round(rms, 6) AS rms FROM daily",
    "sliding_rms": f"""WITH {SAMPLES_SQL}, last AS (SELECT channel, max(day) AS last FROM samples GROUP BY 1),
        w AS (SELECT channel, unnest(range(0, (last - 3) // 2 + 1)) AS window_idx FROM last)
        SELECT s.channel, w.window_idx, count(*) AS n, round(sqrt(avg(uv * uv)), 6) AS rms FROM samples s JOIN w ON w.channel = s.channel
        AND s.day BETWEEN w.window_idx * 2 AND w.window_idx * 2 + 3 GROUP BY 1, 2""",
    "channel_feature_agg": f"""WITH {SAMPLES_SQL} SELECT channel, count(*) AS n, round(sqrt(avg(uv * uv)), 6) AS rms, round(avg(uv), 6) AS mean,
        round(stddev_pop(uv), 6) AS std, round(kurtosis_pop(uv), 6) AS kurtosis, round(max(abs(uv)), 6) AS peak FROM samples GROUP BY 1""",
    "window_features": f"""WITH {DAILY_SQL} SELECT day, round(avg(rms), 6) AS mean, round(stddev_pop(rms), 6) AS std, round(max(rms), 6) AS max,
        round(CASE WHEN abs(avg(rms)) > 1e-12 THEN stddev_pop(rms) / abs(avg(rms)) ELSE 0 END, 6) AS cv FROM daily GROUP BY 1""",
    "pooled_rms": f"WITH {SAMPLES_SQL} SELECT day, count(*) AS n, round(sqrt(avg(uv * uv)), 6) AS rms FROM samples GROUP BY 1",
    "epoch_metrics": f"""WITH {SAMPLES_SQL}, e(epoch, lo, hi) AS (VALUES ('baseline', 2, 10), ('perturbed', 12, 20), ('recovery', 22, 30))
        SELECT channel, epoch, count(*) AS n, round(sqrt(avg(uv * uv)), 6) AS rms, round(avg(CASE WHEN abs(uv * 20) > 0.95 * 6400.0 THEN 1.0 ELSE 0.0 END), 6) AS clip
        FROM samples JOIN e ON day >= lo AND day < hi GROUP BY 1, 2""",
    "adc_quantise": f"""WITH {SAMPLES_SQL}, c AS (SELECT event_id, CAST(greatest(-32768, least(32767, round_even((uv * 20 - 3000) / 0.195, 0))) AS INTEGER) AS code FROM samples)
        SELECT event_id, code, round(code * 0.195::DOUBLE, 3) + 0.0 AS back, round((code - 32768) * 0.195::DOUBLE, 3) + 0.0 AS offset_uv FROM c""",
    "clip_fraction": f"""WITH {SAMPLES_SQL} SELECT channel, day, round(avg(CASE WHEN abs(uv * 40) > 0.95 * 6400.0 THEN 1.0 ELSE 0.0 END), 6) AS clip_fraction,
        max(abs(uv * 40)) > 6000 AS any_large FROM samples GROUP BY 1, 2""",
    "lerp": """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, least(1.0, greatest(0.0, l_discount * 12 - 0.1)) AS x FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, round(2.0::DOUBLE + 7.0::DOUBLE * x, 6) + 0.0 AS level, CAST(round_even(1.0::DOUBLE + 9 * x, 0) AS INTEGER) AS level_int FROM s""",
    "moving_average": f"WITH {DAILY_SQL} SELECT channel, day, round(avg(rms) OVER (PARTITION BY channel ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM daily",
    "robust_threshold": f"""WITH {SAMPLES_SQL}, m AS (SELECT channel, median(uv) AS median FROM samples GROUP BY 1)
        SELECT channel, round(any_value(median), 6) AS median, round(median(abs(uv - median)) * 1.4826, 6) AS sigma FROM samples JOIN m USING (channel) GROUP BY 1""",
    "contiguous_clusters": f"""WITH {DAILY_SQL}, h AS (SELECT channel, day FROM (SELECT *, avg(rms) OVER (PARTITION BY channel) AS mean FROM daily) WHERE rms > mean),
        g AS (SELECT *, day - row_number() OVER (PARTITION BY channel ORDER BY day) AS grp FROM h),
        c AS (SELECT channel, grp, min(day) AS first, max(day) AS last, count(*) AS n FROM g GROUP BY 1, 2)
        SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY first) - 1 AS cluster, first, last, n FROM c""",
    "cooldown_alerts": f"""WITH RECURSIVE a AS (SELECT user_id, {MICROS_SQL} AS t FROM events WHERE value > 60),
        k AS (SELECT user_id, min(t) AS t FROM a GROUP BY 1 UNION ALL
        SELECT user_id, t FROM (SELECT k.user_id, min(a.t) AS t FROM k JOIN a ON a.user_id = k.user_id AND a.t >= k.t + 172800000000 GROUP BY k.user_id))
        SELECT user_id, t FROM k""",
    "refractory_rate": f"""WITH RECURSIVE a AS (SELECT event_type AS channel, {MICROS_SQL} AS t FROM events WHERE value > 100),
        k AS (SELECT channel, min(t) AS t FROM a GROUP BY 1 UNION ALL
        SELECT channel, t FROM (SELECT k.channel, min(a.t) AS t FROM k JOIN a ON a.channel = k.channel AND a.t >= k.t + 3600000000 GROUP BY k.channel))
        SELECT channel, count(*) AS spikes, round(count(*) / 720.0, 6) AS rate_per_hour FROM k GROUP BY 1""",
    "edge_crossings": f"""WITH {SAMPLES_SQL}, b AS (SELECT *, lag(uv) OVER (PARTITION BY channel ORDER BY ts, event_id) AS before FROM samples)
        SELECT channel, day, count(*) AS crossings FROM b WHERE uv < 5 AND before >= 5 GROUP BY 1, 2""",
    "crosstalk_db": f"""WITH {SAMPLES_SQL}, p AS (SELECT channel, avg(uv * uv) AS power FROM samples GROUP BY 1)
        SELECT channel, round(10 * log10(power / (SELECT power FROM p WHERE channel = 'click')), 6) + 0.0 AS isolation_db FROM p""",
    "pairwise_corr": f"""WITH {DAILY_SQL} SELECT a.channel, b.channel AS channel_b, count(*) AS n, round(covar_pop(a.rms, b.rms) / nullif(stddev_pop(a.rms) * stddev_pop(b.rms), 0), 6) + 0.0 AS corr
        FROM daily a JOIN daily b ON a.day = b.day AND a.channel < b.channel GROUP BY 1, 2""",
    "standard_scaler": f"""WITH {DAILY_SQL}, f AS (SELECT channel, avg(rms) AS mean, stddev_pop(rms) AS std FROM daily GROUP BY 1)
        SELECT channel, day, round(CASE WHEN std > 0 THEN (rms - mean) / std ELSE 0 END, 6) + 0.0 AS scaled FROM daily JOIN f USING (channel)""",
    "mixing_matrix": f"""WITH {DAILY_SQL}, m(channel, source, gain) AS (VALUES ('click', 'view', 0.1::DOUBLE), ('click', 'error', 0.05::DOUBLE), ('view', 'signup', 0.2::DOUBLE)),
        l AS (SELECT m.channel, d.day, sum(gain * rms) AS leak FROM m JOIN daily d ON d.channel = m.source GROUP BY 1, 2)
        SELECT d.channel, d.day, round(rms + coalesce(leak, 0), 6) AS mixed FROM daily d LEFT JOIN l ON l.channel = d.channel AND l.day = d.day""",
    "dataset_summary": f"""WITH {SAMPLES_SQL}, c AS (SELECT channel, count(*) AS n, count(DISTINCT user_id) AS users FROM samples GROUP BY 1)
        SELECT channel, n, users, (SELECT min(n) FROM c) AS least, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS total FROM c""",
}
QUERIES = {k: globals()[k] for k in SQL}
