"""Queries that SQL can't express or whose input is generated: sources, filters, classifiers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscine.operators import detection, dsp, learning, scratch, spectral
from oscine.operators import statistics as T
from oscine.operators import windowing as W
from oscine.plans.base import DAILY_SQL, START, rounded, samples, seconds, table
from oscine.sources import frames, synthetic
from oscine.streaming import detector
from oscine.streaming import sweep as sweeps

#: Samples a day, and samples of a block.
FS, SIZE = 24.0, 120


def _built(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("device"), F.col("event_id").alias("frame_id"), (F.col("event_id") * 50).alias("timestamp"))
    codes = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda c: F.pmod(c * 977 + F.col("frame_id") * 131, F.lit(65536)) - 32768)
    return frames.build(rows.withColumn("adc", codes))


def frame_roundtrip(spark, sf_dir):
    """Records built from rows and decoded again: what is valid, and whether the codes came back."""
    decoded = frames.decode(_built(spark, sf_dir).withColumnsRenamed({"frame_id": "sent_id", "adc": "sent"}).drop("timestamp"))
    same = (F.col("sent_id") == F.col("frame_id")) & (F.col("sent").cast("array<int>") == F.col("adc").cast("array<int>"))
    return decoded.groupBy("device", "crc_valid", "reserved_clean", "sample_rate").agg(F.count("*").alias("n"), F.sum(same.cast("long")).alias("same"))


def synthetic_recording(spark, sf_dir):
    s = synthetic.recordings(spark, "full", 2, 4, 2000.0, 2.0, seed=11)
    return rounded(s.groupBy("recording_id", "channel").agg(F.count("*").alias("n"), W.rms("uv").alias("rms"), F.min("uv").alias("least")), "rms", "least")


def disturbances(spark, sf_dir):
    """The effect of every disturbance on the RMS of the same recording."""
    out = None
    base = synthetic.recordings(spark, "baseline", 1, 4, 2000.0, 1.0, seed=3)
    for name in sorted(synthetic.DISTURBANCES):
        part = synthetic.disturb(base, name, 0.8, 5, 2000.0, 2000).groupBy("channel").agg(W.rms("uv").alias("rms")).withColumn("name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "rms")


def hourly(spark, sf_dir):
    """channel, hour, uv: the mean of each hour up to the last block's end, 0 where there is none."""
    hour = F.floor(seconds() / 3_600_000_000)
    means = samples(spark, sf_dir).groupBy("channel", hour.alias("hour")).agg(F.avg("uv").alias("uv"))
    last = (means.agg(F.max("hour")).first()[0] or 0) // SIZE * SIZE + SIZE - 1
    every = means.select("channel").distinct().select("channel", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("hour"))
    return every.join(means, ["channel", "hour"], "left").fillna(0.0, ["uv"])


def _blocks(spark, sf_dir):
    return dsp.to_blocks(hourly(spark, sf_dir), ["channel"], "hour", "uv", SIZE)


def highpass_rms(spark, sf_dir):
    """What is faster than two days, by blocks of five days."""
    b = dsp.filtered(_blocks(spark, sf_dir), ["channel"], "values", 2, 0.5, "high", FS, SIZE)
    power = F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x) / F.size("values")
    return rounded(b.select("channel", "block_idx", F.sqrt(power).alias("rms")), "rms")


def bandpass_crosstalk(spark, sf_dir):
    """Isolation of each channel from the one of clicks, within a band about one cycle a day."""
    b = dsp.filtered(_blocks(spark, sf_dir), ["channel"], "values", 4, (0.8, 1.25), "band", FS, SIZE)
    power = F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x)
    per = b.groupBy("channel").agg(F.sum(power).alias("power"))
    source = per.where("channel = 'click'").select(F.col("power").alias("reference"))
    return rounded(per.crossJoin(F.broadcast(source)).select("channel", (10 * F.log10(F.col("power") / F.col("reference"))).alias("isolation_db")), "isolation_db")


def welch_features(spark, sf_dir):
    """Band power, edge and flatness of the Welch spectrum of each block, computed once."""
    psd = _blocks(spark, sf_dir).select("channel", "block_idx", F.posexplode(dsp.welch_psd(F.col("values"), FS, 48)).alias("bin", "power"))
    psd = psd.withColumn("hz", F.col("bin") * FS / 48)
    keys = ["channel", "block_idx"]
    found = spectral.bandpower(psd, keys, 0.5, 4, FS / 48).join(spectral.edge(psd, keys), keys).join(spectral.flatness(psd, keys, 2, 10), keys)
    return rounded(found, "bandpower", "flatness")


def resample_error(spark, sf_dir):
    """Energy that is lost on the way to a lower rate and back."""
    b = _blocks(spark, sf_dir).withColumn("back", dsp.resampled(dsp.resampled(F.col("values"), SIZE // 2), SIZE))
    lost = F.aggregate(F.zip_with("values", "back", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    return rounded(b.select("channel", "block_idx", (lost / SIZE).alias("lost")), "lost")


def _features(spark):
    data = synthetic.dataset(spark, ["line_noise", "partial_suppression", "broadband_noise"], [0.3, 0.6, 0.9], 4, channels=4, fs=1000.0, seconds=1.0)
    per = data.groupBy("name", "severity", "recording_id", "channel").agg(W.rms("uv").alias("rms"), F.kurtosis("uv").alias("kurtosis"), F.max(F.abs("uv")).alias("peak"))
    both = per.groupBy("name", "severity", "recording_id").agg(*[f(c).alias(f"{c}_{n}") for c in ("rms", "kurtosis", "peak") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    label = F.when(F.col("name") == "line_noise", 0).when(F.col("name") == "partial_suppression", 1).otherwise(2)
    keyed = both.withColumn("label", label.cast("double")).withColumn("key", F.concat_ws(":", "name", F.col("severity").cast("string"), F.col("recording_id").cast("string")))
    return keyed.withColumn("fold", T.folds(keyed, "label", "key", 3, 1))


def cause_classifier(spark, sf_dir):
    """Held-out predictions of a random forest over window features, as a confusion table."""
    rows = _features(spark).cache()
    names = [c for c in rows.columns if c.split("_")[0] in ("rms", "kurtosis", "peak")]
    scored = learning.cross_validated(rows, names, "label", "fold", trees=20, depth=5)
    out = T.confusion(scored.select(F.col("label").cast("int").alias("truth"), F.col("label_hat").alias("said")), "truth", "said", [0, 1, 2])
    return spark.createDataFrame(out.collect(), out.schema)  # nine rows


def bootstrap_ci(spark, sf_dir):
    rows = samples(spark, sf_dir).select("channel", "day", "event_id", "uv")
    return rounded(learning.bootstrap_mean(rows, ["channel"], "uv", 100), "mean", "low", "high")


def signed_rank(spark, sf_dir):
    """Daily RMS of each channel against the mean over channels."""
    daily = W.tumbling(samples(spark, sf_dir), ["channel"], "day", rms=W.rms("uv"))
    other = daily.groupBy("day").agg(F.avg("rms").alias("mean"))
    apart = daily.join(other, "day").select("channel", F.round(F.col("rms") - F.col("mean"), 9).alias("d"))
    return rounded(learning.wilcoxon(apart, ["channel"], "d"), "p", "effect")


def _in_slices(spark: SparkSession, source: DataFrame, build, time: str, slices: int = 4) -> DataFrame:
    """Runs a stream over a table, stretch of time by stretch, and gives the rows that it appended. A stretch is written by as many tasks
    as it takes, and the stream comes to its end before the next is there: the order in which files are finished, which the
    source goes by, then makes no row late."""
    root = scratch.folder(spark, "stream")
    at = F.unix_micros(time)
    cuts = source.agg(F.percentile_approx(at, F.array(*[F.lit(k / slices) for k in range(1, slices)]), 1000).alias("c")).first()["c"] or []
    bounds = sorted(set(cuts))
    for lo, hi in zip([None, *bounds], [*bounds, None], strict=True):
        inside = (F.lit(True) if lo is None else at > lo) & (F.lit(True) if hi is None else at <= hi)
        source.where(inside | at.isNull() if lo is None else inside).write.mode("append").parquet(f"{root}/in")
        out = build(spark.readStream.schema(source.schema).parquet(f"{root}/in"))
        writer = out.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).outputMode("append")
        writer.format("parquet").option("path", f"{root}/out").start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def _streamed(spark: SparkSession, source: DataFrame, build, mode: str, in_order: str | None = None) -> DataFrame:
    """Runs a stream over a table to its end, and gives the rows that it wrote."""
    root = scratch.folder(spark, "stream")
    if in_order is None:
        source.write.parquet(f"{root}/in")
    else:  # files that arrive one after the other, each with the rows of a stretch of time
        cuts = source.agg(F.percentile(F.col(in_order).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("c")).first()["c"]
        for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
            at = F.col(in_order).cast("double")
            part = source.where((F.lit(True) if lo is None else at > lo) & (F.lit(True) if hi is None else at <= hi))
            part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2 if in_order is None else 1).parquet(f"{root}/in")
    out = build(stream)
    writer = out.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if mode == "append":
        writer.outputMode("append").format("parquet").option("path", f"{root}/out").start().awaitTermination()
    else:
        schema = out.schema
        spark.createDataFrame([], schema.add("batch_id", "long")).write.partitionBy("batch_id").parquet(f"{root}/out")
        # a folder for each batch, so that a batch that runs again replaces what it wrote
        writer.outputMode(mode).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{root}/out/batch_id={k}")).start().awaitTermination()
        return spark.read.schema(schema).parquet(f"{root}/out")
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def streaming_rms(spark, sf_dir):
    rows = samples(spark, sf_dir).select("channel", F.col("ts").cast("timestamp").alias("ts"), "uv")
    found = _in_slices(spark, rows, lambda s: detector.windowed_rms(s, ["channel"], "ts", "uv"), "ts")
    day = F.datediff(F.col("start").cast("date"), F.lit(START).cast("date")).cast("long")
    return rounded(found.select("channel", day.alias("day"), "n", "rms"), "rms")


def streaming_cusum(spark, sf_dir):
    daily = W.tumbling(samples(spark, sf_dir), ["channel"], "day", rms=W.rms("uv"))
    rows = daily.select("channel", F.timestamp_seconds(F.col("day") * 86400).alias("end"), "rms")
    return rounded(_streamed(spark, rows, lambda s: detector.cusum_alerts(s, "channel", 8, 0.5, 3.0), "append", "end"), "statistic")


def streaming_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("device"), F.col("event_id").alias("frame_id"), (F.col("event_id") % 50 != 1).alias("crc_valid")).repartitionByRange(4, "frame_id")
    found = _streamed(spark, rows, lambda s: detector.frame_counters(s, "device"), "update")
    return found.groupBy("device").agg(F.max("seen").alias("seen"), F.max("bad").alias("bad"), F.max_by("dropped", "seen").alias("dropped"))  # gaps may fill later


THRESHOLDS, COOLDOWNS = (1.0, 2.0, 3.0, 5.0), (0, 3, 7)


def streaming_sweep(spark, sf_dir):
    """Alerts of a grid of thresholds and cooldowns on a stream whose files hold windows in no order."""
    daily = W.tumbling(samples(spark, sf_dir), ["channel"], "day", rms=W.rms("uv"))
    rows = daily.select("channel", F.col("day").alias("window_idx"), F.timestamp_seconds((F.col("day") + 1) * 86400).alias("end"), "rms").repartition(3, F.xxhash64("channel", "window_idx"))
    sweeps.rocksdb(spark)
    found = _streamed(spark, rows, lambda s: sweeps.sweep(s, "channel", THRESHOLDS, COOLDOWNS, 8, 0.5, "400 days"), "append")
    return rounded(found.select("channel", "threshold", "cooldown", F.col("window_idx").alias("day"), "statistic"), "statistic")


def batch_sweep(spark, sf_dir):
    """The same grid over the whole trace."""
    daily = W.tumbling(samples(spark, sf_dir), ["channel"], "day", rms=W.rms("uv"))
    scored = detection.baseline_z(daily, ["channel"], "day", "rms", 8).where("day >= 8").withColumn("day", F.col("day") - 7)
    trace = detection.cusum(scored, ["channel"], "day", 0.5).withColumn("day", F.col("day") + 7)
    return rounded(detection.sweep(trace, ["channel"], "day", "cusum", THRESHOLDS, COOLDOWNS).withColumnRenamed("cusum", "statistic"), "statistic")


def bounded_counters(spark, sf_dir):
    """Counts of each device's frames with gaps settled after 2,000 numbers."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("device"), F.col("event_id").alias("frame_id"), (F.col("event_id") % 50 != 1).alias("crc_valid"))
    sweeps.rocksdb(spark)
    found = _streamed(spark, rows, lambda s: sweeps.bounded_counters(s, "device", 2000), "update", "frame_id")
    return found.groupBy("device").agg(F.max("seen").alias("seen"), F.max("bad").alias("bad"), F.max_by("dropped", "seen").alias("dropped"), F.max("late").alias("late"))


QUERIES = {f.__name__: f for f in (
    frame_roundtrip, synthetic_recording, disturbances, highpass_rms, bandpass_crosstalk, welch_features, resample_error, cause_classifier, bootstrap_ci, signed_rank,
    streaming_rms, streaming_cusum, streaming_counters, streaming_sweep, batch_sweep, bounded_counters,
)}
#: The CUSUM window by window, each threshold's latch, and each cooldown, as one recursion over days.
_SWEEP = f"""WITH RECURSIVE {DAILY_SQL}, b AS (SELECT channel, avg(rms) AS mean, stddev_pop(rms) AS spread FROM daily WHERE day < 8 GROUP BY 1),
    z AS (SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY day) AS k, day, CASE WHEN spread >= 1e-15 THEN (rms - mean) / spread ELSE 0 END AS z FROM daily JOIN b USING (channel) WHERE day >= 8),
    g(threshold, cooldown) AS (SELECT t::DOUBLE, c::BIGINT FROM (VALUES (1), (2), (3), (5)) x(t), (VALUES (0), (3), (7)) y(c)),
    run AS (SELECT DISTINCT channel, threshold, cooldown, 0::BIGINT AS k, -1::BIGINT AS day, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, TRUE AS armed, NULL::BIGINT AS last, FALSE AS fired FROM z, g
      UNION ALL SELECT channel, threshold, cooldown, k, day, up, down, CASE WHEN top <= threshold / 2 THEN TRUE WHEN armed AND top > threshold THEN FALSE ELSE armed END,
        CASE WHEN ok THEN day ELSE last END, ok FROM (SELECT *, armed AND top > threshold AND (last IS NULL OR day - last >= cooldown) AS ok FROM (SELECT *, greatest(up, down) AS top FROM
        (SELECT r.channel, r.threshold, r.cooldown, z.k, z.day, greatest(0, r.up + z.z - 0.5) AS up, greatest(0, r.down - z.z - 0.5) AS down, r.armed, r.last FROM run r JOIN z ON z.channel = r.channel AND z.k = r.k + 1))))
    SELECT channel, threshold, cooldown, day, round(greatest(up, down), 6) AS statistic FROM run WHERE fired"""
SQL = {
    "streaming_sweep": _SWEEP,
    "batch_sweep": _SWEEP,
    "bounded_counters": """WITH f AS (SELECT event_type AS device, event_id, event_id % 50 <> 1 AS good FROM events),
        g AS (SELECT device, event_id - lag(event_id) OVER (PARTITION BY device ORDER BY event_id) - 1 AS gap FROM f WHERE good),
        d AS (SELECT device, CAST(sum(greatest(gap, 0)) AS BIGINT) AS dropped FROM g GROUP BY 1)
        SELECT device, count(*) AS seen, count(*) FILTER (NOT good) AS bad, any_value(dropped) AS dropped, 0::BIGINT AS late FROM f JOIN d USING (device) GROUP BY 1""",
    # the last day stays open, as no later event closes it
    "streaming_rms": f"WITH {DAILY_SQL} SELECT channel, day, n, round(rms, 6) AS rms FROM daily WHERE day < (SELECT max(day) FROM daily)",
    "streaming_counters": """WITH f AS (SELECT event_type AS device, event_id, event_id % 50 <> 1 AS good FROM events),
        g AS (SELECT device, event_id - lag(event_id) OVER (PARTITION BY device ORDER BY event_id) - 1 AS gap FROM f WHERE good),
        d AS (SELECT device, CAST(sum(greatest(gap, 0)) AS BIGINT) AS dropped FROM g GROUP BY 1)
        SELECT device, count(*) AS seen, count(*) FILTER (NOT good) AS bad, any_value(dropped) AS dropped FROM f JOIN d USING (device) GROUP BY 1""",
}
