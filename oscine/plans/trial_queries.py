"""Trials over the driver's tables: feature vectors of windows, epochs about an onset, and statistics of groups of trials. A user is
a recording; its event types are channels and its events, in order, the samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oscine.functions import scalars as S
from oscine.operators import evaluation as E
from oscine.operators import features as V
from oscine.operators import learning
from oscine.operators import statistics as T
from oscine.operators import windowing as W
from oscine.plans.base import SAMPLES_SQL, rounded, samples, table

FS = 640.0
#: Days: when the baseline begins, the onset, what is left out after it, the length of the perturbed epoch, the recovery's first and last day after the onset.
BASELINE_FROM, ONSET, SETTLE, EPOCH, RECOVERY_FROM, RECOVERY_TO = 2, 12, 2, 8, 12, 17


def _windows(spark, sf_dir):
    """Four vectors in a row are the channels of a window, sixteen a recording of four windows."""
    e = table(spark, sf_dir, "embeddings")
    place = {"recording_id": F.floor(F.col("vec_id") / 16), "window_idx": F.floor(F.pmod("vec_id", F.lit(16)) / 4), "channel": F.pmod("vec_id", F.lit(4))}
    return e.select(*[v.cast("long").alias(k) for k, v in place.items()], F.transform("embedding", lambda x: x.cast("double") * 1000).alias("values"))


def feature_vector(spark, sf_dir):
    """The 23 features of each window."""
    return rounded(V.feature_vectors(_windows(spark, sf_dir), ["recording_id", "window_idx"], FS), *V.NAMES)


def trial_features(spark, sf_dir):
    """The mean of each feature from the third window on, one row for each recording."""
    vectors = V.feature_vectors(_windows(spark, sf_dir), ["recording_id", "window_idx"], FS)
    return rounded(V.trial_rows(vectors, ["recording_id"], 2, 10), *V.NAMES)


def _epochs(spark, sf_dir):
    """RMS of each recording's baseline, perturbed and recovery epochs. Where a recording ends before the recovery begins, the
    baseline stands for it."""
    s = samples(spark, sf_dir)
    last = s.groupBy("user_id").agg((F.max("day") + 1).alias("end"))
    bounds = last.select(
        "user_id", "end", F.lit(BASELINE_FROM).alias("b0"), F.lit(ONSET).alias("b1"), F.lit(ONSET + SETTLE).alias("p0"), F.least(F.lit(ONSET + SETTLE + EPOCH), "end").alias("p1"),
        F.when(F.col("end") > ONSET + RECOVERY_FROM, F.lit(ONSET + RECOVERY_FROM)).otherwise(F.least(F.lit(ONSET + SETTLE + EPOCH), "end")).alias("r0"), F.least(F.lit(ONSET + RECOVERY_TO), "end").alias("r1"),
    )
    square = F.col("uv") * F.col("uv")

    def of(lo: str, hi: str) -> F.Column:
        return F.sqrt(F.avg(F.when((F.col("day") >= F.col(lo)) & (F.col("day") < F.col(hi)), square)))

    found = s.join(bounds, "user_id").groupBy("user_id", "end", "p0", "p1", "r0", "r1").agg(of("b0", "b1").alias("rms_baseline"), of("p0", "p1").alias("rms_perturbed"), of("r0", "r1").alias("rms_later"), F.max(F.abs("uv")).alias("peak"))
    return found.select(
        "user_id", "rms_baseline", "rms_perturbed", F.when(F.col("r1") > F.col("r0"), F.col("rms_later")).otherwise(F.col("rms_baseline")).alias("rms_recovery"),
        (F.col("p1") - F.col("p0") < 5).alias("short_epoch"), (F.col("peak") > 150).alias("clipping"),
    )


def epoch_from_onset(spark, sf_dir):
    return rounded(_epochs(spark, sf_dir), "rms_baseline", "rms_perturbed", "rms_recovery")


def _trials(spark, sf_dir):
    """Each recording as a trial: its group, the ratio of its epochs, and when its daily RMS is first above a threshold after the onset."""
    e = _epochs(spark, sf_dir).where("rms_baseline > 0 AND rms_perturbed IS NOT NULL")
    daily = W.tumbling(samples(spark, sf_dir), ["user_id"], "day", rms=W.rms("uv"))
    alarm = daily.join(e.select("user_id", "rms_baseline"), "user_id").where((F.col("day") >= ONSET) & (F.col("rms") > 1.5 * F.col("rms_baseline")))
    first = alarm.groupBy("user_id").agg((F.min("day") - ONSET).alias("latency"))
    return e.join(first, "user_id", "left").select(
        F.pmod("user_id", F.lit(3)).alias("level"), "user_id", "rms_baseline", "rms_perturbed", (F.col("rms_perturbed") / F.col("rms_baseline")).alias("ratio"), F.col("latency").isNotNull().alias("detected"), "latency",
    )


def group_stats(spark, sf_dir):
    """Detection rate and its interval, latency, and ratio of the trials of each level."""
    low, high = S.wilson(F.col("k"), F.col("n"))
    edges = F.percentile("latency", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = _trials(spark, sf_dir).groupBy("level").agg(
        F.count("*").alias("n"), F.count_if("detected").alias("k"), edges.alias("q"), F.avg("ratio").alias("ratio_mean"), F.stddev_pop("ratio").alias("ratio_std"),
    )
    found = found.select("level", "n", (F.col("k") / F.col("n")).alias("rate"), low.alias("rate_low"), high.alias("rate_high"), F.col("q")[0].alias("latency_q25"), F.col("q")[1].alias("latency_median"), F.col("q")[2].alias("latency_q75"), "ratio_mean", "ratio_std")
    return rounded(found, "rate", "rate_low", "rate_high", "latency_q25", "latency_median", "latency_q75", "ratio_mean", "ratio_std")


def group_tests(spark, sf_dir):
    """Signed-rank test of each level's baseline against its perturbed epochs."""
    apart = _trials(spark, sf_dir).select("level", F.round(F.col("rms_perturbed") - F.col("rms_baseline"), 9).alias("d"))
    return rounded(learning.wilcoxon(apart, ["level"], "d"), "p", "effect")


def false_alarms(spark, sf_dir):
    """Of daily alarms above a threshold by level of it: those before the onset are false; latency of the first one from it on."""
    daily = W.tumbling(samples(spark, sf_dir), ["channel"], "day", rms=W.rms("uv"))
    grid = spark.createDataFrame([(float(x),) for x in (20, 25, 28, 30, 32, 40)], "threshold double")
    hits = daily.crossJoin(F.broadcast(grid)).where("rms > threshold")
    after = F.when(F.col("day") >= ONSET, F.col("day") - ONSET)
    found = hits.groupBy("channel", "threshold").agg(F.count_if(F.col("day") < ONSET).alias("false_alarms"), F.count_if(F.col("day") >= ONSET).alias("hits"), F.min(after).alias("latency"))
    return found.withColumn("false_rate", F.round(F.col("false_alarms") / ONSET, 6))


def second_stage(spark, sf_dir):
    """A costlier measure, the share of large samples, only on the days about an alarm of the first stage."""
    s = samples(spark, sf_dir)
    daily = W.tumbling(s, ["channel"], "day", rms=W.rms("uv"))
    level = daily.groupBy("channel").agg(F.avg("rms").alias("mean"))
    alarms = daily.join(F.broadcast(level), "channel").where(F.col("rms") > 1.1 * F.col("mean")).select("channel", F.explode(F.array(F.col("day") - 1, F.col("day"), F.col("day") + 1)).alias("day")).distinct()
    found = s.join(F.broadcast(alarms), ["channel", "day"]).groupBy("channel", "day").agg(F.count("*").alias("n"), F.avg((F.col("uv") > 60).cast("double")).alias("share"))
    return rounded(found, "share")


def macro_auroc(spark, sf_dir):
    """One class against the rest, averaged over the classes that have both sides."""
    c = table(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_acctbal").alias("balance"))
    span = c.agg(F.min("balance").alias("lo"), F.max("balance").alias("hi"))
    scored = c.crossJoin(F.broadcast(span)).select("c_mktsegment", F.round((F.col("balance") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)), 3).cast("double").alias("p"))
    classes = c.select(F.col("c_mktsegment").alias("class")).distinct()
    rest = scored.crossJoin(F.broadcast(classes)).select("class", "p", (F.col("c_mktsegment") == F.col("class")).cast("int").alias("y"))
    return rounded(T.auroc(rest, "p", "y", ["class"]).agg(F.avg("auroc").alias("macro"), F.count("*").alias("classes")), "macro")


def mad_mask(spark, sf_dir):
    """Days whose RMS is beyond four sigmas by the median distance, widened by a day on either side, as clusters."""
    daily = W.tumbling(samples(spark, sf_dir), ["channel"], "day", rms=W.rms("uv"))
    spread = W.robust_spread(daily, ["channel"], "rms")
    hit = (F.abs(F.col("rms") - F.col("median")) > 1.5 * F.col("sigma")).cast("int")
    near = Window.partitionBy("channel").orderBy("day").rangeBetween(-1, 1)
    marked = daily.join(spread, "channel").withColumn("hit", F.max(hit).over(near))
    return W.clusters(marked.where("hit = 1"), ["channel"], "day")


def release_gates(spark, sf_dir):
    """Gates over the order tables: references that lead nowhere, keys that come twice, numbers out of their range."""
    t = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "customer", "nation", "region", "supplier")}
    lines = t["lineitem"]
    return E.gates({
        "orders_have_customers": t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "customers_have_orders": t["customer"].join(t["orders"], F.col("c_custkey") == F.col("o_custkey"), "left_anti"),
        "lines_have_orders": lines.join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "nations_have_regions": t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"), "left_anti"),
        "lines_are_distinct": lines.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1"),
        "quantities_are_positive": lines.where("l_quantity <= 0"),
        "discounts_are_small": lines.where("l_discount > 0.09"),
        "suppliers_have_balance": t["supplier"].where("s_acctbal < 0"),
    })


def longest_of(spark, sf_dir):
    """The line that was longest under way of each order priority, the least key if several were."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    top = both.groupBy("o_orderpriority").agg(F.max(F.struct(days.alias("days"), (-F.col("l_orderkey")).alias("o"), (-F.col("l_linenumber")).alias("l"))).alias("t"))
    return top.select("o_orderpriority", F.col("t.days").cast("long").alias("days"), (-F.col("t.o")).alias("l_orderkey"), (-F.col("t.l")).cast("long").alias("l_linenumber"))


def model_comparison(spark, sf_dir):
    """Two scores of the same documents against their label, side by side for each language."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "quality", F.col("n_chars").cast("double").alias("n"), "doc_id")
    top = d.agg(F.max("n").alias("top"))
    scored = d.crossJoin(F.broadcast(top)).select("lang", "quality", (F.col("n") / (F.col("top") + 1)).alias("size"), (F.pmod("doc_id", F.lit(97)) / 97.0).alias("chance"))
    results = {name: T.auroc(scored.where("lang IS NOT NULL"), name, "quality", ["lang"]) for name in ("size", "chance")}
    return rounded(E.side_by_side(results, "auroc", ["lang"]), "auroc", "behind")


_EPOCH = f"""{SAMPLES_SQL}, b AS (SELECT user_id, max(day) + 1 AS e FROM samples GROUP BY 1),
    bounds AS (SELECT user_id, {BASELINE_FROM} AS b0, {ONSET} AS b1, {ONSET + SETTLE} AS p0, least({ONSET + SETTLE + EPOCH}, e) AS p1,
        CASE WHEN e > {ONSET + RECOVERY_FROM} THEN {ONSET + RECOVERY_FROM} ELSE least({ONSET + SETTLE + EPOCH}, e) END AS r0, least({ONSET + RECOVERY_TO}, e) AS r1 FROM b),
    ep AS (SELECT s.user_id, sqrt(avg(uv * uv) FILTER (day >= b0 AND day < b1)) AS rms_baseline, sqrt(avg(uv * uv) FILTER (day >= p0 AND day < p1)) AS rms_perturbed,
        sqrt(avg(uv * uv) FILTER (day >= r0 AND day < r1)) AS later, max(abs(uv)) AS peak, any_value(p0) AS p0, any_value(p1) AS p1, any_value(r0) AS r0, any_value(r1) AS r1
        FROM samples s JOIN bounds USING (user_id) GROUP BY 1)"""
_TRIALS = f"""{_EPOCH}, e AS (SELECT * FROM ep WHERE rms_baseline > 0 AND rms_perturbed IS NOT NULL),
    d AS (SELECT user_id, day, sqrt(avg(uv * uv)) AS rms FROM samples GROUP BY 1, 2),
    f AS (SELECT user_id, min(day) - {ONSET} AS latency FROM d JOIN e USING (user_id) WHERE day >= {ONSET} AND rms > 1.5 * rms_baseline GROUP BY 1),
    trials AS (SELECT user_id % 3 AS level, rms_perturbed / rms_baseline AS ratio, latency FROM e LEFT JOIN f USING (user_id))"""
_DAYS = f"{SAMPLES_SQL}, daily AS (SELECT channel, day, sqrt(avg(uv * uv)) AS rms FROM samples GROUP BY 1, 2)"
SQL = {
    "epoch_from_onset": f"""WITH {_EPOCH} SELECT user_id, round(rms_baseline, 6) AS rms_baseline, round(rms_perturbed, 6) AS rms_perturbed,
        round(CASE WHEN r1 > r0 THEN later ELSE rms_baseline END, 6) AS rms_recovery, p1 - p0 < 5 AS short_epoch, peak > 150 AS clipping FROM ep""",
    "group_stats": f"""WITH {_TRIALS}, g AS (SELECT level, count(*) AS n, count(latency) AS k, quantile_cont(latency, 0.25) AS q25, quantile_cont(latency, 0.5) AS q50, quantile_cont(latency, 0.75) AS q75,
        avg(ratio) AS rm, stddev_pop(ratio) AS rs FROM trials GROUP BY 1), w AS (SELECT *, k / n AS p, 1.96 AS z FROM g),
        c AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS mid, z * sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n) AS half FROM w)
        SELECT level, n, round(p, 6) AS rate, round(greatest(0, mid - half), 6) + 0.0 AS rate_low, round(least(1, mid + half), 6) AS rate_high, round(q25, 6) AS latency_q25, round(q50, 6) AS latency_median,
        round(q75, 6) AS latency_q75, round(rm, 6) AS ratio_mean, round(rs, 6) AS ratio_std FROM c""",
    "false_alarms": f"""WITH {_DAYS}, t(threshold) AS (VALUES (20.0::DOUBLE), (25.0), (28.0), (30.0), (32.0), (40.0)), h AS (SELECT * FROM daily, t WHERE rms > threshold)
        SELECT channel, threshold, count(*) FILTER (day < {ONSET}) AS false_alarms, count(*) FILTER (day >= {ONSET}) AS hits, min(day - {ONSET}) FILTER (day >= {ONSET}) AS latency,
        round(count(*) FILTER (day < {ONSET}) / {ONSET}, 6) AS false_rate FROM h GROUP BY 1, 2""",
    "second_stage": f"""WITH {_DAYS}, m AS (SELECT channel, avg(rms) AS mean FROM daily GROUP BY 1), a AS (SELECT DISTINCT channel, unnest([day - 1, day, day + 1]) AS day FROM daily JOIN m USING (channel) WHERE rms > 1.1 * mean)
        SELECT channel, day, count(*) AS n, round(avg(CASE WHEN uv > 60 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share FROM samples JOIN a USING (channel, day) GROUP BY 1, 2""",
    "macro_auroc": """WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), p AS (SELECT c_mktsegment AS k, round(CAST((c_acctbal - lo) / nullif(hi - lo, 0) AS DOUBLE), 3) AS p FROM customer, s),
        g AS (SELECT k, p, count(*) AS n FROM p GROUP BY 1, 2), pair AS (SELECT a.k, sum(a.n * b.n * CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) / sum(a.n * b.n) AS auroc FROM g a JOIN g b ON a.k <> b.k GROUP BY 1)
        SELECT round(avg(auroc), 6) AS macro, count(*) AS classes FROM pair""",
    "release_gates": """SELECT *, offenders = 0 AS passed FROM (
        SELECT 'orders_have_customers' AS gate, count(*) AS offenders FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL
        SELECT 'customers_have_orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
        SELECT 'lines_have_orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL
        SELECT 'nations_have_regions', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region) UNION ALL
        SELECT 'lines_are_distinct', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL
        SELECT 'quantities_are_positive', count(*) FROM lineitem WHERE l_quantity <= 0 UNION ALL
        SELECT 'discounts_are_small', count(*) FROM lineitem WHERE l_discount > 0.09 UNION ALL
        SELECT 'suppliers_have_balance', count(*) FROM supplier WHERE s_acctbal < 0)""",
    "longest_of": """WITH d AS (SELECT o_orderpriority, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY days DESC, l_orderkey, l_linenumber) AS k FROM d)
        SELECT o_orderpriority, days, l_orderkey, l_linenumber FROM r WHERE k = 1""",
    "model_comparison": """WITH d AS (SELECT lang, quality, n_chars / (max(n_chars) OVER () + 1.0) AS size, (doc_id % 97) / 97.0 AS chance FROM documents JOIN labels USING (doc_id)),
        s AS (SELECT 'size' AS model, lang, quality, CAST(size AS DOUBLE) AS p FROM d UNION ALL SELECT 'chance', lang, quality, CAST(chance AS DOUBLE) FROM d),
        a AS (SELECT model, lang, p, count(*) AS n FROM s WHERE quality = 1 GROUP BY ALL), b AS (SELECT model, lang, p, count(*) AS n FROM s WHERE quality = 0 GROUP BY ALL),
        g AS (SELECT DISTINCT model, lang FROM s WHERE lang IS NOT NULL), x AS (SELECT a.model, a.lang, sum(a.n * b.n * CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) / sum(a.n * b.n) AS auroc FROM a JOIN b USING (model, lang) GROUP BY 1, 2),
        r AS (SELECT model, lang, coalesce(auroc, 0.5) AS auroc FROM g LEFT JOIN x USING (model, lang))
        SELECT lang, round(auroc, 6) AS auroc, model, row_number() OVER w AS place, round(first_value(auroc) OVER w - auroc, 6) + 0.0 AS behind FROM r WINDOW w AS (PARTITION BY lang ORDER BY auroc DESC, model)""",
    "mad_mask": f"""WITH {_DAYS}, m AS (SELECT channel, median(rms) AS med FROM daily GROUP BY 1), s AS (SELECT channel, any_value(med) AS med, median(abs(rms - med)) * 1.4826 AS sigma FROM daily JOIN m USING (channel) GROUP BY 1),
        h AS (SELECT channel, day, max(CASE WHEN abs(rms - med) > 1.5 * sigma THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY day RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS hit FROM daily JOIN s USING (channel)),
        g AS (SELECT *, day - row_number() OVER (PARTITION BY channel ORDER BY day) AS grp FROM h WHERE hit = 1), c AS (SELECT channel, grp, min(day) AS first, max(day) AS last, count(*) AS n FROM g GROUP BY 1, 2)
        SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY first) - 1 AS cluster, first, last, n FROM c""",
}
QUERIES = {f.__name__: f for f in (feature_vector, trial_features, epoch_from_onset, group_stats, group_tests, false_alarms, second_stage, macro_auroc, mad_mask, release_gates, longest_of, model_comparison)}
