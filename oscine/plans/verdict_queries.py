"""Alerts with reasons, methods side by side, reports against ceilings, and captures written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from oscine.functions import scalars as S
from oscine.operators import detection, scratch, verdicts
from oscine.plans import detection_queries as D
from oscine.plans.base import daily_rms, rounded, table
from oscine.plans.generated_queries import _built
from oscine.sources import brackets, frames, sinks

KINDS = ("click", "error", "purchase", "signup", "view")


def reason_codes(spark, sf_dir):
    """Each user's likeliest kind of event, by a softmax over how often they have each."""
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in KINDS])
    p = S.softmax(F.array(*[F.col(k).cast("double") for k in KINDS]), 2.0)
    found = verdicts.with_reasons(counts.select("user_id", p.alias("p")), "p", list(KINDS), ["purchase", "signup"])
    return rounded(found.select("user_id", "reason_code", F.col("reason_probs")["error"].alias("p_error"), "p_positive", "binary_label", "confidence"), "p_error", "p_positive", "confidence")


def artifact_suppressions(spark, sf_dir):
    """Days of the channels called artifacts that triage calls suppressions."""
    marked = detection.confirmed(D._probable(spark, sf_dir), ["channel"], "day", "p", F.col("valid"), 2, 3, 0.5)
    label = detection.triage(~F.col("valid"), F.col("confirmed"), F.col("p"), 0.55, 0.25)
    return verdicts.false_suppressions(marked.select("channel", "day", label.alias("label")), "channel", "label", ["error", "view"])


def detector_ablation(spark, sf_dir):
    """Both detectors on the channels, of which three count as changed, beside guessing."""
    trace = daily_rms(spark, sf_dir)
    alarms = detection.first_alarm(D._traced(spark, sf_dir), ["channel"], "day", "cusum", 3.0, 8).select("channel", F.col("alarm").isNotNull().alias("detected"))
    runs = verdicts.perturbed(trace, ["channel"], "day", "rms", 8.0, 1.0, 0.5)
    short = verdicts.perturbed(trace, ["channel"], "day", "rms", 1.0, 1.0, 0.5)
    truth = trace.select("channel").distinct().withColumn("changed", F.col("channel").isin("error", "signup", "view")).withColumn("label", F.col("changed").cast("int"))
    return rounded(verdicts.ablation({"cusum": alarms, "zscore": runs, "zscore_short": short}, truth, ["channel"], "changed", "label"), "sensitivity", "false_share", "accuracy")


CEILINGS = {"1-URGENT": 3000, "2-HIGH": 10, "3-NONE": 5}


def bucket_ceilings(spark, sf_dir):
    """Orders by priority against ceilings, and the rest."""
    return verdicts.against_ceilings(table(spark, sf_dir, "orders"), "o_orderpriority", CEILINGS, 100)


def nth_lines(spark, sf_dir):
    """The third line of each order by part, without those of some suppliers."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_suppkey").alias("supplier"))
    return verdicts.nth(verdicts.without(lines, "supplier", ["3", "7"]), "l_orderkey", ["l_partkey"], 2)


def capture_roundtrip(spark, sf_dir):
    """The events as frames of capture files, read again in splits: number, two codes and whether the frame is whole."""
    folder = scratch.folder(spark, "captures")
    sinks.captures(_built(spark, sf_dir).select("raw", "frame_id"), folder, ["frame_id"])
    found = frames.decode(frames.read(spark, folder))
    return found.select("frame_id", "timestamp", F.col("adc")[3].cast("int").alias("code_3"), F.col("adc")[63].cast("int").alias("code_63"), (F.col("crc_valid") & F.col("reserved_clean")).alias("whole"))


def capture_counts(spark, sf_dir):
    """Counts of a whole capture in order of its files."""
    folder = scratch.folder(spark, "captures")
    sinks.captures(_built(spark, sf_dir).where("frame_id % 100 <> 7").select("raw", "frame_id"), folder, ["frame_id"])
    whole = frames.decode(frames.read(spark, folder)).withColumn("place", F.regexp_extract("source", r"part-(\d+)", 1).cast("long") * (1 << 40) + F.col("pos"))
    report = frames.capture_report(whole.withColumn("source", F.lit("capture")), "source", "place")
    return rounded(report.select("frames", "bad", "dropped", "time_violations", "first_id", "last_id", "drop_rate"), "drop_rate")


def bracket_edits(spark, sf_dir):
    """Customers with their orders as bracketed texts: elements of each before and after the urgent orders are taken out."""
    of_one = F.concat(F.lit("(order "), F.col("o_orderkey"), F.lit(' (state "('), "o_orderstatus", F.lit('\\" )") (rank '), F.substring("o_orderpriority", 1, 1), F.lit("))"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_list(of_one)), "\n ").alias("orders"))
    text = F.concat(F.lit("(customer "), F.col("c_custkey"), F.lit("\n "), F.coalesce("orders", F.lit("")), F.lit(")"))
    texts = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").select("c_custkey", text.alias("text"))
    found = brackets.tree(texts, "c_custkey", "text").withColumn("bytes", F.col("last") - F.col("first"))
    urgent = found.where("head = 'rank'").join(texts, "c_custkey").where(F.expr("substring(text, first + 1, bytes) = '(rank 1)'")).select("c_custkey", F.col("parent").alias("first"))
    gone = found.join(urgent, ["c_custkey", "first"])
    left = brackets.tree(brackets.without(texts, gone, "c_custkey", "text"), "c_custkey", "text")
    before = found.groupBy("c_custkey").agg(F.count("*").alias("elements"), F.max("depth").alias("depth"))
    after = left.groupBy("c_custkey").agg(F.count_if(F.col("head") == "order").alias("orders_left"), F.max("last").alias("bytes_left"))
    return before.join(after, "c_custkey")


def _code(channel: int) -> str:
    return f"(({channel} * 977 + event_id * 131) % 65536 - 32768)::INTEGER"


_KINDS = ", ".join(f"({i}, '{k}')" for i, k in enumerate(KINDS))
SQL = {
    "reason_codes": f"""WITH k(i, kind) AS (VALUES {_KINDS}), u AS (SELECT DISTINCT user_id FROM events), c AS (SELECT user_id, i, kind, count(e.event_id)::DOUBLE AS n FROM u CROSS JOIN k LEFT JOIN events e USING (user_id) WHERE e.event_type = kind OR e.event_id IS NULL GROUP BY ALL),
        f AS (SELECT u.user_id, k.i, k.kind, coalesce(c.n, 0) AS n FROM u CROSS JOIN k LEFT JOIN c ON c.user_id = u.user_id AND c.i = k.i),
        p AS (SELECT *, exp((n - max(n) OVER w) / 2) AS e FROM f WINDOW w AS (PARTITION BY user_id)), q AS (SELECT user_id, i, kind, e / sum(e) OVER (PARTITION BY user_id) AS p FROM p),
        s AS (SELECT user_id, arg_min(kind, (-p, i)) AS reason_code, max(p) FILTER (kind = 'error') AS p_error, sum(p) FILTER (kind IN ('purchase', 'signup')) AS t FROM q GROUP BY 1)
        SELECT user_id, reason_code, round(p_error, 6) + 0.0 AS p_error, round(t, 6) + 0.0 AS p_positive, CASE WHEN round(t, 12) >= 0.5 THEN 'positive' ELSE 'negative' END AS binary_label, round(greatest(t, 1 - t), 6) + 0.0 AS confidence FROM s""",
    "artifact_suppressions": f"""WITH {D.K_SQL} SELECT channel, day, 'suppression-like' AS label FROM conf WHERE valid AND confirmed AND p >= 0.55 AND channel IN ('error', 'view')""",
    "detector_ablation": f"""WITH {D.C_SQL}, {D.ALARM_SQL}, {D._run_sql(0.5, 3)}, b3 AS (SELECT channel, avg(rms) AS m, stddev_pop(rms) AS s FROM daily WHERE day < 3 GROUP BY 1),
        f3 AS (SELECT channel, day, sum((abs((rms - m) / s) > 0.5)::INTEGER) OVER (PARTITION BY channel ORDER BY day ROWS 2 PRECEDING) AS c FROM daily JOIN b3 USING (channel)),
        d AS (SELECT channel, 'cusum' AS method, alarm IS NOT NULL AS said FROM alarm UNION ALL SELECT channel, 'zscore', start IS NOT NULL FROM runs UNION ALL SELECT channel, 'zscore_short', bool_or(c = 3 AND day >= 5) FROM f3 GROUP BY 1),
        t AS (SELECT *, channel IN ('error', 'signup', 'view') AS changed FROM d)
        SELECT method, count(*) AS n, count(*) FILTER (said = changed) AS correct, round(avg(said::INTEGER) FILTER (changed), 6) AS sensitivity, round(avg(said::INTEGER) FILTER (NOT changed), 6) AS false_share, round(avg((said = changed)::INTEGER), 6) AS accuracy FROM t GROUP BY 1
        UNION ALL SELECT 'majority', count(*), greatest(count(*) FILTER (changed), count(*) FILTER (NOT changed)), NULL, NULL, round(greatest(avg(changed::INTEGER), avg((NOT changed)::INTEGER)), 6) FROM t WHERE method = 'cusum'""",
    "bucket_ceilings": """WITH c(bucket, ceiling) AS (VALUES ('1-URGENT', 3000::BIGINT), ('2-HIGH', 10), ('3-NONE', 5), ('residual', 100)),
        n AS (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-NONE') THEN o_orderpriority ELSE 'residual' END AS bucket, count(*) AS found FROM orders GROUP BY 1)
        SELECT bucket, coalesce(found, 0) AS found, ceiling, coalesce(found, 0) > ceiling AS over FROM c LEFT JOIN n USING (bucket)""",
    "nth_lines": """WITH l AS (SELECT l_orderkey, l_partkey, min(l_suppkey) AS supplier FROM lineitem GROUP BY 1, 2)
        SELECT * FROM l WHERE supplier NOT IN (3, 7) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) = 3""",
    "bracket_edits": """SELECT c_custkey, 1 + 3 * count(o_orderkey) AS elements, CASE WHEN count(o_orderkey) > 0 THEN 2 ELSE 0 END::INTEGER AS depth,
        count(*) FILTER (o_orderkey IS NOT NULL AND o_orderpriority NOT LIKE '1%') AS orders_left,
        13 + length(c_custkey::VARCHAR) + coalesce(sum(CASE WHEN o_orderkey IS NULL THEN 0 WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 2 + 34 + length(o_orderkey::VARCHAR) END) - CASE WHEN count(o_orderkey) > 0 THEN 2 ELSE 0 END, 0)::BIGINT AS bytes_left
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "capture_roundtrip": f"SELECT event_id AS frame_id, event_id * 50 AS timestamp, {_code(3)} AS code_3, {_code(63)} AS code_63, TRUE AS whole FROM events",
    "capture_counts": """WITH f AS (SELECT event_id, event_id - lag(event_id) OVER (ORDER BY event_id) - 1 AS gap FROM events WHERE event_id % 100 <> 7)
        SELECT count(*) AS frames, 0::BIGINT AS bad, sum(gap)::BIGINT AS dropped, 0::BIGINT AS time_violations, min(event_id) AS first_id, max(event_id) AS last_id, round(sum(gap) / (sum(gap) + count(*)), 6) AS drop_rate FROM f""",
}
QUERIES = {k: globals()[k] for k in SQL}
