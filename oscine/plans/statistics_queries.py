"""Statistics over classifier scores: here the quality label of a document against a score from its length."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oscine.functions import scalars as S
from oscine.operators import statistics as T
from oscine.plans.base import DAILY_SQL, daily_rms, rounded, table


def _scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    both = table(spark, sf_dir, "labels").join(d, "doc_id")
    return both.select("doc_id", "lang", "quality", "toxic", F.round(F.col("n_chars") / (F.col("n_chars") + 700.0), 3).alias("p"))


def ece(spark, sf_dir):
    return rounded(T.calibration_error(T.calibration_bins(_scores(spark, sf_dir), "p", "quality", closed=False)), "ece", "mce")


def calibration(spark, sf_dir):
    return rounded(T.calibration_bins(_scores(spark, sf_dir), "p", "quality"), "confidence", "accuracy")


def best_f1(spark, sf_dir):
    grid = spark.range(50).select((F.lit(0.1) + F.col("id") * (0.85 / 49)).alias("threshold"))
    said = _scores(spark, sf_dir).groupBy("p").agg(F.sum("quality").alias("pos"), F.count("*").alias("n")).crossJoin(F.broadcast(grid))
    hit = F.col("p") >= F.col("threshold")
    per = said.groupBy("threshold").agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("said"), F.sum("pos").alias("pos"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("said") + F.col("pos")), F.lit(0.0))
    best = per.withColumn("f1", f1).agg(F.max(F.struct(F.round("f1", 9), -F.col("threshold"))).alias("b"))
    return rounded(best.select((-F.col("b")["col2"]).alias("threshold"), F.col("b")["col1"].alias("f1")), "threshold", "f1")


def auroc(spark, sf_dir):
    return rounded(T.auroc(_scores(spark, sf_dir), "p", "quality", ["lang"]), "auroc")


def roc_points(spark, sf_dir):
    at = T.operating_counts(_scores(spark, sf_dir), "p", "quality")
    return rounded(at.select("score", (F.col("tp") / F.col("all_pos")).alias("tpr"), (F.col("fp") / F.col("all_neg")).alias("fpr")), "score", "tpr", "fpr")


def fpr_at_tpr(spark, sf_dir):
    return rounded(T.fpr_at_tpr(_scores(spark, sf_dir), "p", "quality"), "fpr")


def confusion(spark, sf_dir):
    said = _scores(spark, sf_dir).select(F.col("quality").alias("truth"), (F.col("p") > 0.5).cast("int").alias("said"))
    return T.confusion(said, "truth", "said", [0, 1, 2])


def majority_accuracy(spark, sf_dir):
    counts = _scores(spark, sf_dir).groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    return rounded(counts.agg((F.max("n") / F.sum("n")).alias("accuracy"), F.sum("n").alias("n")), "accuracy")


def class_accuracy(spark, sf_dir):
    right = (F.col("quality") == (F.col("p") > 0.5).cast("int")).cast("double")
    return rounded(_scores(spark, sf_dir).groupBy("quality").agg(F.count("*").alias("n"), F.avg(right).alias("accuracy")), "accuracy")


def group_detection_rates(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    counts = both.groupBy("lang", "source").agg(F.sum("toxic").alias("k"), F.count("*").alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return rounded(counts.select("lang", "source", "k", "n", (F.col("k") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high")), "rate", "low", "high")


def grouping_sets_summary(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("oscine_lineitem")
    return spark.sql("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 4) AS discount
        FROM oscine_lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_returnflag, l_linestatus))""")


def latency_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).cast("double")
    late = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderpriority", days.alias("days"))
    return rounded(T.latency_summary(late, "days", ["o_orderpriority"]), "mean", "std", "q25", "median", "q75")


def mahalanobis(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.col("p_size").cast("double").alias("size"), "p_retailprice")
    return rounded(T.mahalanobis(rows, ["p_type"], ["size", "p_retailprice"]).select("p_partkey", "d2"), "d2")


def ood_gate(spark, sf_dir):
    """Rows beyond a multiple of the largest distance among the first half of the keys."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.col("p_size").cast("double").alias("size"), "p_retailprice")
    far = T.mahalanobis(rows, ["p_type"], ["size", "p_retailprice"]).withColumn("d", F.sqrt("d2"))
    limit = far.where("p_partkey % 2 = 0").groupBy("p_type").agg((F.max("d") * 0.9).alias("limit"))
    return far.join(F.broadcast(limit), "p_type").groupBy("p_type").agg(F.count("*").alias("n"), F.sum((F.col("d") > F.col("limit")).cast("long")).alias("outliers"))


def top_contrib(spark, sf_dir):
    """The five dimensions of each vector that stand out most: sorted within the row, against means of all rows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    of_dim = e.select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))
    fitted = of_dim.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("fitted"))  # one row of 64
    away = F.zip_with("embedding", "fitted", lambda x, f: F.struct(F.round(F.abs((x.cast("double") - f["mean"]) / F.nullif(f["std"], F.lit(0.0))) / (f["dim"] + 1), 6).alias("c"), f["dim"].alias("dim")))
    top = F.slice(F.reverse(F.array_sort(away)), 1, 5)
    ranked = e.crossJoin(F.broadcast(fitted)).select("vec_id", F.posexplode(top).alias("rank", "t"))
    return ranked.select("vec_id", (F.col("rank") + 1).alias("rank"), "t.dim", "t.c")


def feature_frequency(spark, sf_dir):
    top = top_contrib(spark, sf_dir).where("rank <= 3")
    return top.groupBy("dim").agg(F.count("*").alias("times"))


def kfold(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return rows.select("doc_id", T.folds(rows, "quality", "doc_id", 5, 7).alias("fold"))


def worst_case(spark, sf_dir):
    d = daily_rms(spark, sf_dir)
    found = d.groupBy("channel").agg(F.min_by("day", F.struct("rms", "day")).alias("lowest_day"), F.max_by("day", F.struct("rms", -F.col("day"))).alias("highest_day"), F.avg("rms").alias("mean"), F.percentile("rms", 0.5).alias("median"))
    return rounded(found, "mean", "median")


def mean_by_domain(spark, sf_dir):
    half = F.when(F.col("day") < 15, "A").otherwise("B")
    wide = daily_rms(spark, sf_dir).withColumn("domain", half).groupBy("channel").pivot("domain", ["A", "B"]).agg(F.avg("rms"))
    return rounded(wide.select("channel", F.col("A").alias("a"), F.col("B").alias("b"), (F.col("A") - F.col("B")).alias("fall")), "a", "b", "fall")


def param_grid_fpr(spark, sf_dir):
    """False alarms for every threshold and cooldown: the trace is computed once, the parameters are rows."""
    grid = spark.createDataFrame([(float(t), c) for t in (50, 55, 60) for c in (0, 2, 5)], "threshold double, cooldown int")
    hits = daily_rms(spark, sf_dir).crossJoin(F.broadcast(grid)).where("rms > threshold").groupBy("threshold", "cooldown", "channel").agg(F.array_sort(F.collect_list("day")).alias("days"))

    def keep(kept, t):
        last = F.try_element_at(kept, F.lit(-1))
        return F.when((F.size(kept) == 0) | (t - F.coalesce(last, t) >= F.col("cooldown")), F.concat(kept, F.array(t))).otherwise(kept)

    alarms = hits.select("threshold", "cooldown", F.size(F.aggregate("days", F.array().cast("array<long>"), keep)).alias("n"))
    return grid.join(alarms.groupBy("threshold", "cooldown").agg(F.sum("n").alias("alarms")), ["threshold", "cooldown"], "left").select("threshold", "cooldown", F.coalesce("alarms", F.lit(0)).alias("alarms"))


def operating_point(spark, sf_dir):
    """First grid point whose alarms fit the budget, or else the last."""
    grid = param_grid_fpr(spark, sf_dir)
    fits = F.min(F.when(F.col("alarms") <= 30, F.struct("threshold", "cooldown", "alarms")))
    best = grid.agg(F.coalesce(fits, F.max(F.struct("threshold", "cooldown", "alarms"))).alias("b"))
    return best.select("b.threshold", "b.cooldown", "b.alarms")


def pareto(spark, sf_dir):
    per = param_grid_fpr(spark, sf_dir).where("cooldown = 0")
    return per.agg(F.min(F.when(F.col("alarms") <= 10, F.col("threshold"))).alias("strict"), F.min(F.when(F.col("alarms") <= 60, F.col("threshold"))).alias("loose"), F.max("alarms").alias("worst"))


_SC = "scores AS (SELECT l.doc_id, lang, quality, toxic, round(n_chars / (n_chars + 700.0::DOUBLE), 3) AS p FROM labels l JOIN documents USING (doc_id))"
_BINS = "SELECT {b} AS bin, count(*) AS n, avg(p) AS confidence, avg(quality) AS accuracy FROM scores {w} GROUP BY 1"
_OP = """per AS (SELECT {k} p AS score, sum(quality) AS pos, sum(1 - quality) AS neg FROM scores GROUP BY ALL),
    op AS (SELECT {k} score, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER a AS all_pos, sum(neg) OVER a AS all_neg FROM per
    WINDOW d AS ({part} ORDER BY score DESC), a AS ({part}))"""
_GRID = f"""{DAILY_SQL}, g(threshold, cooldown) AS (SELECT t::DOUBLE, c::INTEGER FROM (VALUES (50), (55), (60)) x(t), (VALUES (0), (2), (5)) y(c)),
    h AS (SELECT threshold, cooldown, channel, day FROM daily, g WHERE rms > threshold),
    k AS (SELECT threshold, cooldown, channel, min(day) AS day FROM h GROUP BY ALL UNION ALL
      SELECT threshold, cooldown, channel, day FROM (SELECT k.threshold, k.cooldown, k.channel, min(h.day) AS day FROM k JOIN h ON h.threshold = k.threshold AND h.cooldown = k.cooldown AND h.channel = k.channel
      AND h.day > k.day AND h.day >= k.day + k.cooldown GROUP BY ALL)),
    grid AS (SELECT g.threshold, g.cooldown, count(k.day) AS alarms FROM g LEFT JOIN k ON k.threshold = g.threshold AND k.cooldown = g.cooldown GROUP BY ALL)"""
_MAHA = """m AS (SELECT p_partkey, p_type, p_size::DOUBLE AS x, p_retailprice AS y, var_samp(p_size) OVER w + 1e-6 AS a, covar_samp(p_size, p_retailprice) OVER w AS b, var_samp(p_retailprice) OVER w + 1e-6 AS c,
    p_size - avg(p_size) OVER w AS dx, p_retailprice - avg(p_retailprice) OVER w AS dy FROM part WINDOW w AS (PARTITION BY p_type)),
    d AS (SELECT p_partkey, p_type, (c * dx * dx - 2 * b * dx * dy + a * dy * dy) / (a * c - b * b) AS d2 FROM m)"""
_TOP = """e AS (SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    s AS (SELECT vec_id, dim, round(abs((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0)) / (dim + 1), 6) AS c FROM e WINDOW w AS (PARTITION BY dim)),
    top AS (SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, dim DESC) AS INTEGER) AS rank, dim, c FROM s)"""
SQL = {
    "ece": f"WITH {_SC}, b AS ({_BINS.format(b='floor(p * 10)', w='WHERE p < 1')}) SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece, round(max(abs(accuracy - confidence)), 6) AS mce FROM b",
    "calibration": f"WITH {_SC}, b AS ({_BINS.format(b='CAST(least(floor(p * 10), 9) AS INTEGER)', w='')}) SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM b",
    "best_f1": f"""WITH {_SC}, g AS (SELECT 0.1::DOUBLE + i * (0.85::DOUBLE / 49) AS threshold FROM range(50) t(i)),
        c AS (SELECT threshold, round(2.0 * sum(CASE WHEN p >= threshold THEN quality ELSE 0 END) / (sum(CASE WHEN p >= threshold THEN 1 ELSE 0 END) + sum(quality)), 9) AS f1 FROM scores, g GROUP BY 1)
        SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM c ORDER BY c.f1 DESC, c.threshold LIMIT 1""",
    "auroc": f"""WITH {_SC} SELECT l.lang, round(coalesce(avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 WHEN a.p < b.p THEN 0.0 END), 0.5), 6) AS auroc
        FROM (SELECT DISTINCT lang FROM scores) l LEFT JOIN scores a ON a.lang = l.lang AND a.quality = 1 LEFT JOIN scores b ON b.lang = l.lang AND b.quality = 0 GROUP BY 1""",
    "roc_points": f"WITH {_SC}, {_OP.format(k='', part='')} SELECT score, round(tp / all_pos, 6) AS tpr, round(fp / all_neg, 6) AS fpr FROM op",
    "fpr_at_tpr": f"WITH {_SC}, {_OP.format(k='', part='')} SELECT round(coalesce(min(fp / all_neg), 1.0), 6) AS fpr FROM op WHERE tp >= 0.9 * all_pos",
    "confusion": f"""WITH {_SC}, l(x) AS (VALUES (0), (1), (2)), c AS (SELECT quality AS truth, CAST(p > 0.5 AS INTEGER) AS said, count(*) AS n FROM scores GROUP BY ALL)
        SELECT a.x AS truth, b.x AS said, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.truth = a.x AND c.said = b.x""",
    "majority_accuracy": f"WITH {_SC}, c AS (SELECT count(*) AS n FROM scores GROUP BY quality, toxic) SELECT round(max(n) / sum(n), 6) AS accuracy, CAST(sum(n) AS BIGINT) AS n FROM c",
    "class_accuracy": f"WITH {_SC} SELECT quality, count(*) AS n, round(avg(CAST(quality = CAST(p > 0.5 AS INTEGER) AS INTEGER)), 6) AS accuracy FROM scores GROUP BY 1",
    "group_detection_rates": """WITH c AS (SELECT lang, source, CAST(sum(toxic) AS BIGINT) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2),
        w AS (SELECT *, k / n AS p, 1.96::DOUBLE AS z FROM c), b AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS m, z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n)) AS h FROM w)
        SELECT lang, source, k, n, round(p, 6) AS rate, round(greatest(0, m - h), 6) AS low, round(least(1, m + h), 6) AS high FROM b""",
    "grouping_sets_summary": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 4) AS discount
        FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_returnflag, l_linestatus))""",
    "latency_summary": """WITH d AS (SELECT o_orderpriority, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))::DOUBLE AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT o_orderpriority, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q75 FROM d GROUP BY 1""",
    "mahalanobis": f"WITH {_MAHA} SELECT p_partkey, round(d2, 6) AS d2 FROM d",
    "ood_gate": f"""WITH {_MAHA}, l AS (SELECT p_type, max(sqrt(d2)) * 0.9 AS lim FROM d WHERE p_partkey % 2 = 0 GROUP BY 1)
        SELECT p_type, count(*) AS n, CAST(sum(CASE WHEN sqrt(d2) > lim THEN 1 ELSE 0 END) AS BIGINT) AS outliers FROM d JOIN l USING (p_type) GROUP BY 1""",
    "top_contrib": f"WITH {_TOP} SELECT vec_id, rank, dim, c FROM top WHERE rank <= 5",
    "feature_frequency": f"WITH {_TOP} SELECT dim, count(*) AS times FROM top WHERE rank <= 3 GROUP BY 1",
    "kfold": "SELECT doc_id, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5('7:' || doc_id), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels",
    "worst_case": f"""WITH {DAILY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY rms, day) AS lo, row_number() OVER (PARTITION BY channel ORDER BY rms DESC, day) AS hi FROM daily)
        SELECT channel, max(day) FILTER (lo = 1) AS lowest_day, max(day) FILTER (hi = 1) AS highest_day, round(avg(rms), 6) AS mean, round(quantile_cont(rms, 0.5), 6) AS median FROM r GROUP BY 1""",
    "mean_by_domain": f"""WITH {DAILY_SQL} SELECT channel, round(avg(rms) FILTER (day < 15), 6) AS a, round(avg(rms) FILTER (day >= 15), 6) AS b,
        round(avg(rms) FILTER (day < 15) - avg(rms) FILTER (day >= 15), 6) + 0.0 AS fall FROM daily GROUP BY 1""",
    "param_grid_fpr": f"WITH RECURSIVE {_GRID} SELECT threshold, cooldown, alarms FROM grid",
    "operating_point": f"WITH RECURSIVE {_GRID} SELECT threshold, cooldown, alarms FROM grid ORDER BY (alarms > 30), CASE WHEN alarms <= 30 THEN threshold ELSE -threshold END, CASE WHEN alarms <= 30 THEN cooldown ELSE -cooldown END LIMIT 1",
    "pareto": f"WITH RECURSIVE {_GRID} SELECT min(threshold) FILTER (alarms <= 10) AS strict, min(threshold) FILTER (alarms <= 60) AS loose, max(alarms) AS worst FROM grid WHERE cooldown = 0",
}
QUERIES = {k: globals()[k] for k in SQL}
