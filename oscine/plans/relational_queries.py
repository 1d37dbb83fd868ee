"""Joins, sets, graphs, distances, rules and texts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oscine.functions import scalars as S
from oscine.operators import relational as R
from oscine.operators import rules as V
from oscine.operators import statistics as T
from oscine.plans.base import daily_rms, rounded, samples, table


def _hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), "n_chars", "lang", "source")


def sha_manifest(spark, sf_dir):
    return _hashes(spark, sf_dir).select("doc_id", "sha", F.left("sha", F.lit(12)).alias("short"))


def manifest_diff(spark, sf_dir):
    h = _hashes(spark, sf_dir)
    old = h.where("doc_id % 10 <> 3").select("doc_id", "sha")
    new = h.where("doc_id % 10 <> 7").select("doc_id", F.when(F.col("doc_id") % 10 == 5, F.reverse("sha")).otherwise(F.col("sha")).alias("sha"))
    return R.manifest_diff(old, new, "doc_id", "sha")


def pack_verify(spark, sf_dir):
    """Rows of a manifest against the files: ok, tampered, or missing."""
    h = _hashes(spark, sf_dir)
    listed = h.select("doc_id", F.when(F.col("doc_id") % 50 == 1, F.lit("x")).otherwise(F.col("sha")).alias("want"))
    files = h.where("doc_id % 40 <> 2").select("doc_id", "sha")
    verdict = F.when(F.col("sha").isNull(), "missing").when(F.col("sha") != F.col("want"), "tampered").otherwise("ok")
    return listed.join(files, "doc_id", "left").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def leakage(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return R.leakage(events.where("event_id % 3 <> 0"), events.where("event_id % 3 = 0"), "user_id")


def split_by_recording(spark, sf_dir):
    """Whole users go to one side, by a seeded hash."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    side = F.when(F.md5(F.concat(F.lit("3:"), F.col("user_id").cast("string"))) < "4", "test").otherwise("train")
    return table(spark, sf_dir, "events").join(users.withColumn("side", side), "user_id").groupBy("side").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def split_membership(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return events.join(chosen, "user_id", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"))


def required_anti(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return R.missing(customers, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key")


def allowlist(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, sf_dir, "supplier").join(F.broadcast(nations), "s_nationkey", "left_anti").select("s_suppkey", "s_nationkey")


def completeness(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    a = orders.where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return R.one_sided(a, orders.where("o_orderstatus = 'P'").select("o_custkey"), "o_custkey")


def log_join(spark, sf_dir):
    """A log meets what was recorded by name; what is missing is dropped."""
    log = table(spark, sf_dir, "customer").select(S.trial_file((F.col("c_custkey") % 4).cast("int"), F.col("c_custkey").cast("int"), F.lower("c_mktsegment"), F.lit("high")).alias("filename"), "c_custkey")
    there = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice").groupBy("c_custkey").agg(F.count("*").alias("trials"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return log.join(there, "c_custkey").select("filename", "trials", "total")


def budget_join(spark, sf_dir):
    """Measures with a budget beside them where there is one."""
    budget = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    measured = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("balance"))
    return measured.join(F.broadcast(budget), "c_nationkey", "left").select("c_nationkey", "n", "balance", F.coalesce("n_name", F.lit("")).alias("n_name"))


def prioritized_lookup(spark, sf_dir):
    """Declared matches before any match: one supplier for each customer, of the own nation first, then of the own region."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey")
    per_nation = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("own"))
    per_region = per_nation.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.min("own").alias("any"))
    found = c.join(F.broadcast(per_nation), F.col("c_nationkey") == F.col("s_nationkey"), "left").join(F.broadcast(per_region), "n_regionkey", "left")
    return found.select("c_custkey", F.coalesce("own", "any").alias("s_suppkey"), F.when(F.col("own").isNotNull(), 1).when(F.col("any").isNotNull(), 2).alias("priority"))


def _points(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_retailprice") * 37 % 100).alias("x"), (F.col("p_partkey") * 7919 % 1000 / 10.0).alias("y"))


def via_in_pad(spark, sf_dir):
    """Pairs of the same net that nearly coincide."""
    p = _points(spark, sf_dir)
    return R.near_pairs(p, p, ["p_brand"], "x", "y", 3.0).where("p_partkey < p_partkey_r").select("p_brand", "p_partkey", F.col("p_partkey_r").alias("other"))


def spatial_clearance(spark, sf_dir):
    """Least distance of each point from a few named tracks of other nets, where it is too small."""
    tracks = spark.createDataFrame([("Brand#1", 0.0, 0.0, 100.0, 90.0), ("Brand#2", 10.0, 80.0, 90.0, 5.0), ("Brand#3", 50.0, 0.0, 50.0, 100.0)], "net string, ax double, ay double, bx double, by double")
    d = R.segment_distance(*[F.col(c) for c in ("ax", "ay", "bx", "by", "x", "y")])
    near = _points(spark, sf_dir).join(F.broadcast(tracks), F.col("net") != F.col("p_brand")).withColumn("d", d).where("d < 1.5")
    return rounded(near.groupBy("p_partkey").agg(F.count("*").alias("tracks"), F.min("d").alias("clearance")), "clearance")


def route_length(spark, sf_dir):
    order = Window.partitionBy("p_brand").orderBy("p_partkey")
    legs = _points(spark, sf_dir).withColumn("leg", F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)))
    return rounded(legs.groupBy("p_brand").agg(F.sum("leg").alias("length"), F.count("leg").alias("legs")), "length", digits=4)


def reachability(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    edges = nations.select(F.col("k").alias("src"), ((F.col("k") * 2 + 1) % 25).alias("dst")).union(nations.where("k % 4 = 0").select("k", ((F.col("k") + 6) % 25)))
    return R.reachable(edges, spark.createDataFrame([(3,)], "node long"))


def coordinate_snap(spark, sf_dir):
    p = _points(spark, sf_dir)
    return p.select(S.snap("x", 0.25).alias("i"), S.snap("y", 0.25).alias("j")).groupBy("i", "j").agg(F.count("*").alias("n")).where("n > 1")


def _blocks(documents):
    d = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    head = F.col("t").rlike("^[A-Z][a-z]+.*[.]$").cast("int")
    block = F.sum(head).over(Window.partitionBy("doc_id").orderBy("line"))
    return d.withColumn("block", block).groupBy("doc_id", "block").agg(F.count("*").alias("lines"), F.sum(F.length("t").cast("long")).alias("chars"))


def report_blocks(spark, sf_dir):
    """Lines of every text in blocks: a line that begins upper case and ends in a full stop starts one."""
    return _blocks(table(spark, sf_dir, "documents"))


def report_blocks_all(spark, sf_dir):
    """The blocks of every document."""
    return _blocks(table(spark, sf_dir, "documents"))


def report_totals(spark, sf_dir):
    """Numbers of a page, by patterns, beside their declared counterpart."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("url", r"^(https?)://([^/]+)", 2).alias("host"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), F.size(F.array_distinct(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1)))).cast("long").alias("links"))


def role_classify(spark, sf_dir):
    """First matching rule wins; what none matches keeps its own type."""
    role = F.when(F.col("p_name").rlike("^(small|tiny)"), "minor").when(F.col("p_name").rlike("ring|bolt"), "fastener").when(F.col("p_type").isin("ECONOMY", "PROMO"), F.lower("p_type")).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").groupBy(role.alias("role")).agg(F.count("*").alias("n"))


def json_walk(spark, sf_dir):
    """Fields of nested text, with every row accounted for once."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    b = F.when(k.isNull(), "other").when(k < 30, "low").when(k < 70, "mid").otherwise("high")
    return table(spark, sf_dir, "events").groupBy("event_type", b.alias("bucket")).agg(F.count("*").alias("n"), F.sum(k.cast("long")).alias("total"))


def net_tokens(spark, sf_dir):
    """Distinct tokens of a text in order, without those of a list."""
    words = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower("p_name"), F.lit("([a-z]+)"), F.lit(1)), lambda w: w != "ring")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(words, ",").alias("tokens"))


def drc_histogram(spark, sf_dir):
    found = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    limits = found.groupBy("o_orderstatus").agg(F.max("n").alias("most")).withColumn("ceiling", F.col("most") - 20)
    return found.join(F.broadcast(limits), "o_orderstatus").select("o_orderstatus", "o_orderpriority", "n", (F.col("n") > F.col("ceiling")).alias("over"))


def contract_rules(spark, sf_dir):
    """A violation for each rule that a supplier's deliveries break."""
    stats = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), T.exact_mean("l_discount").alias("discount"), F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("returned"), F.max("l_quantity").alias("largest"))
    rules = [("few_lines", "WARN", F.col("n") < 580), ("discount", "FAIL", F.col("discount") > 0.0512), ("returned", "FAIL", F.col("returned") > 0.35), ("largest", "WARN", F.col("largest") < 50)]
    return V.violations(stats, ["l_suppkey"], rules)


def bringup_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")
    rules = [
        ("blank", "FAIL", F.trim("o_orderpriority") == ""), ("enum", "FAIL", ~F.col("o_orderstatus").isin("O", "F", "P")),
        ("bounds", "FAIL", ~F.col("o_totalprice").between(1000, 499000)), ("late", "WARN", F.col("o_orderdate") > F.lit("2001-06-01").cast("timestamp")),
    ]
    return V.violations(rows, ["o_orderkey"], rules)


def lot_consistency(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("flags"), F.count("*").alias("lines"))
    return counts.where("flags > 1").groupBy("flags").agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"))


def data_sufficiency(spark, sf_dir):
    users = samples(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("channel").alias("channels"), F.count_distinct("day").alias("days"))
    tier = F.when((F.col("n") >= 70) & (F.col("channels") >= 5) & (F.col("days") >= 25), "report").when((F.col("n") >= 55) & (F.col("days") >= 20), "demo").otherwise("none")
    return users.groupBy(tier.alias("tier")).agg(F.count("*").alias("users"))


def trial_order(spark, sf_dir):
    """Random order within a session by a seeded hash, numbers, and a break where the session changes."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("session"), "s_suppkey")
    order = Window.partitionBy("session").orderBy(F.md5(F.concat(F.lit("5:"), F.col("s_suppkey").cast("string"))), "s_suppkey")
    trial = F.row_number().over(order)
    return rows.withColumn("trial", trial).withColumn("break", F.col("trial") == 1).withColumn("filename", F.format_string("S%d_T%02d", "session", "trial"))


def label_encode(spark, sf_dir):
    codes = F.create_map(*[x for i, v in enumerate(["BUILDING", "MACHINERY", "HOUSEHOLD"]) for x in (F.lit(v), F.lit(i))])
    return table(spark, sf_dir, "customer").groupBy(F.coalesce(F.try_element_at(codes, F.col("c_mktsegment")), F.lit(0)).alias("code")).agg(F.count("*").alias("n"))


def calibrated_probs(spark, sf_dir):
    logits = F.transform("embedding", lambda x: x.cast("double") * 5)
    p = table(spark, sf_dir, "embeddings").select("vec_id", S.softmax(logits, 1.5).alias("p"))
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    return p.select("vec_id", best.alias("label"), F.round(F.array_max("p"), 5).alias("confidence"))


def status_bits(spark, sf_dir):
    flags = S.status_bits((F.col("event_id") % 256).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", *[v.alias(k) for k, v in flags.items()])
    return rows.groupBy(*flags).agg(F.count("*").alias("n"))


def frame_crc(spark, sf_dir):
    """CRC-16 of all bytes of every customer's name; the names are ASCII."""
    return table(spark, sf_dir, "customer").select("c_custkey", S.crc16(F.encode(F.col("c_name"), "UTF-8")).alias("crc"))


def frame_crc_all(spark, sf_dir):
    """CRC-16 of all bytes of every customer's name."""
    return table(spark, sf_dir, "customer").select("c_custkey", S.crc16(F.encode(F.col("c_name"), "UTF-8")).alias("crc"))


def nt_xent_pairs(spark, sf_dir):
    """Mean cosine of vectors with the mean of each class."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    centre = e.groupBy("label", "i").agg(F.avg("x").alias("c")).withColumnRenamed("label", "other")
    norms = centre.groupBy("other").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("nc"))
    dots = e.join(F.broadcast(centre), "i").groupBy("vec_id", "label", "other").agg(F.sum(F.col("x") * F.col("c")).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("nx"))
    cos = dots.join(F.broadcast(norms), "other").withColumn("cos", F.col("dot") / (F.col("nx") * F.col("nc")))
    return rounded(cos.groupBy("label", "other").agg(F.count("*").alias("n"), F.avg("cos").alias("cos")), "cos", digits=5)


def recovery_ratio(spark, sf_dir):
    """Ratios of later epochs to the baseline, infinite where the baseline is zero."""
    d = daily_rms(spark, sf_dir)
    parts = d.groupBy("channel").agg(*[F.avg(F.when(F.col("day").between(a, b), F.col("rms"))).alias(n) for n, a, b in (("base", 0, 9), ("pert", 10, 19), ("rec", 20, 29))])
    return rounded(parts.select("channel", S.ratio_or_inf(F.col("pert"), F.col("base")).alias("noise_ratio"), S.ratio_or_inf(F.col("rec"), F.col("base")).alias("recovery_ratio")), "noise_ratio", "recovery_ratio")


from oscine.plans.relational_sql import SQL  # noqa: E402

QUERIES = {k: globals()[k] for k in SQL} | {f.__name__: f for f in (report_blocks_all, frame_crc_all)}
