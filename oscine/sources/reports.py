"""Text, JSON, XML and bracketed files of the hardware side, and logs of sessions, as rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oscine.sources import brackets

SESSION_LOG = "session INT, trial INT, perturbation STRING, level STRING, filename STRING, temperature_c DOUBLE, notes STRING"


def session_log(spark: SparkSession, path: str) -> DataFrame:
    """The log of trials; headers of either spelling are taken."""
    raw = spark.read.option("header", True).csv(path)
    names = {"perturbation_type": "perturbation", "perturbation_level": "level", "temperature_C": "temperature_c"}
    raw = raw.withColumnsRenamed({k: v for k, v in names.items() if k in raw.columns})
    fields = [x.split(" ") for x in SESSION_LOG.split(", ")]
    return raw.select(*[(F.col(n).try_cast(t) if n in raw.columns else F.lit(None).cast(t)).alias(n) for n, t in fields])


def report_totals(spark: SparkSession, path: str) -> DataFrame:
    """Declared totals of rule-check reports; a report without them is an error."""
    text = spark.read.text(path, wholetext=True).withColumn("source", F.input_file_name())
    found = {k: F.regexp_extract("value", rf"\*\* Found (\d+) {k}", 1).try_cast("int") for k in ("DRC violations", "unconnected pads", "Footprint errors")}
    rows = text.select("source", *[v.alias(k.split(" ")[-1]) for k, v in found.items()])
    problem = F.raise_error(F.concat(F.lit("no totals in "), F.col("source"))).cast("int")
    return rows.withColumn("violations", F.coalesce("violations", problem))


def report_violations(spark: SparkSession, path: str) -> DataFrame:
    """source, block, type, description, lines, nets of each violation: a line [type]: starts one, and lines up to the next or to
    a line of stars belong to it."""
    text = spark.read.text(path, wholetext=True).withColumn("source", F.input_file_name())
    lines = text.select("source", F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    order = Window.partitionBy("source").orderBy("n")
    head, stop = F.col("line").rlike(r"^\[\w+\]:"), F.col("line").startswith("**")
    lines = lines.withColumn("block", F.sum(head.cast("int")).over(order)).withColumn("open", F.last(F.when(head, True).when(stop, False), ignorenulls=True).over(order))
    body = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    found = lines.where("open AND block > 0").groupBy("source", "block").agg(body.alias("lines"))
    nets = F.regexp_extract_all(F.array_join("lines", "\n"), F.lit(r"\[([^\]\n]+)\]"), F.lit(1))
    kept = F.array_sort(F.array_distinct(F.filter(F.slice(nets, F.lit(2), F.greatest(F.size(nets) - 1, F.lit(0))), lambda x: ~x.rlike(r"^[FB]\.\w+"))))
    first = F.col("lines")[0]
    return found.select("source", "block", F.regexp_extract(first, r"^\[(\w+)\]:", 1).alias("type"), F.trim(F.regexp_extract(first, r"^\[\w+\]:\s*(.*)$", 1)).alias("description"), "lines", kept.alias("nets"))


def via_places(violations: DataFrame) -> DataFrame:
    """source, block, x, y of the vias that violations name, to a tenth of a millimetre."""
    found = violations.select("source", "block", F.explode("lines").alias("line")).where(F.col("line").contains("Via"))
    x, y = (F.bround(F.regexp_extract("line", r"@\((-?[\d.]+) mm, (-?[\d.]+) mm\)", k).try_cast("double"), 1) for k in (1, 2))
    return found.select("source", "block", x.alias("x"), y.alias("y")).where("x IS NOT NULL")


def conserved(report: DataFrame, declared: dict[str, int]) -> DataFrame:
    """bucket, found, declared and whether they agree, of the buckets of a report (distinct bucket, entry rows)."""
    counts = report.groupBy("bucket").agg(F.count("*").alias("found"))
    want = report.sparkSession.createDataFrame(list(declared.items()), "bucket string, declared long")
    both = want.join(counts, "bucket", "full").fillna(0, ["found", "declared"])
    return both.withColumn("agrees", F.col("found") == F.col("declared"))


def clauses(texts: DataFrame, required: list[str], text: str = "value") -> DataFrame:
    """clause and whether any of the texts holds it, whatever the case of the letters."""
    held = texts.agg(*[F.max(F.lower(text).contains(c.lower())).alias(f"c{k}") for k, c in enumerate(required)])
    rows = F.array(*[F.struct(F.lit(c).alias("clause"), F.coalesce(f"c{k}", F.lit(False)).alias("present")) for k, c in enumerate(required)])
    return held.select(F.explode(rows).alias("r")).select("r.clause", "r.present")


def check_json(spark: SparkSession, path: str) -> DataFrame:
    """One row for each item of a JSON report: bucket, type, severity, item; every entry is in one of the three buckets."""
    item = "ARRAY<STRUCT<description: STRING, uuid: STRING>>"
    entry = f"ARRAY<STRUCT<type: STRING, severity: STRING, description: STRING, items: {item}>>"
    raw = spark.read.schema(f"violations {entry}, unconnected_items {entry}, schematic_parity {entry}").option("multiLine", True).json(path)

    def named(bucket: str) -> Column:
        return F.transform(F.coalesce(bucket, F.array().cast(dict(raw.dtypes)[bucket])), lambda v: F.struct(F.lit(bucket).alias("bucket"), v.alias("v")))

    rows = raw.select(F.explode(F.concat(*[named(b) for b in raw.columns])).alias("e")).select("e.bucket", "e.v.type", "e.v.severity", F.explode_outer("e.v.items").alias("i"))
    return rows.select("bucket", "type", "severity", F.col("i.description").alias("item"))


def netlist(spark: SparkSession, path: str) -> DataFrame:
    """net, ref, pin of an XML netlist."""
    schema = "_code STRING, _name STRING, node ARRAY<STRUCT<_ref: STRING, _pin: STRING, _VALUE: STRING>>"
    nets = spark.read.format("xml").option("rowTag", "net").schema(schema).load(path)
    return nets.select(F.col("_name").alias("net"), F.explode("node").alias("n")).select("net", F.col("n._ref").alias("ref"), F.col("n._pin").alias("pin"))


_NUMBER = r"(-?[\d.]+)"


def _field(block: Column, name: str, part: int = 1) -> Column:
    return F.regexp_extract(block, rf"\({name} {_NUMBER}(?: {_NUMBER})?", part).try_cast("double")


def bracketed(text: Column | str, kind: str) -> Column:
    """The blocks of a kind of a text column, as an array."""
    return F.arrow_udf(lambda c: pa.array([brackets.nested(v, kind) for v in c.to_pylist()], pa.list_(pa.string())), "array<string>")(text)


def _blocks(spark: SparkSession, path: str, kind: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(bracketed("value", kind)).alias("raw")).withColumn("b", F.regexp_replace("raw", r"\s+", " "))


def _text(block: Column | str, name: str) -> Column:
    return F.nullif(F.regexp_extract(block, rf'\({name} "?([^")]*)"?', 1), F.lit(""))


def board(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Track segments and vias of a bracketed board file, each as rows."""
    net = F.regexp_extract("b", r"\(net (\d+)", 1).try_cast("int").alias("net")
    segments = _blocks(spark, path, "segment").select(*[_field(F.col("b"), n, k).alias(a) for a, n, k in (("ax", "start", 1), ("ay", "start", 2), ("bx", "end", 1), ("by", "end", 2), ("width", "width", 1))], _text("b", "layer").alias("layer"), net)
    layers = F.regexp_extract_all(F.regexp_extract("b", r"\(layers ([^)]*)\)", 1), F.lit(r"([\w.*]+)"), F.lit(1))
    vias = _blocks(spark, path, "via").select(_field(F.col("b"), "at", 1).alias("x"), _field(F.col("b"), "at", 2).alias("y"), _field(F.col("b"), "size").alias("size"), _field(F.col("b"), "drill").alias("drill"), layers.alias("layers"), net)
    return segments, vias


def pads(spark: SparkSession, path: str) -> DataFrame:
    """ref, pin, kind, x, y (of the board: the footprint's place, and the pad's turned by its angle), width, height, layers, net
    and net's name of every pad."""
    parts = _blocks(spark, path, "footprint")
    own = parts.select(
        F.coalesce(F.nullif(F.regexp_extract("b", r'\(property "Reference" "([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract("b", r'\(fp_text reference "?([^" )]*)', 1), F.lit(""))).alias("ref"),
        _field(F.col("b"), "at", 1).alias("fx"), _field(F.col("b"), "at", 2).alias("fy"), F.regexp_extract("b", rf"\(at {_NUMBER} {_NUMBER} {_NUMBER}\)", 3).try_cast("double").alias("turn"),
        F.explode(bracketed("b", "pad")).alias("p"),
    )
    angle = F.radians(-F.coalesce("turn", F.lit(0.0)))
    px, py = _field(F.col("p"), "at", 1), _field(F.col("p"), "at", 2)
    return own.select(
        "ref", F.regexp_extract("p", r'^\(pad "?([^" ]*)"?', 1).alias("pin"), F.regexp_extract("p", r'^\(pad "?[^" ]*"? (\w+)', 1).alias("kind"),
        (F.col("fx") + px * F.cos(angle) - py * F.sin(angle)).alias("x"), (F.col("fy") + px * F.sin(angle) + py * F.cos(angle)).alias("y"), _field(F.col("p"), "size", 1).alias("width"), _field(F.col("p"), "size", 2).alias("height"),
        F.regexp_extract_all(F.regexp_extract("p", r"\(layers ([^)]*)\)", 1), F.lit(r"([\w.*]+)"), F.lit(1)).alias("layers"),
        F.regexp_extract("p", r"\(net (\d+)", 1).try_cast("int").alias("net"), F.nullif(F.regexp_extract("p", r'\(net \d+ "([^"]*)"', 1), F.lit("")).alias("net_name"),
    )


def declared_nets(spark: SparkSession, path: str) -> DataFrame:
    """net and name of the nets that a board declares."""
    text = spark.read.text(path).select(F.regexp_extract_all("value", F.lit(r'^\s*(\(net \d+ "[^"]*"\))\s*$'), F.lit(1)).alias("n"))
    b = text.select(F.explode("n").alias("b"))
    return b.select(F.regexp_extract("b", r"\(net (\d+)", 1).cast("int").alias("net"), F.regexp_extract("b", r'"([^"]*)"', 1).alias("name")).distinct()


def netclasses(spark: SparkSession, path: str) -> DataFrame:
    """name, clearance, width and nets of each class."""
    b = _blocks(spark, path, "net_class")
    nets = F.concat(F.regexp_extract_all("b", F.lit(r'\(add_net "([^"]*)"\)'), F.lit(1)), F.regexp_extract_all("b", F.lit(r'\(add_net ([^" )]+)\)'), F.lit(1)))
    return b.select(F.regexp_extract("b", r'^\(net_class "?([^" ]+)', 1).alias("name"), _field(F.col("b"), "clearance").alias("clearance"), _field(F.col("b"), "trace_width").alias("width"), nets.alias("nets"))


def zones(spark: SparkSession, path: str) -> DataFrame:
    """net, its name, layers, clearance, and the corners of each copper zone's outline."""
    b = _blocks(spark, path, "zone")
    layers = F.regexp_extract_all(F.regexp_extract("b", r"\(layers? ([^)]*)\)", 1), F.lit(r"([\w.*&]+)"), F.lit(1))
    outline = F.regexp_extract_all(F.element_at(bracketed("b", "polygon"), 1), F.lit(rf"\(xy {_NUMBER} {_NUMBER}\)"), F.lit(0))
    corners = F.transform(outline, lambda c: F.struct(F.regexp_extract(c, rf"xy {_NUMBER}", 1).cast("double").alias("x"), F.regexp_extract(c, rf"xy {_NUMBER} {_NUMBER}", 2).cast("double").alias("y")))
    return b.where(F.size(bracketed("b", "polygon")) > 0).select(F.regexp_extract("b", r"\(net (\d+)", 1).try_cast("int").alias("net"), _text("b", "net_name").alias("net_name"), layers.alias("layers"), _field(F.col("b"), "clearance").alias("clearance"), corners.alias("corners"))


def stackup(spark: SparkSession, path: str) -> DataFrame:
    """place, layer, kind, thickness and material of the layers of a board, from the top."""
    b = _blocks(spark, path, "stackup").select(F.posexplode(bracketed("b", "layer")).alias("place", "l"))
    return b.select("place", F.regexp_extract("l", r'^\(layer "?([^" ]+)', 1).alias("layer"), _text("l", "type").alias("kind"), _field(F.col("l"), "thickness").alias("thickness"), _text("l", "material").alias("material"))


def pads_off_net(required: DataFrame, found: DataFrame) -> DataFrame:
    """Of required pads (ref, pin, net_name), those that the board doesn't have on that net, and the net where they are, if any."""
    there = found.select("ref", "pin", F.col("net_name").alias("is_on"))
    both = required.join(there, ["ref", "pin"], "left")
    return both.where(~F.col("net_name").eqNullSafe(F.col("is_on")))
