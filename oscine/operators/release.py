"""The twelve gates of a release package: archives held against what they must contain, their own manifest, a baseline, evidence
files and the sources they were built from. Many packages are checked at once; what offends a gate is a row.

Fixed values, from the gates: names of files, endings, clauses, columns, words and patterns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oscine.sources import archives

GATES = ("files", "layers", "drill", "clauses", "keywords", "vias", "checklist", "tools", "baseline", "evidence", "manifest", "inputs")


@dataclass(frozen=True)
class Profile:
    files: tuple[str, ...] = (
        "fab_notes.txt", "fab_profile.yaml", "vip_vias.csv", "README_FAB.md", "bringup_checklist.txt", "assembly_constraints.txt", "dfm_feedback_loop.txt", "order_checklist.txt", "manifest.json",
    )
    layers: tuple[str, ...] = (".gtl", ".g1", ".g2", ".gbl", ".gts", ".gbs", ".gto", ".gbo", ".gm1")
    clauses: tuple[str, ...] = ("CLAUSE SM-1", "CLAUSE VIP-1", "CLAUSE SUB-1", "CLAUSE FA-1")
    least_keywords: int = 10
    via_columns: tuple[str, ...] = ("net", "x_mm", "y_mm", "size_mm", "drill_mm", "pad_ref", "pad_pin", "pad_size_x_mm", "pad_size_y_mm", "layer_set", "mask_state")
    least_vias: int = 14
    checklist: tuple[str, ...] = ("VIPPO", "microsection", "No material", "SIGN-OFF")
    tools: tuple[str, ...] = ("validate_bringup.py", "bringup_results/template.csv")
    blocking: tuple[str, ...] = (".gts", ".gbs", ".drl")
    evidence: str = r"(?i)vippo_capability_\w+_\d{4}[-_]?\d{2}[-_]?\d{2}\.(pdf|png|txt|jpg|eml)$"
    least_bytes: int = 100
    evidence_words: tuple[str, ...] = ("IPC-4761", "Type VII")


MANIFEST = "files map<string,string>, git_sha string, build_timestamp_utc string, build_inputs map<string,string>"


def _lacking(values: tuple[str, ...], there) -> Column:
    """Those of the values for which there(value) doesn't hold, as an array."""
    return F.filter(F.array(*[F.when(~F.coalesce(there(v), F.lit(False)), F.lit(v)) for v in values]), lambda x: x.isNotNull())


def _text(member: str) -> Column:
    return F.max(F.when(F.col("member") == member, F.decode("content", "UTF-8")))


def _keywords(text: Column) -> Column:
    """How many entries the list required_keywords of a profile has: the lines below its name that begin with a dash, or what
    stands in brackets behind it."""
    block = F.regexp_extract(text, r"(?m)^[ ]*required_keywords:[ ]*\r?\n((?:[ ]*-[^\n]*(?:\n|$)|[ ]*#[^\n]*(?:\n|$)|[ ]*\r?\n)*)", 1)
    inline = F.regexp_extract(text, r"(?m)^[ ]*required_keywords:[ ]*\[([^\]]*)\]", 1)
    return F.regexp_count(block, F.lit(r"(?m)^[ ]*-")) + F.when(F.trim(inline) == "", 0).otherwise(F.size(F.split(inline, ",")))


def offenders(members: DataFrame, repository: DataFrame, baseline: DataFrame | None = None, head: str | None = None, board_sha256: str | None = None, profile: Profile = Profile()) -> DataFrame:
    """archive, gate and item of all that offends. members: as archives.members gives them; repository: path, content of the files that
    stand beside the packages (tools, evidence below an evidence folder); baseline: path, sha256. head and board_sha256: what the packages must have been
    built from; null asks nothing."""
    p = profile
    there = members.where("member IS NOT NULL AND error IS NULL")
    names = there.groupBy("archive").agg(
        F.collect_set("member").alias("names"), _text("fab_notes.txt").alias("notes"), _text("fab_profile.yaml").alias("about"), _text("vip_vias.csv").alias("vias"), _text("order_checklist.txt").alias("order"),
        F.from_json(_text("manifest.json"), MANIFEST).alias("m"), _text("manifest.json").isNotNull().alias("listed"),
    )  # fmt: skip  a package's own list of files
    known = members.select("archive").distinct()
    package = known.join(names, "archive", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    every, none = F.col("names"), F.array().cast("array<string>")

    def has(test) -> Column:
        return F.exists(every, test)

    lines = F.filter(F.split("vias", "\r?\n"), lambda x: F.trim(x) != "")
    header = F.transform(F.split(F.element_at(lines, 1), ","), lambda x: F.trim(x, F.lit('" ')))
    listed = F.coalesce(F.map_keys("m.files"), none)
    in_manifest = [f for f in p.files if f != "manifest.json"]
    found = {
        "files": _lacking(p.files, lambda f: F.array_contains(every, f)),
        "layers": _lacking(p.layers, lambda e: has(lambda n: n.startswith("gerbers/") & n.endswith(e))),
        "drill": _lacking((".drl",), lambda e: has(lambda n: n.startswith("drill/") & n.endswith(e))),
        "clauses": _lacking(p.clauses, lambda c: F.contains("notes", F.lit(c))),
        "keywords": _lacking((f"{p.least_keywords} keywords",), lambda _: F.col("about").isNull() | (_keywords(F.col("about")) >= p.least_keywords)),
        "vias": F.when(F.col("vias").isNotNull(), F.concat(_lacking(p.via_columns, lambda c: F.array_contains(header, c) | (F.size(lines) < 2)), _lacking((f"{p.least_vias} rows",), lambda _: F.size(lines) - 1 >= p.least_vias))),
        "checklist": F.when(F.col("order").isNotNull(), _lacking(p.checklist, lambda w: F.contains(F.lower("order"), F.lit(w.lower())))),
        "manifest": F.when(~F.coalesce("listed", F.lit(False)), F.array(F.lit("no manifest")))
        .when(F.col("m.files").isNull() | (F.size("m.files") == 0), F.array(F.lit("empty")))
        .otherwise(
            F.concat(
                _lacking(tuple(in_manifest), lambda f: F.array_contains(listed, f)), _lacking(p.layers, lambda e: F.exists(listed, lambda n: n.startswith("gerbers/") & n.endswith(e))),
                _lacking(("git_sha",), lambda _: F.coalesce("m.git_sha", F.lit("")) != ""), _lacking(("build_timestamp_utc",), lambda _: F.coalesce("m.build_timestamp_utc", F.lit("")) != ""),
                _lacking(("another commit",), lambda _: F.coalesce("m.git_sha", F.lit("")).isin("", "nogit", head)) if head else none,
            )
        ),
        "inputs": F.when(~F.coalesce("listed", F.lit(False)), none).when(F.size(F.coalesce(F.map_keys("m.build_inputs"), none)) == 0, F.array(F.lit("no build_inputs"))).otherwise(
            _lacking(("another board",), lambda _: F.coalesce(F.try_element_at("m.build_inputs", F.lit("board_sha256")), F.lit("")).isin("", board_sha256)) if board_sha256 else none
        ),
    }
    rows = F.flatten(F.array(*[F.transform(F.coalesce(v, none), _named(g)) for g, v in found.items()]))
    out = package.select("archive", F.explode(rows).alias("v")).select("archive", "v.gate", "v.item")

    # each file that a manifest names, against the archive's
    named = package.select("archive", F.explode("m.files").alias("member", "sha256"))
    stored = there.select("archive", "member", F.sha2("content", 256).alias("found"))
    differ = named.join(stored, ["archive", "member"], "left").where(F.col("found").isNull() | (F.col("found") != F.lower("sha256")))
    out = out.union(differ.select("archive", F.lit("manifest"), F.concat("member", F.when(F.col("found").isNull(), " is not there").otherwise(" differs"))))
    if baseline is not None:
        blocking = baseline.where(" OR ".join(f"path LIKE '%{e}'" for e in p.blocking)).select(F.col("path").alias("member"), F.col("sha256").alias("was"))
        out = out.union(stored.join(blocking, "member").where("found <> was").select("archive", F.lit("baseline"), "member"))
    return out.union(known.join(F.broadcast(_beside(repository, p)), F.lit(True)))  # as many rows as tools, words and evidence files


def _named(gate: str):
    return lambda item: F.struct(F.lit(gate).alias("gate"), item.alias("item"))


def _beside(repository: DataFrame, p: Profile) -> DataFrame:
    """gate and item of what the files beside the packages lack, which offends every package alike."""
    spark = repository.sparkSession
    tools = spark.createDataFrame([(t,) for t in p.tools], "path string").join(repository.select("path"), "path", "left_anti").select(F.lit("tools").alias("gate"), F.col("path").alias("item"))
    fit = repository.where(F.col("path").rlike(p.evidence))
    nothing = fit.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("evidence"), F.lit("no evidence file"))
    small = fit.where(F.coalesce(F.length("content"), F.lit(0)) < p.least_bytes).select(F.lit("evidence"), F.concat("path", F.lit(" is too small")))
    readable = fit.where(F.lower("path").rlike(r"\.(txt|eml)$")).withColumn("text", F.expr("CAST(content AS STRING)"))
    words = readable.select("path", F.explode(_lacking(p.evidence_words, lambda w: F.contains("text", F.lit(w)))).alias("w")).select(F.lit("evidence"), F.concat("path", F.lit(" lacks "), "w"))
    return tools.union(nothing).union(small).union(words)


def report(members: DataFrame, found: DataFrame) -> DataFrame:
    """archive, gate, offenders and passed of every package and gate."""
    every = members.select("archive").distinct().withColumn("gate", F.explode(F.array(*[F.lit(g) for g in GATES])))
    counted = found.groupBy("archive", "gate").agg(F.count("*").alias("offenders"))
    both = every.join(counted, ["archive", "gate"], "left").fillna(0, ["offenders"])
    return both.withColumn("passed", F.col("offenders") == 0)


def checked(spark, path: str, repository: DataFrame, **options) -> DataFrame:
    """The report of the packages at a path."""
    members = archives.members(spark, path)
    return report(members, offenders(members, repository, **options))
