"""The rules of a bring-up sheet: rows of measurements of a board, one file for each run. All columns are text, as in the file.

Fixed values, from the sheet's rules: limits, methods, units, channels and the columns themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscine.operators.suites import Rule, violations

COLUMNS = ("vendor", "order_id", "lot_id", "panel_id", "board_serial", "inspector", "date", "phase", "step", "channel", "result", "value", "unit", "method", "probe_from", "probe_to")
CHANNELS = tuple(f"CH{n}" for n in range(9, 23))
CONTINUITY_OHM, ISOLATION_MOHM = (0.05, 3.5), 50.0
CONTINUITY_METHODS, ISOLATION_METHODS = ("4W-Kelvin", "2W-probe"), ("100V-megger", "IR-DMM")
CONTINUITY_UNITS, ISOLATION_UNITS = ("Ω", "ohm", "Ohm", "OHM"), ("MΩ", "Mohm", "MOhm", "MOHM", "GΩ", "Gohm")
CONTINUITY, ISOLATION, SECTION = "5.1", "5.2", "3.2"
EVIDENCE = ("microsection", ".jpg", ".png", ".pdf", "evidence")


def _any(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _has(column: str) -> str:
    return f"coalesce(trim({column}), '') <> ''"


def suite(channels: tuple[str, ...] = CHANNELS) -> list[Rule]:
    """The rules of a sheet's rows, of its channels, and of the sheet as a whole. The expressions are plain SQL."""
    of = {CONTINUITY: f"trim(step) = '{CONTINUITY}' AND {_has('channel')}", ISOLATION: f"trim(step) = '{ISOLATION}' AND {_has('channel')}"}
    rules = [
        Rule("traceable", f"bool_or({_has('lot_id')} AND {_has('inspector')} AND {_has('date')})", "file"),
        Rule("vendor_known", f"bool_or({_has('vendor')})", "file"),
        Rule("order_known", f"bool_or({_has('order_id')})", "file"),
        Rule("one_lot", f"count(DISTINCT CASE WHEN {_has('lot_id')} THEN trim(lot_id) END) <= 1", "file"),
        Rule("one_order", f"count(DISTINCT CASE WHEN {_has('order_id')} THEN trim(order_id) END) <= 1", "file"),
        Rule("result_given", _has("result")),
        Rule("result_known", "upper(trim(result)) IN ('PASS', 'FAIL', 'N/A')", when=_has("result")),
        Rule("result_passes", "upper(trim(result)) <> 'FAIL'", when=_has("result")),
        Rule("section_passes", f"bool_or(trim(step) = '{SECTION}' AND upper(trim(result)) = 'PASS')", "file"),
        Rule("section_evidence", " OR ".join(f"lower(coalesce(notes, '')) LIKE '%{x}%'" for x in EVIDENCE), when=f"trim(step) = '{SECTION}'"),
    ]
    for name, step, methods, units in (("continuity", CONTINUITY, CONTINUITY_METHODS, CONTINUITY_UNITS), ("isolation", ISOLATION, ISOLATION_METHODS, ISOLATION_UNITS)):
        when = of[step]
        rules += [
            Rule(f"{name}_method", f"trim(method) IN ({_any(methods)})", when=when),
            Rule(f"{name}_unit", f"trim(unit) IN ({_any(units)})", when=when),
            Rule(f"{name}_probes", f"{_has('probe_from')} AND {_has('probe_to')}", when=when),
            Rule(f"{name}_numeric", "try_cast(value AS DOUBLE) IS NOT NULL", when=when),
        ]
    both = f"{_has('probe_from')} AND {_has('probe_to')}"
    number = "try_cast(value AS DOUBLE)"
    low, high = CONTINUITY_OHM
    rules += [
        Rule("continuity_ends", "substr(trim(probe_from), 1, 3) IN ('J5.', 'U1.') AND substr(trim(probe_to), 1, 3) IN ('J5.', 'U1.')", when=f"{of[CONTINUITY]} AND {both}"),
        Rule("isolation_ends", "substr(trim(probe_from), 1, 3) = 'J5.' AND upper(probe_to) LIKE '%GND%'", when=f"{of[ISOLATION]} AND {both}"),
        Rule("continuity_bounds", f"{number} >= {low} AND {number} <= {high}", when=f"{of[CONTINUITY]} AND {number} IS NOT NULL"),
        Rule("isolation_bounds", f"{number} >= {ISOLATION_MOHM}", when=f"{of[ISOLATION]} AND {number} IS NOT NULL"),
        Rule("channel_measured_twice", f"bool_or(trim(step) = '{CONTINUITY}') = bool_or(trim(step) = '{ISOLATION}')", "group", key=f"CASE WHEN trim(channel) IN ({_any(channels)}) THEN trim(channel) END"),
    ]
    for name, step in (("continuity", CONTINUITY), ("isolation", ISOLATION)):
        rules.append(Rule(f"{name}_complete", f"array_except(array({_any(channels)}), collect_set(CASE WHEN trim(step) = '{step}' THEN trim(channel) END))", "each"))
    return rules


def missing_columns(sheet: DataFrame) -> list[str]:
    return sorted(set(COLUMNS) - set(sheet.columns))


def check(sheet: DataFrame, file: str = "file", row: str = "row", channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """file, row, rule, level and item of each violation; a sheet without one of the columns is an error, as no rule can be asked.
    The channel rule leaves out rows of no channel that must be there."""
    if absent := missing_columns(sheet):
        raise ValueError(f"missing columns: {absent}")
    full = sheet if "notes" in sheet.columns else sheet.withColumn("notes", F.lit(None).cast("string"))
    found = violations(full, suite(channels), file, row)
    return found.where(~((F.col("rule") == "channel_measured_twice") & F.col("item").isNull()))


def evidence(sheet: DataFrame, files: DataFrame, patterns: tuple[str, ...] = ("microsection",), file: str = "file") -> DataFrame:
    """file, rule and item of what evidence a run lacks; files: file, name. A pattern must be in a name, and a microsection's
    name must hold a lot of the run's."""
    runs = sheet.groupBy(file).agg(F.collect_set(F.nullif(F.trim("lot_id"), F.lit(""))).alias("lots"))
    names = files.groupBy(file).agg(F.collect_set("name").alias("names"))  # the photographs of one board's run
    both = runs.join(names, file, "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    lacking = F.array(*[F.when(~_in_names(p), F.lit(p)) for p in patterns])
    absent = both.select(file, F.explode(F.filter(lacking, lambda x: x.isNotNull())).alias("item")).select(file, F.lit("evidence_file").alias("rule"), "item")
    sections = F.filter("names", lambda n: n.contains("microsection"))
    named = F.exists(sections, lambda n: F.exists("lots", lambda x: n.contains(x)))
    unnamed = both.where((F.size("lots") > 0) & (F.size("names") > 0) & ~named).select(file, F.lit("evidence_lot").alias("rule"), F.array_join(F.array_sort("lots"), ",").alias("item"))
    return absent.union(unnamed)


def _in_names(pattern: str):
    return F.exists("names", lambda n: n.contains(pattern))
