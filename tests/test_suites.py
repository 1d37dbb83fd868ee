"""Rule suites: a sheet that breaks nothing, and one change for each rule that breaks it."""

import pytest

from oscine.operators import bringup, suites
from oscine.operators.suites import Rule

NAMES = [*bringup.COLUMNS, "notes"]
SCHEMA = "file string, row int, " + ", ".join(f"`{n}` string" for n in NAMES)


def _sheet():
    base = dict.fromkeys(NAMES, "") | {"vendor": "V", "order_id": "O", "lot_id": "L1", "inspector": "I", "date": "2024-01-01", "result": "PASS", "phase": "5"}
    rows = [base | {"step": "3.2", "notes": "see microsection_L1.jpg"}]
    for c in bringup.CHANNELS:
        rows.append(base | {"step": "5.1", "channel": c, "method": "4W-Kelvin", "unit": "Ω", "value": "1.5", "probe_from": "J5.1", "probe_to": "U1.2"})
        rows.append(base | {"step": " 5.2 ", "channel": c, "method": "IR-DMM", "unit": "GΩ", "value": "50", "probe_from": "J5.1", "probe_to": "j5.gnd", "result": "n/a"})
    return rows


def _all(**values):
    return lambda rows: [r | values for r in rows]


def _one(k, **values):
    return lambda rows: [r | values if i == k else r for i, r in enumerate(rows)]


#: Rows 1 and 2 are the first channel's continuity and isolation.
BROKEN = {
    "traceable": _all(inspector=" "), "vendor_known": _all(vendor=None), "order_known": _all(order_id=""), "one_lot": _one(3, lot_id="L2"), "one_order": _one(3, order_id="P"),
    "result_given": _one(4, result=" "), "result_known": _one(4, result="ok"), "result_passes": _one(4, result="fail"), "section_passes": _one(0, result="N/A"), "section_evidence": _one(0, notes="later"),
    "continuity_method": _one(1, method="guess"), "continuity_unit": _one(1, unit="MΩ"), "continuity_probes": _one(1, probe_to=""), "continuity_numeric": _one(1, value="low"),
    "isolation_method": _one(2, method=""), "isolation_unit": _one(2, unit="Ω"), "isolation_probes": _one(2, probe_from=None), "isolation_numeric": _one(2, value=""),
    "continuity_ends": _one(1, probe_from="X1.1"), "isolation_ends": _one(2, probe_to="J5.2"), "continuity_bounds": _one(1, value="3.6"), "isolation_bounds": _one(2, value="49.9"),
    "channel_measured_twice": lambda rows: rows[:1] + rows[2:], "continuity_complete": lambda rows: rows[:1] + rows[2:], "isolation_complete": lambda rows: rows[:2] + rows[3:],
}


def test_every_rule_has_a_sheet_that_breaks_it(spark):
    assert set(BROKEN) == {r.name for r in bringup.suite()}
    rows = [("good", i, *[r[n] for n in NAMES]) for i, r in enumerate(_sheet())]
    for name, change in BROKEN.items():
        rows += [(name, i, *[r[n] for n in NAMES]) for i, r in enumerate(change(_sheet()))]
    low = _one(1, value="0.01")(_sheet())
    rows += [("short", i, *[r[n] for n in NAMES]) for i, r in enumerate(low)]
    found = {}
    for r in bringup.check(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault(r.file, set()).add((r.rule, r.row, r.item))
    assert "good" not in found
    assert found.pop("short") == {("continuity_bounds", "1", None)}
    also = {"section_passes": set(), "channel_measured_twice": {"continuity_complete"}, "continuity_complete": {"channel_measured_twice"}, "isolation_complete": {"channel_measured_twice"}}
    assert {f: {rule for rule, _, _ in v} for f, v in found.items()} == {n: {n} | also.get(n, set()) for n in BROKEN}
    assert found["continuity_complete"] == {("continuity_complete", None, "CH9"), ("channel_measured_twice", None, "CH9")}
    assert found["result_given"] == {("result_given", "4", None)} and found["one_lot"] == {("one_lot", None, None)}


def test_sheets_without_columns_or_rows(spark):
    sheet = spark.createDataFrame([("a", 0, *[None] * len(NAMES))], SCHEMA)
    with pytest.raises(ValueError, match="probe_to"):
        bringup.check(sheet.drop("probe_to"))
    assert bringup.check(sheet.limit(0)).count() == 0
    assert {r.rule for r in bringup.check(sheet.drop("notes")).collect()} >= {"traceable", "result_given", "isolation_complete"}


def test_evidence(spark):
    rows = [(f, 0, *[{"lot_id": lot}.get(n) for n in NAMES]) for f, lot in (("a", "L1"), ("b", "L2"), ("c", "L3"), ("d", None))]
    files = spark.createDataFrame([("a", "microsection_J5_L1.jpg"), ("b", "microsection_J5.jpg"), ("c", "photo.jpg")], "file string, name string")
    found = bringup.evidence(spark.createDataFrame(rows, SCHEMA), files).collect()
    assert {(r.file, r.rule, r["item"]) for r in found} == {("b", "evidence_lot", "L2"), ("c", "evidence_file", "microsection"), ("c", "evidence_lot", "L3"), ("d", "evidence_file", "microsection")}


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([("small", "x < 10", None, "x IS NOT NULL", None, "WARN"), ("even_sum", "sum(x) % 2 = 0", "group", None, "k", None), ("few", "count(*) <= 4", "file", None, None, None), ("odd", "collect_set(CASE WHEN x % 2 = 1 THEN x END)", "each", None, None, None)], "name string, holds string, scope string, when string, key string, level string")
    rows = spark.createDataFrame([("f", 1, "p", 3), ("f", 2, "p", 12), ("f", 3, "q", 4), ("g", 4, "q", None)], "file string, row int, k string, x int")
    found = suites.violations(rows, suites.from_table(table), "file", "row").collect()
    assert {(r.file, r.row, r.rule, r.level, r["item"]) for r in found} == {("f", "2", "small", "WARN", None), ("f", None, "even_sum", "FAIL", "p"), ("g", None, "even_sum", "FAIL", "q"), ("f", None, "odd", "FAIL", "3")}
    assert suites.violations(rows, [], "file", "row").count() == 0
    with pytest.raises(ValueError, match="different names"):
        suites.violations(rows, [Rule("a", "true"), Rule("a", "false")], "file", "row")
    with pytest.raises(ValueError, match="scopes"):
        suites.violations(rows, [Rule("a", "true", "sheet")], "file", "row")
