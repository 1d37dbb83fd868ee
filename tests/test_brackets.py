"""Trees of bracketed texts against a plain reader, edits, and checks that fail once what they need is gone."""

import random

import pytest
from pyspark.sql import functions as F

from oscine.operators import schematic
from oscine.sources import brackets, reports


def _plain(text):
    data, stack, out, quoted, escape = text.encode(), [], [], False, False
    for i, c in enumerate(data):
        if c == 34 and not escape:
            quoted = not quoted
        elif not quoted and c == 40:
            stack.append(i)
        elif not quoted and c == 41 and stack:
            begin = stack.pop()
            out.append((begin, i + 1, len(stack), stack[-1] if stack else None))
        escape = c == 92 and not escape
    return sorted(out)


def _balanced(rng, depth=0):
    parts = ["(", rng.choice(["net", "pad", "é", "via"]), rng.choice([" ", "\n", "\t"])]
    for _ in range(rng.randrange(4)):
        parts.append(rng.choice(['"a (b"', '"x\\\\"', '"q\\") ("', " 1.5 ", "word\n", _balanced(rng, depth + 1) if depth < 5 else ""]))
    return "".join([*parts, ")"])


def test_elements():
    rng = random.Random(4)
    texts = ["", "plain", "()", "(a)(b)", '(a "(" (b))', '("")', '(a "\\\\" (b))'] + [" ".join(_balanced(rng) for _ in range(3)) for _ in range(200)]
    for text in texts:
        begin, end, depth, parent = brackets.elements(text.encode())
        got = [(int(a), int(b), int(d), int(begin[p]) if p >= 0 else None) for a, b, d, p in zip(begin, end, depth, parent, strict=True)]
        assert got == _plain(text), text
    assert [len(brackets.elements(t)[0]) for t in (b"(a (b)", b"a) (b)", b")(")] == [1, 1, 0]


def test_nested_blocks():
    text = '(board (net 0 "") (net 1 "a (net 5)") (network 3) (pad (net 2) (pad (net 3))) (pad\n x))'
    assert brackets.nested(text, "net") == ['(net 0 "")', '(net 1 "a (net 5)")', "(net 2)", "(net 3)"]
    assert brackets.nested(text, "pad") == ["(pad (net 2) (pad (net 3)))", "(pad\n x)"]
    assert brackets.nested(None, "net") == [] and brackets.nested("(net", "net") == []


def test_tree_and_edits(spark):
    texts = spark.createDataFrame([("a", "(x é (y 1) (y 2 (z)))\n(w)"), ("b", ""), ("c", None), ("d", "(y)")], "name string, text string")
    rows = brackets.tree(texts, "name", "text").collect()
    assert {(r.name, r.first, r.last, r.depth, r.parent, r.head) for r in rows} == {("a", 0, 22, 0, None, "x"), ("a", 6, 11, 1, 0, "y"), ("a", 12, 21, 1, 0, "y"), ("a", 17, 20, 2, 12, "z"), ("a", 23, 26, 0, None, "w"), ("d", 0, 3, 0, None, "y")}
    found = brackets.tree(texts, "name", "text")
    left = brackets.without(texts, found.where("head IN ('y', 'z')"), "name", "text")
    assert {tuple(r) for r in left.collect()} == {("a", "(x é  )\n(w)"), ("b", ""), ("c", None), ("d", "")}
    assert {tuple(r) for r in brackets.without(texts, found.limit(0), "name", "text").collect()} == {tuple(r) for r in texts.collect()}


BOARD = """(kicad_pcb (net 0 "") (net 1 "GND") (net 2 "V")
  (footprint "R" (at 10 20) (property "Reference" "R1") (pad "1" smd rect (at 0 -1) (size 1 1) (layers "F.Cu") (net 1 "GND")) (pad "2" smd rect (at 0 1) (size 1 1) (layers "F.Cu") (net 2 "V")))
  (footprint "C" (at 30 20) (property "Reference" "C1") (pad "1" smd rect (at 0 0) (size 1 1) (layers "F.Cu") (net 1 "GND"))))"""


def test_every_pad_once_removed_fails_its_check(spark, tmp_path):
    (tmp_path / "a.kicad_pcb").write_text(BOARD)
    required = spark.createDataFrame([("R1", "1", "GND"), ("R1", "2", "V"), ("C1", "1", "GND")], "ref string, pin string, net_name string")
    assert reports.pads_off_net(required, reports.pads(spark, str(tmp_path / "a.kicad_pcb"))).count() == 0
    texts = spark.createDataFrame([("a", BOARD)], "name string, text string")
    pads = [tuple(r) for r in brackets.tree(texts, "name", "text").where("head = 'pad'").orderBy("first").select("name", "first", "last").collect()]
    assert len(pads) == 3
    for pad, want in zip(pads, required.collect(), strict=True):
        gone = spark.createDataFrame([pad], "name string, first long, last long")
        (tmp_path / "b.kicad_pcb").write_text(brackets.without(texts, gone, "name", "text").first().text)
        off = reports.pads_off_net(required, reports.pads(spark, str(tmp_path / "b.kicad_pcb"))).collect()
        assert [(r.ref, r.pin) for r in off] == [(want.ref, want.pin)]


GOOD = [("+3V3", "FB1", "2"), ("VDD", "FB1", "1"), ("VDD", "U1", "M15"), ("GND", "C1", "2"), ("SIG", "TP1", "1"), ("REF", "U1", "N17"), ("unconnected-(U9)", "U9", "3")]
BAD = {
    "test_point": ({("SIG", "TP1", "1")}, {("unconnected-(TP1)", "TP1", "1")}, {("test_point", "TP1", "1"), ("unconnected", "TP1", "1")}), "lost": ({("SIG", "TP1", "1")}, set(), {("test_point", "TP1", "1")}),
    "chain": ({("GND", "C1", "2")}, {("GND", "C1", "1")}, {("not_on_net", "C1", "2")}), "no_net": ({("GND", "C1", "2")}, set(), {("no_net", None, None)}),
    "loose": (set(), {("unconnected-(U2)", "U2", "7")}, {("unconnected", "U2", "7")}), "bridge": ({("VDD", "FB1", "1")}, {("GND", "FB1", "1")}, {("bridge", "FB1", "1")}),
    "reference": ({("REF", "U1", "N17")}, {("GND", "U1", "N17")}, {("bridge", "U1", "N17")}), "isolation": ({("VDD", "U1", "M15")}, {("+3V3", "U1", "M15")}, {("isolation", "U1", "M15")}),
}


@pytest.mark.parametrize("name", ["good", *BAD])
def test_schematic_checks(spark, name):
    gone, more, want = BAD.get(name, (set(), set(), set()))
    nets = spark.createDataFrame([x for x in GOOD if x not in gone] + sorted(more), "net string, ref string, pin string")
    components = spark.createDataFrame([("TP1",), ("U1",), ("FB1",)], "ref string")
    pad = "ref string, pin string, net string"
    found = schematic.check(
        nets, components, spark.createDataFrame([("GND", "C1", "2")], "net string, ref string, pin string"), spark.createDataFrame([("U9", "3")], "ref string, pin string"),
        spark.createDataFrame([("FB1", "2", "+3V3"), ("FB1", "1", "VDD"), ("U1", "N17", "REF")], pad), spark.createDataFrame([("U1", "M15", "+3V3")], pad),
    )
    assert {(r.check, r.ref, r.pin) for r in found.select(F.col("check"), "ref", "pin").collect()} == want


def test_many_texts_at_once():
    import numpy as np

    texts = ["", '(a "(b" (c))', "(open (x)", '"half (q', "(a (b) (c (d)))", "tail\\", '"(y)" (z)', ")(w)", "", "((p))", "(é (ß))"]
    data = [t.encode() for t in texts]
    starts = np.cumsum([0] + [len(d) for d in data[:-1]])
    got = [tuple(r) for r in np.column_stack(brackets.elements(b"".join(data), starts)).tolist()]
    want = []
    for d, at in zip(data, starts.tolist()):
        n = len(want)
        want += [(a + at, b + at, depth, -1 if p < 0 else p + n) for a, b, depth, p in np.column_stack(brackets.elements(d)).tolist()]
    assert got == want and len(want) > 12
