"""Copper graphs and joins in the plane against plain versions."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from oscine.operators import copper, geometry, graph
from oscine.plans import base


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("kind", ["random", "path", "star", "empty", "loops"])
def test_components(spark, kind):
    rng = random.Random(1)
    pairs = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], "path": [(i, i + 1) for i in rng.sample(range(200), 190)],
        "star": [(0, i) for i in range(1, 500)] + [(700, i) for i in range(701, 900)] + [(700, 499)], "empty": [], "loops": [(5, 5), (6, 7), (7, 6), (6, 6), (None, 3), (9, None)],
    }[kind]
    plain = Union()
    for a, b in pairs:
        if a is not None and b is not None:
            plain.join(a, b)
    found = graph.components(spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert {r.node: r.component for r in found} == {x: plain.find(x) for x in list(plain.up)} and len(found) == len(plain.up)


SHAPES = "id long, net long, layer string, ax double, ay double, bx double, by double, half double"


def _to_segment(px, py, ax, ay, bx, by):
    d = (bx - ax) ** 2 + (by - ay) ** 2
    t = max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / d)) if d else 0
    return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))


def _gap(a, b):
    p, q = a[3:7], b[3:7]

    def turn(ax, ay, bx, by, cx, cy):
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    if turn(*p, *q[:2]) * turn(*p, *q[2:]) < 0 and turn(*q, *p[:2]) * turn(*q, *p[2:]) < 0:
        return -a[7] - b[7]
    return min(_to_segment(*p[:2], *q), _to_segment(*p[2:], *q), _to_segment(*q[:2], *p), _to_segment(*q[2:], *p)) - a[7] - b[7]


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(2)
    out = []
    for i in range(260):
        net, layer = rng.randrange(6), rng.choice(["F", "B"])
        x, y = rng.randrange(14), rng.randrange(14)
        dx, dy = rng.choice([(3, 0), (0, 2), (2, 2), (0, 0), (-2, 1)])
        for on in ("F", "B") if (dx, dy) == (0, 0) else (layer,):  # a point is a via
            out.append((i, net, on, float(x), float(y), float(x + dx + rng.choice([0, 1e-6, 0.3])), float(y + dy), rng.choice([0.1, 0.4])))
    out += [(1000 + i, 9, "F", 1.0, 1.0, 1.0, 1.0, 0.1) for i in range(300)]  # many at one point
    return out


def _islands(shapes, touching):
    plain = Union()
    ends = defaultdict(list)
    for s in shapes:
        plain.find(s[0])
        for x, y in (s[3:5], s[5:7]):
            ends[s[1], s[2], round(x / 5e-5), round(y / 5e-5)].append(s[0])
    for ids in ends.values():
        for i in ids[1:]:
            plain.join(ids[0], i)
    if touching:
        for k, a in enumerate(shapes):
            for b in shapes[:k]:
                if a[1:3] == b[1:3] and _gap(a, b) <= 0:
                    plain.join(a[0], b[0])
    return {(s[0], s[1], plain.find(s[0])) for s in shapes}


@pytest.mark.parametrize("touching", [False, True])
def test_islands(spark, shapes, touching):
    df = spark.createDataFrame(shapes, SHAPES).repartition(3)
    found = copper.islands(df, touching=touching, cell=2.5)
    want = _islands(shapes, touching)
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    sizes = Counter((net, island) for _, net, island in want)
    report = {r.net: (r.elements, r.islands, r.largest) for r in copper.island_report(found).collect()}
    assert report == {n: (sum(c for (m, _), c in sizes.items() if m == n), sum(m == n for m, _ in sizes), max(c for (m, _), c in sizes.items() if m == n)) for n in {n for _, n, _ in want}}


def test_links_at_one_point_stay_few(spark):
    df = spark.createDataFrame([(i, 1, "F", 0.0, 0.0, 0.0, 0.0, 0.1) for i in range(500)], SHAPES)
    assert copper.links(df, touching=True).count() == 499
    assert copper.islands(df.limit(0)).count() == 0


def test_pads_and_proofs(spark):
    segments = spark.createDataFrame([(1, 1, "F.Cu", 0.0, 0.0, 5.0, 0.0, 0.2), (2, 1, "B.Cu", 5.0, 0.0, 5.0, 5.0, 0.2), (3, 1, "F.Cu", 9.0, 9.0, 9.0, 8.0, 0.2)], "id long, net int, layer string, ax double, ay double, bx double, by double, width double")
    vias = spark.createDataFrame([(4, 1, 5.0, 0.0, 0.6, ["F.Cu", "B.Cu"])], "id long, net int, x double, y double, size double, layers array<string>")
    pads = spark.createDataFrame([("A1", 1, 0.0, 1e-5, ["F.Cu"], 5, 1.0, 0.5), ("B1", 1, 5.0, 5.0, ["F.Cu"], 6, 0.5, 1.0), ("C1", 1, 9.0, 8.0, ["F.Cu"], 7, 0.5, 0.5), ("D1", 1, 3.0, 3.0, ["F.Cu"], 8, 0.5, 0.5)], "pad string, net int, x double, y double, layers array<string>, id long, width double, height double")
    found = copper.shapes(segments, vias, pads.limit(0))
    parts = copper.islands(found)
    assert {r.pad: (r.layer, r.element) for r in copper.pad_nodes(pads, found).collect()} == {"A1": ("F.Cu", 1), "B1": ("B.Cu", 2), "C1": ("F.Cu", 3), "D1": (None, None)}
    required = spark.createDataFrame([("A1", "B1"), ("A1", "C1"), ("A1", "D1")], "pad string, other string")
    assert {(r.other, r.reason) for r in copper.unproved(required, pads, found, parts).collect()} == {("C1", "apart"), ("D1", "no copper")}
    without_via = copper.shapes(segments, vias.limit(0), pads.limit(0))  # an element removed, the proof must fail
    assert ("B1", "apart") in {(r.other, r.reason) for r in copper.unproved(required, pads, without_via, copper.islands(without_via)).collect()}
    lengths = spark.createDataFrame([(1, "spi", 5.0), (2, "spi", 5.0), (3, "spi", 1.0)], "id long, bus string, length double")
    assert tuple(copper.skew(parts.withColumn("net", F.when(F.col("id") == 3, 2).otherwise(F.col("net"))), lengths, "bus").first()) == ("spi", 10.0, 1.0, 9.0)
    landed = {r.id: (r.ax, r.ay, r.bx, r.by, r.half) for r in copper.shapes(segments.limit(0), vias.limit(0), pads).collect()}
    assert landed[5] == (-0.25, 1e-5, 0.25, 1e-5, 0.25) and landed[6] == (5.0, 4.75, 5.0, 5.25, 0.25)


@pytest.mark.parametrize("cell", [0.7, 3.0, 100.0])
def test_near_shapes(spark, shapes, cell):
    df = spark.createDataFrame(shapes, SHAPES)
    want = {(min(a[0], b[0]), max(a[0], b[0]), a[2], round(_gap(a, b), 9)) for k, a in enumerate(shapes) for b in shapes[:k] if a[2] == b[2] and a[1] != b[1] and _gap(a, b) <= 0.25}
    rows = geometry.near_shapes(df, df, ["layer"], 0.25, cell, unlike="net").collect()
    assert {(r.id, r.id_r, r.layer, round(r.gap, 9)) for r in rows} == want and len(rows) == len(want) > 100


def _value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("segment,length", [((0, 0, 10, 0), 4), ((0, 3, 10, 3), 4), ((0, 4, 10, 4), 0), ((5, 5, 5, -5), 3), ((3, 3, 3, 3), 0), ((0, 0, 6, 6), 3 * 2**0.5 - 2**0.5 * 2), ((6, 0, 9, 0), 0), ((8, 1, 7, 1), 0), ((4, 1, 5, 2), 2**0.5)])
def test_clipping(spark, segment, length):
    box = (2, 0, 6, 3)
    found = _value(spark, geometry.clipped_length(*[F.lit(float(v)) for v in (*segment, *box)]))
    steps = 20000
    ax, ay, bx, by = segment
    inside = sum(box[0] <= ax + (bx - ax) * k / steps <= box[2] and box[1] <= ay + (by - ay) * k / steps <= box[3] for k in range(steps))
    assert found == pytest.approx(length) and found == pytest.approx(inside / steps * math.hypot(bx - ax, by - ay), abs=2e-3)


@pytest.mark.parametrize("a,b,shared", [((0, 0, 10, 0), (2, 1, 5, 1), 3), ((0, 0, 10, 0), (5, 1, 2, 1), 3), ((0, 0, 10, 0), (8, 1, 15, 1), 2), ((0, 0, 10, 0), (11, 1, 15, 1), 0), ((0, 0, 10, 0), (2, 1, 5, 2), 0), ((0, 0, 0, 0), (0, 0, 1, 0), 0), ((0, 0, 3, 3), (1, 2, 3, 4), 2**0.5 * 1.5)])
def test_parallel_overlap(spark, a, b, shared):
    assert _value(spark, geometry.parallel_overlap(*[F.lit(float(v)) for v in (*a, *b)])) == pytest.approx(shared)


def test_contained(spark):
    rng = random.Random(6)
    areas = [(k, "F", [(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(rng.choice([3, 4, 7]))]) for k in range(25)]
    areas += [(90, "F", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), (91, "F", [(1.0, 1.0), (2.0, 2.0)]), (92, "F", []), (93, "B", [(0.0, 0.0), (9.0, 0.0), (0.0, 9.0)])]
    points = [(i, "F", rng.uniform(-1, 21), rng.uniform(-1, 21)) for i in range(300)] + [(900, "F", 0.0, 0.0), (901, "F", 4.0, 4.0), (902, "F", None, 1.0), (903, "B", 1.0, 1.0)]

    def inside(x, y, corners):
        odd = False
        for (px, py), (qx, qy) in zip(corners, corners[1:] + corners[:1]):
            if (py > y) != (qy > y) and x < px + (y - py) / (qy - py) * (qx - px):
                odd = not odd
        return odd

    want = {(i, k) for i, on, x, y in points if x is not None for k, layer, corners in areas if on == layer and len(corners) > 2 and inside(x, y, corners)}
    found = geometry.contained(spark.createDataFrame(points, "id long, layer string, x double, y double"), spark.createDataFrame(areas, "area long, layer string, corners array<struct<x:double,y:double>>"), ["layer"], 1.7).collect()
    assert {(r.id, r.area) for r in found} == want and len(found) == len(want)
    assert (900, 90) in want and (901, 90) not in want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_alike_areas(spark):
    square, other = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]
    areas = spark.createDataFrame([(k, "F" if k % 2 else "B", square if k % 3 else other) for k in range(60)] + [(1, "F", other)], "area long, layer string, corners array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(7, "F", 3.0, 3.0), (8, "F", 1.0, 1.0), (9, "B", 9.0, 9.0)], "id long, layer string, x double, y double")
    found = geometry.contained(points, areas, ["layer"], 2.0)
    want = sorted([(7, k) for k in range(60) if k % 2 and k % 3] + [(8, k) for k in range(60) if k % 2] + [(8, 1)])
    assert sorted((r.id, r.area) for r in found.collect()) == want
    assert "keys=[layer" in _plan(found)  # a shape meets the points once


def test_gap_is_worked_out_once(spark, shapes):
    df = spark.createDataFrame(shapes, SHAPES)
    plan = geometry.near_shapes(df, df, ["layer"], 0.25, 3.0, unlike="net")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("SIGNUM" in line for line in plan.splitlines()) == 1
    assert sum("HYPOT" in line for line in plan.splitlines()) == 1  # not for pairs that aren't parallel, ahead of the result


def test_quickly_rounded(spark):
    rng = random.Random(8)
    values = [0.0, -0.0, None, math.nan, math.inf, -math.inf, 1e300, -1e11, 99999.9999995, 100000.0000005, 0.0000005, -0.0000005, 0.1234565, -0.1234565, 2.5e-7, 5e-324]
    values += [rng.uniform(-10, 10) for _ in range(2000)] + [rng.randrange(-(10**7), 10**7) / 1e6 + rng.choice([0, 5e-7, -5e-7, 4.9999e-7, 1e-16]) for _ in range(2000)] + [math.sqrt(k / 100) - 0.1 for k in range(1000)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double")
    quick, plain = ([(r.k, repr(r.x)) for r in base.__dict__[f](df, "x").orderBy("k").collect()] for f in ("quickly_rounded", "rounded"))
    assert quick == plain


def test_pairs_are_dealt(spark, shapes):
    from oscine.operators import relational

    df = spark.createDataFrame(shapes, SHAPES)
    near = geometry.near_shapes(df, df, ["layer"], 0.25, 3.0, unlike="net")
    assert "SortMergeJoin" in _plan(near) and "Broadcast" not in _plan(near)
    points = df.select("id", "net", "ax", "ay")
    pairs = relational.near_pairs(points, points, ["net"], "ax", "ay", 1.0)
    assert "SortMergeJoin" in _plan(pairs) and "Broadcast" not in _plan(pairs)


def test_small_nets_are_dealt_once(spark, shapes, monkeypatch):
    few = shapes[:120] + [(5000, None, "F", 0.0, 0.0, 1.0, 0.0, 0.1), (5001, None, "F", 0.0, 0.0, 1.0, 0.0, 0.1), (5002, 8, "F", None, 0.0, 1.0, 0.0, 0.1), (5003, 8, "F", 1.0, 0.0, 2.0, 0.0, 0.1)]
    df = spark.createDataFrame(few, SHAPES).repartition("net")
    found = copper.islands(df, touching=True)
    got = {(r.id, r.net, r.island) for r in found.collect()}
    assert {(5000, None, 5000), (5001, None, 5001), (5003, 8, 5002)} <= got
    assert "Join" not in _plan(found)
    monkeypatch.setattr(copper, "WHOLE", 0)
    assert {(r.id, r.net, r.island) for r in copper.islands(df, touching=True).collect()} == got
