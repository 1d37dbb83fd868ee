"""Board queries over the order tables: an order is a net, its lines are tracks, returned ones end in a via, and the order has a
pad; and orders as tracks of customers' nets on one large board. SQL meets all pairs of a net or of a layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from oscine.operators import copper, geometry
from oscine.plans.base import quickly_rounded, rounded, table


def _copper(spark, sf_dir):
    """Shapes of the nets: id, net, layer, ax, ay, bx, by, half."""
    # both tables are dealt by net, which all that follows goes by
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("long").alias("q"), F.max("l_returnflag").alias("f")
    )
    ax, ay = (F.col("l_linenumber") + F.col("p") % 2) * 2.0, F.col("s") % 3 * 1.5
    tracks = lines.select(
        ((F.col("l_orderkey") * 16 + F.col("l_linenumber")) * 2).alias("id"), F.col("l_orderkey").alias("net"), F.when(F.col("s") % 4 < 3, "F.Cu").otherwise("B.Cu").alias("layer"),
        ax.alias("ax"), ay.alias("ay"), (ax + F.col("q") % 3 * 2.0).alias("bx"), (ay + F.col("q") % 2 * 1.5).alias("by"), F.lit(0.25).alias("width"), "f",
    )
    both = F.array(F.lit("F.Cu"), F.lit("B.Cu"))
    vias = tracks.where("f = 'R'").select((F.col("id") + 1).alias("id"), "net", F.col("bx").alias("x"), F.col("by").alias("y"), F.lit(0.6).alias("size"), both.alias("layers"))
    pads = table(spark, sf_dir, "orders").repartition("o_orderkey").select((-F.col("o_orderkey") - 1).alias("id"), F.col("o_orderkey").alias("net"), F.lit(4.0).alias("x"), (F.col("o_custkey") % 3 * 1.5).alias("y"), F.lit(1.0).alias("width"), F.lit(2.5).alias("height"), F.array(F.lit("F.Cu")).alias("layers"))
    return copper.shapes(tracks.drop("f"), vias, pads)


def copper_islands(spark, sf_dir):
    """Every element's island, where ends meet."""
    return copper.islands(_copper(spark, sf_dir))


def copper_touching(spark, sf_dir):
    """Islands of every net where shapes touch."""
    return copper.island_report(copper.islands(_copper(spark, sf_dir), touching=True))


def pad_copper(spark, sf_dir):
    """The copper at each order's pad, on its own layer before others."""
    found = _copper(spark, sf_dir).where("id >= 0")
    pads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pad"), F.col("o_orderkey").alias("net"), F.lit(4.0).alias("x"), (F.col("o_custkey") % 3 * 1.5).alias("y"), F.array(F.lit("F.Cu")).alias("layers"))
    return copper.pad_nodes(pads, found)


def _tracks(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    ax, ay, length = o * 3701 % 20011 / 100.0, o * 1013 % 19997 / 100.0, (c * 7 + o) % 50 / 10.0
    return table(spark, sf_dir, "orders").select(
        o.alias("id"), c.alias("net"), F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "F.Cu").otherwise("B.Cu").alias("layer"), ax.alias("ax"), ay.alias("ay"),
        F.when(o % 3 == 1, ax).otherwise(ax + length).alias("bx"), F.when(o % 3 == 0, ay).otherwise(ay + length).alias("by"), (0.05 + c % 3 * 0.05).alias("half"),
    )


def track_clearance(spark, sf_dir):
    """Tracks of different nets on one layer that are closer than allowed, and how long they run side by side."""
    tracks = _tracks(spark, sf_dir)
    return quickly_rounded(geometry.near_shapes(tracks, tracks, ["layer"], 0.2, 4.0, unlike="net"), "gap", "side_by_side")


def keepout_vias(spark, sf_dir):
    """Track ends inside the keep-out areas of their layer: a quadrilateral for each supplier, which need not be convex."""
    k = F.col("s_suppkey")
    x, y = k * 17.0 % 190, k * 29.0 % 190
    corners = [(x, y), (x + 6 + k % 5, y + 1), (x + 3, y + 3), (x + 1, y + 7 + k % 3)]
    areas = table(spark, sf_dir, "supplier").select(k.alias("area"), F.when(k % 2 == 0, "F.Cu").otherwise("B.Cu").alias("layer"), F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in corners]).alias("corners"))
    points = _tracks(spark, sf_dir).select("id", "layer", F.col("bx").alias("x"), F.col("by").alias("y"))
    return geometry.contained(points, areas, ["layer"], 8.0)


def corridor_length(spark, sf_dir):
    """Length of each net's tracks within a corridor across the board."""
    ends = [F.col(c) for c in geometry.ENDS]
    inside = geometry.clipped_length(*ends, *[F.lit(v) for v in (40.0, 0.0, 90.0, 120.0)])
    return rounded(_tracks(spark, sf_dir).groupBy("net").agg(F.sum(inside).alias("length"), F.count_if(inside > 0).alias("tracks")), "length", digits=5)


_COPPER = """lines AS (SELECT l_orderkey AS net, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity)::BIGINT AS q, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
tracks AS (SELECT (net * 16 + n) * 2 AS id, net, CASE WHEN s % 4 < 3 THEN 'F.Cu' ELSE 'B.Cu' END AS layer, (n + p % 2) * 2.0::DOUBLE AS ax, s % 3 * 1.5::DOUBLE AS ay,
  (n + p % 2) * 2.0::DOUBLE + q % 3 * 2.0::DOUBLE AS bx, s % 3 * 1.5::DOUBLE + q % 2 * 1.5::DOUBLE AS b_y, 0.125::DOUBLE AS half, f FROM lines),
pads AS (SELECT -o_orderkey - 1 AS id, o_orderkey AS net, o_custkey % 3 * 1.5::DOUBLE AS y FROM orders),
shapes AS (SELECT id, net, layer, ax, ay, bx, b_y, half FROM tracks
  UNION ALL SELECT id + 1, net, unnest(['F.Cu', 'B.Cu']), bx, b_y, bx, b_y, 0.3 FROM tracks WHERE f = 'R'
  UNION ALL SELECT id, net, 'F.Cu', 4.0, y - 0.75, 4.0, y + 0.75, 0.5 FROM pads)"""
_POINTS = """points AS (SELECT DISTINCT id, net, layer, x, y FROM (SELECT id, net, layer, ax AS x, ay AS y FROM shapes UNION ALL SELECT id, net, layer, bx, b_y FROM shapes))"""
_CLOSED = """reach(a, b) AS (SELECT DISTINCT id, id FROM shapes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
islands AS (SELECT a AS id, min(b) AS island FROM reach GROUP BY 1)"""


def _to_segment(a: str, b: str, p: str) -> str:
    """SQL of the squared distance of a point from a segment; points are pairs of column names."""
    (ax, ay), (bx, b_y), (px, py) = (s.split() for s in (a, b, p))
    t = f"greatest(0, least(1, coalesce((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({b_y} - {ay})) / nullif(({bx} - {ax}) ** 2 + ({b_y} - {ay}) ** 2, 0), 0)))"
    return f"(({px} - {ax} - {t} * ({bx} - {ax})) ** 2 + ({py} - {ay} - {t} * ({b_y} - {ay})) ** 2)"


def _gap() -> str:
    """SQL of the distance of the shapes of rows l and r."""
    a, b, c, d = "l.ax l.ay", "l.bx l.b_y", "r.ax r.ay", "r.bx r.b_y"

    def turn(p: str, q: str, s: str) -> str:
        (px, py), (qx, qy), (sx, sy) = (v.split() for v in (p, q, s))
        return f"sign(({qx} - {px}) * ({sy} - {py}) - ({qy} - {py}) * ({sx} - {px}))"

    crossing = f"{turn(a, b, c)} * {turn(a, b, d)} < 0 AND {turn(c, d, a)} * {turn(c, d, b)} < 0"
    ends = ", ".join(_to_segment(*x) for x in ((a, b, c), (a, b, d), (c, d, a), (c, d, b)))
    return f"(CASE WHEN {crossing} THEN 0 ELSE sqrt(least({ends})) END - l.half - r.half)"


_TRACKS = """t AS (SELECT o_orderkey AS id, o_custkey AS net, CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'F.Cu' ELSE 'B.Cu' END AS layer, o_orderkey * 3701 % 20011 / 100.0::DOUBLE AS ax,
  o_orderkey * 1013 % 19997 / 100.0::DOUBLE AS ay, (o_custkey * 7 + o_orderkey) % 50 / 10.0::DOUBLE AS length, 0.05::DOUBLE + o_custkey % 3 * 0.05::DOUBLE AS half, o_orderkey % 3 AS way FROM orders),
shapes AS (SELECT id, net, layer, ax, ay, CASE WHEN way = 1 THEN ax ELSE ax + length END AS bx, CASE WHEN way = 0 THEN ay ELSE ay + length END AS b_y, half, length, way FROM t)"""

SQL = {
    "copper_islands": f"""WITH RECURSIVE {_COPPER}, {_POINTS}, edges AS MATERIALIZED (SELECT DISTINCT p.id AS a, q.id AS b FROM points p JOIN points q USING (net, layer, x, y) WHERE p.id <> q.id), {_CLOSED}
        SELECT DISTINCT s.id, s.net, i.island FROM shapes s JOIN islands i USING (id)""",
    "copper_touching": f"""WITH RECURSIVE {_COPPER}, edges AS MATERIALIZED (SELECT DISTINCT l.id AS a, r.id AS b FROM shapes l JOIN shapes r ON l.net = r.net AND l.layer = r.layer AND l.id <> r.id WHERE {_gap()} <= 0), {_CLOSED},
        each AS (SELECT net, island, count(DISTINCT id) AS n FROM shapes JOIN islands USING (id) GROUP BY 1, 2)
        SELECT net, sum(n)::BIGINT AS elements, count(*) AS islands, max(n) AS largest FROM each GROUP BY 1""",
    "pad_copper": f"""WITH {_COPPER}, {_POINTS}, found AS (SELECT o.net AS pad, o.net, p.layer, p.id FROM pads o LEFT JOIN points p ON p.net = o.net AND p.id >= 0 AND p.x = 4 AND p.y = o.y)
        SELECT pad, net, layer, id AS element FROM found QUALIFY row_number() OVER (PARTITION BY pad ORDER BY layer = 'F.Cu' DESC NULLS LAST, layer, id) = 1""",
    "track_clearance": f"""WITH {_TRACKS}, near AS (SELECT l.layer, l.id, r.id AS id_r, {_gap()} AS gap,
          CASE WHEN l.way = r.way AND l.length > 0 AND r.length > 0 THEN greatest(0, least(l.a1, r.a1 + r.shift) - greatest(l.a0, r.a0 + r.shift)) * CASE WHEN l.way = 2 THEN sqrt(2) ELSE 1 END ELSE 0 END AS side_by_side
        FROM (SELECT *, CASE way WHEN 1 THEN ay ELSE ax END AS a0, CASE way WHEN 1 THEN b_y ELSE bx END AS a1 FROM shapes) l
        JOIN LATERAL (SELECT *, CASE way WHEN 1 THEN ay ELSE ax END AS a0, CASE way WHEN 1 THEN b_y ELSE bx END AS a1, CASE WHEN way = 2 THEN ((ay - l.ay) - (ax - l.ax)) / 2 ELSE 0 END AS shift FROM shapes) r
          ON l.layer = r.layer AND l.id < r.id AND l.net <> r.net AND l.ax <= r.bx + 1 AND r.ax <= l.bx + 1 AND l.ay <= r.b_y + 1 AND r.ay <= l.b_y + 1)
        SELECT layer, id, id_r, round(gap, 6) + 0.0 AS gap, round(side_by_side, 6) + 0.0 AS side_by_side FROM near WHERE gap <= 0.2""",
    "keepout_vias": f"""WITH {_TRACKS}, k AS (SELECT s_suppkey AS area, CASE WHEN s_suppkey % 2 = 0 THEN 'F.Cu' ELSE 'B.Cu' END AS layer, s_suppkey * 17 % 190 AS x, s_suppkey * 29 % 190 AS y FROM supplier),
        corners AS (SELECT area, layer, [x, x + 6 + area % 5, x + 3, x + 1] AS xs, [y, y + 1, y + 3, y + 7 + area % 3] AS ys FROM k),
        sides AS (SELECT area, layer, xs[i]::DOUBLE AS px, ys[i]::DOUBLE AS py, xs[i % 4 + 1]::DOUBLE AS qx, ys[i % 4 + 1]::DOUBLE AS qy FROM corners, range(1, 5) r(i))
        SELECT s.layer, s.id, k.area FROM shapes s JOIN sides k ON k.layer = s.layer AND (k.py > s.b_y) <> (k.qy > s.b_y) WHERE s.bx < k.px + (s.b_y - k.py) / (k.qy - k.py) * (k.qx - k.px)
        GROUP BY s.layer, s.id, k.area HAVING count(*) % 2 = 1""",
    "corridor_length": f"""WITH {_TRACKS}, c AS (SELECT net, way, greatest(40, ax) AS x0, least(90, bx) AS x1, greatest(0, ay) AS y0, least(120, b_y) AS y1, ax, ay, length FROM shapes),
        p AS (SELECT net, CASE WHEN way = 0 THEN CASE WHEN ay BETWEEN 0 AND 120 THEN x1 - x0 END WHEN way = 1 THEN CASE WHEN ax BETWEEN 40 AND 90 THEN y1 - y0 END
          ELSE (least(x1 - ax, y1 - ay) - greatest(x0 - ax, y0 - ay)) * sqrt(2) END AS part FROM c)
        SELECT net, round(sum(greatest(0, coalesce(part, 0))), 5) + 0.0 AS length, count(*) FILTER (part > 0) AS tracks FROM p GROUP BY net""",
}

QUERIES = {k: globals()[k] for k in SQL}
