"""Geometry of boards as column functions, and joins in the plane by the cells of a grid.

Shapes are capsules: a segment from (ax, ay) to (bx, by) with all that is within half of it; a via is one whose ends coincide.
Joins deal both sides to the cells that their boxes cover; a pair counts in the least cell that both share, so that none is met
twice. Null coordinates meet nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENDS = ("ax", "ay", "bx", "by")


def _ends(suffix: str = "") -> list[Column]:
    return [F.col(f"{c}{suffix}") for c in ENDS]


def clipped(ax: Column, ay: Column, bx: Column, by: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The part of a segment within a rectangle as lo and hi, shares of the way from a to b; null if there is none. Each side
    of the rectangle leaves an interval of the way, and the part is what all four share."""
    los, his, out = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for begin, step, low, high in ((ax, bx - ax, x0, x1), (ay, by - ay, y0, y1)):
        at_low, at_high = F.when(step != 0, (low - begin) / step), F.when(step != 0, (high - begin) / step)
        los.append(F.coalesce(F.least(at_low, at_high), F.lit(0.0)))
        his.append(F.coalesce(F.greatest(at_low, at_high), F.lit(1.0)))
        out = out | ((step == 0) & ((begin < low) | (begin > high)))
    lo, hi = F.greatest(*los), F.least(*his)
    return F.when(~out & (lo <= hi), F.struct(lo.alias("lo"), hi.alias("hi")))


def clipped_length(*columns: Column) -> Column:
    """Length of the part of a segment within a rectangle, 0 if there is none."""
    ax, ay, bx, by = columns[:4]
    part = clipped(*columns)
    return F.coalesce((part["hi"] - part["lo"]) * F.hypot(bx - ax, by - ay), F.lit(0.0))


def parallel_overlap(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column, tolerance: float = 1e-9) -> Column:
    """How long two segments run side by side: the length that the shadow of c to d on the line a to b shares with a to b; 0 if
    they aren't parallel. tolerance: sine of the angle that counts as none."""
    ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
    length, turn = F.hypot(ux, uy), F.abs(ux * vy - uy * vx)
    # roots are taken of what may be parallel only: no length is more than the sum of its sides
    may_be = turn <= 2 * tolerance * (F.abs(ux) + F.abs(uy)) * (F.abs(vx) + F.abs(vy))
    parallel = (length > 0) & (F.hypot(vx, vy) > 0) & (turn <= tolerance * length * F.hypot(vx, vy))
    first, last = (F.try_divide((x - ax) * ux + (y - ay) * uy, length) for x, y in ((cx, cy), (dx, dy)))
    shared = F.least(length, F.greatest(first, last)) - F.greatest(F.lit(0.0), F.least(first, last))
    return F.when(may_be & parallel & (shared > 0), shared).otherwise(0.0)


def in_polygon(x: Column, y: Column, corners: Column) -> Column:
    """Whether a point is inside a polygon, given as an array of x and y: a ray to the right crosses its sides an odd number of
    times. A side holds its lower end and not its upper one, so that a corner counts once."""
    following = F.concat(F.slice(corners, 2, F.greatest(F.size(corners) - 1, F.lit(0))), F.slice(corners, 1, 1))

    def crosses(p: Column, q: Column) -> Column:
        at = p["x"] + (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) * (q["x"] - p["x"])
        return F.coalesce(((p["y"] > y) != (q["y"] > y)) & (x < at), F.lit(False)).cast("int")

    crossings = F.zip_with(corners, following, crosses)
    return F.aggregate(crossings, F.lit(0), lambda a, b: a + b) % 2 == 1


def _in_cells(df: DataFrame, box: tuple[Column, Column, Column, Column], cell: float, names: tuple[str, str]) -> DataFrame:
    """A row for each cell that the box (x0, y0, x1, y1) covers, with the least of them."""
    for low, high, name in ((box[0], box[2], names[0]), (box[1], box[3], names[1])):
        df = df.withColumns({f"{name}_low": F.floor(low / cell), name: F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))})
    return df


def _meet(left: DataFrame, right: DataFrame, keys: list[str], unlike: str | None) -> DataFrame:
    """Pairs that share keys and a cell, once each; unlike: a column that must differ. Both sides are dealt by their cells, as a table's
    size tells nothing of how many cells its rows cover."""
    both = left.join(right.withColumnsRenamed({k: f"{k}_r" for k in keys}).hint("merge"), [F.col(k) == F.col(f"{k}_r") for k in keys] + [F.col("__i") == F.col("__k"), F.col("__j") == F.col("__l")])
    once = (F.col("__i") == F.greatest("__i_low", "__k_low")) & (F.col("__j") == F.greatest("__j_low", "__l_low"))
    return both.where(once & (F.col(unlike) != F.col(f"{unlike}_r"))) if unlike else both.where(once)


def settled(df: DataFrame) -> DataFrame:
    """The shapes that have a place, in columns that can't be null: what is worked out of two shapes then stays short enough to be
    compiled, where it would be interpreted else."""
    names = [*ENDS, "half"]
    return df.where(F.least(*[F.col(c).isNotNull() for c in names])).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names})


def apart_squared(suffix: str = "_r") -> Column:
    """Squared distance of the segment of the columns of ENDS from that of the columns with the suffix; 0 where they cross."""
    ax, ay, bx, by = _ends()
    cx, cy, dx, dy = _ends(suffix)

    def side(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    def to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        ux, uy = bx - ax, by - ay
        t = ((px - ax) * ux + (py - ay) * uy) / F.greatest(ux * ux + uy * uy, F.lit(1e-300))  # a point is its own segment
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.pow(px - ax - t * ux, F.lit(2.0)) + F.pow(py - ay - t * uy, F.lit(2.0))

    crossing = (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)
    return F.when(crossing, 0.0).otherwise(F.least(to_segment(cx, cy, ax, ay, bx, by), to_segment(dx, dy, ax, ay, bx, by), to_segment(ax, ay, cx, cy, dx, dy), to_segment(bx, by, cx, cy, dx, dy)))


def gap(suffix: str = "_r", aside: bool = False) -> Column:
    """How far the edges of two shapes (ENDS, half, and the same with the suffix) are apart: 0 or less where they touch. aside: for a step
    that shares its loop with another: a higher-order function, which Spark keeps out of fused loops, holds one of the
    terms. Both steps in one loop are longer than the JVM compiles, and are interpreted then."""
    half = F.col(f"half{suffix}")
    return F.sqrt(apart_squared(suffix)) - F.col("half") - (F.transform(F.array(half), lambda x: x)[0] if aside else half)


def boxes_near(reach: float, suffix: str = "_r") -> Column:
    """Whether the boxes of two shapes are at most reach apart on both axes, which all shapes within reach are; cheap, and put
    before the gap. The margin is more than rounding may take."""
    out = None
    for axis in "xy":
        a, b, c, d = (F.col(n) for n in (f"a{axis}", f"b{axis}", f"a{axis}{suffix}", f"b{axis}{suffix}"))
        more = F.col("half") + F.col(f"half{suffix}") + (reach + 1e-6)
        near = (F.least(a, b) <= F.greatest(c, d) + more) & (F.least(c, d) <= F.greatest(a, b) + more)
        out = near if out is None else out & near
    return out


def near_shapes(left: DataFrame, right: DataFrame, keys: list[str], reach: float, cell: float, id: str = "id", unlike: str | None = None) -> DataFrame:
    """Pairs of shapes of equal keys whose edges are at most reach apart: id, id_r, gap (0 or less where they touch), and how long
    they run side by side. In a join with itself each pair comes once, the smaller id left. unlike: a column, such as the
    net, in which the two must differ."""
    names, box = [id, *ENDS, "half", *([unlike] if unlike else [])], ["__x0", "__y0", "__x1", "__y1"]

    def dealt(df: DataFrame, more: Column, cells: tuple[str, str]) -> DataFrame:
        sides = (F.least("ax", "bx") - more, F.least("ay", "by") - more, F.greatest("ax", "bx") + more, F.greatest("ay", "by") + more)
        boxed = settled(df.select(*keys, *names)).withColumns(dict(zip(box, sides, strict=True)))
        return _in_cells(boxed, tuple(F.col(c) for c in box), cell, cells)

    a = dealt(left, F.col("half"), ("__i", "__j"))
    b = dealt(right, F.col("half") + (reach + 1e-6), ("__k", "__l")).withColumnsRenamed({c: f"{c}_r" for c in [*names, *box]})
    both = _meet(a, b, keys, unlike)
    if left is right:
        both = both.where(F.col(id) < F.col(f"{id}_r"))
    for low, high in (("__x0", "__x1"), ("__y0", "__y1")):
        both = both.where((F.col(low) <= F.col(f"{high}_r")) & (F.col(f"{low}_r") <= F.col(high)))
    # what comes out of explode is worked out once; an expression that is filtered by and returned, twice
    found = both.select(*keys, *names, *[f"{c}_r" for c in names], F.explode(F.array(gap())).alias("gap")).where(F.col("gap") <= reach)
    return found.select(*keys, id, f"{id}_r", "gap", parallel_overlap(*_ends(), *_ends("_r")).alias("side_by_side"))


def contained(points: DataFrame, areas: DataFrame, keys: list[str], cell: float, point: str = "id", area: str = "area") -> DataFrame:
    """point and area of the points (x, y) that are inside an area (corners) of equal keys, met by cells of the areas' boxes. Of areas
    that are alike one meets the points, and its points are all of theirs."""
    corners = F.col("corners")
    xs, ys = F.col("corners.x"), F.col("corners.y")
    box = F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)
    whole = areas.where(F.size("corners") > 2).select(*keys, area, "corners")
    a = _in_cells(points.select(*keys, point, "x", "y"), (F.col("x"), F.col("y"), F.col("x"), F.col("y")), cell, ("__i", "__j"))
    b = _in_cells(whole.select(*keys, "corners").distinct(), box, cell, ("__k", "__l"))
    inside = _meet(a, b, keys, None).where(in_polygon(F.col("x"), F.col("y"), corners)).select(*keys, point, "corners")
    return inside.join(whole, [*keys, "corners"]).select(*keys, point, area)
