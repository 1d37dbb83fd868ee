"""Set differences, manifests, reachability and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oscine.operators import scratch


def manifest_diff(old: DataFrame, new: DataFrame, path: str, digest: str) -> DataFrame:
    """path and change (added, removed, changed) of what differs between two lists of digests."""
    a, b = old.select(F.col(path).alias("path"), F.col(digest).alias("a")), new.select(F.col(path).alias("path"), F.col(digest).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")


def missing(required: DataFrame, there: DataFrame, key: str) -> DataFrame:
    return required.select(key).join(there.select(key), key, "left_anti").distinct()


def leakage(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    return train.select(key).intersect(test.select(key))


def one_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, and which."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full").where("l IS NULL OR r IS NULL").select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def segment_distance(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Distance of a point from the segment a to b."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, ((px - ax) * dx + (py - ay) * dy) / length).otherwise(0.0)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def segments_distance(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Distance of the segment a to b from the segment c to d: 0 where they cross, else the least from an end to the other."""

    def side(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    crossing = (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)
    ends = F.least(
        segment_distance(ax, ay, bx, by, cx, cy), segment_distance(ax, ay, bx, by, dx, dy), segment_distance(cx, cy, dx, dy, ax, ay), segment_distance(cx, cy, dx, dy, bx, by)
    )
    return F.when(crossing, 0.0).otherwise(ends)


def rectangle_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from a rectangle, 0 inside."""
    return F.hypot(F.greatest(x0 - px, F.lit(0.0), px - x1), F.greatest(y0 - py, F.lit(0.0), py - y1))


def near_segments(left: DataFrame, right: DataFrame, reach: float, cell: float, id: str = "id") -> DataFrame:
    """Pairs of segments (id, ax, ay, bx, by) of two tables that are less than reach apart, with the distance. Each segment goes to
    the cells of a grid that its box covers, the right one widened by reach; a pair counts in the least cell that both share."""

    def covered(df: DataFrame, more: float, names: tuple[str, str]) -> DataFrame:
        for axis, name in zip("xy", names, strict=True):
            low, high = F.least(f"a{axis}", f"b{axis}") - more, F.greatest(f"a{axis}", f"b{axis}") + more
            df = df.withColumns({f"{name}_low": F.floor(low / cell), name: F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))})
        return df

    a = covered(left.select(id, "ax", "ay", "bx", "by"), 0.0, ("__i", "__j"))
    b = covered(right.select(id, "ax", "ay", "bx", "by"), reach, ("__k", "__l")).withColumnsRenamed({c: f"{c}_r" for c in (id, "ax", "ay", "bx", "by")})
    both = a.join(b.hint("merge"), (F.col("__i") == F.col("__k")) & (F.col("__j") == F.col("__l")))
    first = (F.col("__i") == F.greatest("__i_low", "__k_low")) & (F.col("__j") == F.greatest("__j_low", "__l_low"))
    apart = segments_distance(*[F.col(c) for c in ("ax", "ay", "bx", "by", "ax_r", "ay_r", "bx_r", "by_r")])
    return both.where(first).select(id, f"{id}_r", apart.alias("distance")).where(F.col("distance") < reach)


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, reach: float) -> DataFrame:
    """Pairs of equal keys that are less than reach apart in both directions, by cells of a grid: each left row goes to its
    cell, each right row to its own and the eight about it, so that no pair is met twice and no two sides meet whole. The
    right columns get the ending _r."""
    def cell(column: str) -> Column:
        return F.floor(F.col(column) / reach).cast("long")

    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = left.withColumns({"__i": cell(x), "__j": cell(y)})
    b = right.withColumn("__o", F.explode(offsets)).withColumns({"__i": cell(x) + F.col("__o.i"), "__j": cell(y) + F.col("__o.j")}).drop("__o")
    b = b.withColumnsRenamed({c: f"{c}_r" for c in right.columns if c not in keys})
    both = a.join(b.hint("merge"), [*keys, "__i", "__j"])  # nine times the table, which its size doesn't tell: never broadcast
    return both.where((F.abs(F.col(x) - F.col(f"{x}_r")) < reach) & (F.abs(F.col(y) - F.col(f"{y}_r")) < reach)).drop("__i", "__j")


def reachable(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node and hops of all that can be reached from the seeds (column node), breadth first. Each round joins the newest nodes
    with the edges and is written to the shared folder, so that the plan stays as long as one round."""
    spark = edges.sparkSession
    root = scratch.folder(spark, "reach")
    step, e = 0, edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct()
    seeds.select("node").distinct().withColumn("hops", F.lit(0)).write.parquet(f"{root}/hops=0", mode="overwrite")
    seen = spark.read.parquet(f"{root}/hops=0").select("node", F.lit(0).alias("hops"))
    while True:
        newest = seen.where(F.col("hops") == step).join(e, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti")
        step += 1
        newest.withColumn("hops", F.lit(step)).write.parquet(f"{root}/hops={step}")
        new = spark.read.parquet(f"{root}/hops={step}")
        if new.isEmpty():
            return seen
        seen = spark.read.schema("node long, hops int").parquet(*[f"{root}/hops={i}" for i in range(step + 1)])
