"""Checks of a schematic's netlist (net, ref, pin): what breaks one is a row of check, ref, pin and item.

What must hold is given as tables: pads that a net must have, nets that a pad must be on, and nets that it mustn't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOOSE = "unconnected-"


def test_points(nets: DataFrame, components: DataFrame, prefix: str = "TP", pin: str = "1") -> DataFrame:
    """Test points whose pad isn't on a named net."""
    own = components.where(F.col("ref").startswith(prefix)).select("ref").distinct()
    both = own.join(nets.where(F.col("pin") == pin).select("ref", "net"), "ref", "left")
    bad = both.where(F.col("net").isNull() | (F.col("net") == "") | F.col("net").startswith(LOOSE))
    return bad.select(F.lit("test_point").alias("check"), "ref", F.lit(pin).alias("pin"), F.coalesce("net", F.lit("")).alias("item"))


def power_chains(nets: DataFrame, required: DataFrame) -> DataFrame:
    """Required pads (net, ref, pin) that aren't on their net, and nets that aren't there at all."""
    there = nets.select("net").distinct()
    absent = required.select("net").distinct().join(there, "net", "left_anti").select(F.lit("no_net").alias("check"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("string").alias("pin"), F.col("net").alias("item"))
    lacking = required.join(there, "net", "left_semi").join(nets, ["net", "ref", "pin"], "left_anti")
    return absent.union(lacking.select(F.lit("not_on_net"), "ref", "pin", F.col("net")))


def unconnected(nets: DataFrame, allowed: DataFrame) -> DataFrame:
    """Pads on nets of loose ends that aren't allowed (ref, pin) to be."""
    loose = nets.where(F.col("net").startswith(LOOSE)).join(allowed, ["ref", "pin"], "left_anti")
    return loose.select(F.lit("unconnected").alias("check"), "ref", "pin", F.col("net").alias("item"))


def bridges(nets: DataFrame, pads: DataFrame) -> DataFrame:
    """Pads (ref, pin, net) that are on another net than they must be, and where they are."""
    is_on = pads.join(nets.withColumnRenamed("net", "is_on"), ["ref", "pin"], "left")
    return is_on.where(~F.col("net").eqNullSafe(F.col("is_on"))).select(F.lit("bridge").alias("check"), "ref", "pin", F.coalesce("is_on", F.lit("")).alias("item"))


def isolated(nets: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Pads (ref, pin, net) that are on a net that they mustn't be on."""
    return forbidden.join(nets, ["net", "ref", "pin"], "left_semi").select(F.lit("isolation").alias("check"), "ref", "pin", F.col("net").alias("item"))


def check(nets: DataFrame, components: DataFrame, required: DataFrame, allowed: DataFrame, on: DataFrame, off: DataFrame) -> DataFrame:
    """All checks of a netlist."""
    return test_points(nets, components).union(power_chains(nets, required)).union(unconnected(nets, allowed)).union(bridges(nets, on)).union(isolated(nets, off))
