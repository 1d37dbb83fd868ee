"""Suites of rules: what breaks a rule becomes a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, keys: list[str], rules: list[tuple[str, str, Column]]) -> DataFrame:
    """keys, rule and level of each rule that a row breaks. The rows are read once; a null condition breaks nothing."""
    found = F.array(*[F.when(broken, F.struct(F.lit(name).alias("rule"), F.lit(level).alias("level"))) for name, level, broken in rules])
    return rows.select(*keys, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v")).select(*keys, "v.rule", "v.level")
