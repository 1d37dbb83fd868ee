"""Rules as data: a suite is a list of rules, each an SQL expression with a scope, and is compiled to one plan.

A rule of scope row holds or not for each row that its condition picks. One of scope group holds or not for each group of rows with
the same key, one of scope file for each file; their expressions are aggregates. One of scope each is an aggregate that gives
an array for each file, of which each element is a violation. An expression that is null doesn't hold. Rows are read once
for the row rules and once for each key that groups are made by."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPES = ("row", "group", "file", "each")


@dataclass(frozen=True)
class Rule:
    name: str
    holds: str
    scope: str = "row"
    when: str = "true"
    key: str = ""
    level: str = "FAIL"


def from_table(rules: DataFrame) -> list[Rule]:
    """The rules of a table: name, holds, scope, when, key, level; as many rows as there are rules."""
    return [Rule(**{k: v for k, v in r.asDict().items() if v is not None}) for r in rules.collect()]


def _failed(rule: Rule, broken: Column, item: Column | None = None) -> Column:
    return F.when(broken, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.level).alias("level"), (F.lit(None).cast("string") if item is None else item.cast("string")).alias("item")))


def _asked(rule: Rule, value: Column, item: Column | None) -> Column:
    """The violations of a rule about many rows, as an array."""
    if rule.scope != "each":
        return F.array(_failed(rule, ~F.coalesce(value, F.lit(False)), item))
    return F.transform(F.coalesce(value.cast("array<string>"), F.array().cast("array<string>")), lambda x: _failed(rule, F.lit(True), x))


def violations(rows: DataFrame, rules: Iterable[Rule], file: str, row: str) -> DataFrame:
    """file, row (null but for row rules), rule, level and item (the group's key, or the element) of each violation."""
    rules = list(rules)
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("rules of a suite have different names")
    if wrong := {r.scope for r in rules} - set(SCOPES):
        raise ValueError(f"unknown scopes: {sorted(wrong)}")
    out = []
    if own := [r for r in rules if r.scope == "row"]:
        checks = F.array(*[_failed(r, F.expr(f"({r.when}) AND NOT coalesce({r.holds}, false)")) for r in own])
        found = rows.select(file, row, F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("v"))
        out.append(found.select(F.col(file).alias("file"), F.col(row).cast("string").alias("row"), "v.*"))
    keys: dict[str, list[Rule]] = {}
    for r in rules:
        if r.scope != "row":
            keys.setdefault(r.key if r.scope == "group" else "", []).append(r)
    for key, asked in keys.items():
        by = [F.col(file).alias("file"), *([F.expr(key).cast("string").alias("key")] if key else [])]
        sums = rows.groupBy(*by).agg(*[F.expr(r.holds).alias(f"__{k}") for k, r in enumerate(asked)])
        checks = [_asked(r, F.col(f"__{k}"), F.col("key") if key else None) for k, r in enumerate(asked)]
        found = sums.select("file", F.explode(F.filter(F.flatten(F.array(*checks)), lambda x: x.isNotNull())).alias("v"))
        out.append(found.select("file", F.lit(None).cast("string").alias("row"), "v.*"))
    if not out:
        return rows.limit(0).select(F.col(file).alias("file"), *[F.lit(None).cast("string").alias(n) for n in ("row", "rule", "level", "item")])
    first, *rest = out
    for part in rest:
        first = first.unionByName(part)
    return first
