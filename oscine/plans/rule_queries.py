"""What users may add by name: rules of a bring-up suite over the line items (a supplier's deliveries are a run, a line is a
measurement), and statistics of the event channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from oscine.operators import bringup, resampling
from oscine.plans.base import SAMPLES_SQL, rounded, samples, table

CHANNELS = tuple(f"CH{n}" for n in range(9, 30))

#: The sheet's columns, as expressions that both engines know.
_COLUMNS = {
    "vendor": "CASE WHEN l_suppkey % 13 = 4 THEN ' ' ELSE 'V' END", "order_id": "CASE WHEN l_suppkey % 7 = 3 THEN concat('O', cast(l_orderkey % 2 AS VARCHAR(9))) ELSE 'O1' END",
    "lot_id": "CASE WHEN l_suppkey % 5 = 0 THEN concat('L', cast(l_partkey % 3 AS VARCHAR(9))) WHEN l_suppkey % 11 = 2 THEN '' ELSE 'L7' END", "panel_id": "'P'", "board_serial": "'B'", "inspector": "CASE WHEN l_suppkey % 17 = 1 THEN NULL ELSE 'I' END",
    "date": "'2024-01-01'", "phase": "'5'", "step": "CASE WHEN l_linenumber % 7 = 3 AND l_suppkey % 19 <> 6 THEN '3.2' WHEN l_linenumber % 2 = 0 THEN '5.1' ELSE ' 5.2' END",
    "channel": "CASE WHEN l_partkey % 31 = 30 THEN '' ELSE concat('CH', cast(l_partkey % 31 AS VARCHAR(9))) END",
    "result": "CASE WHEN l_partkey % 211 = 5 THEN '' WHEN l_partkey % 223 = 7 THEN 'maybe' WHEN l_returnflag = 'R' AND l_partkey % 50 = 1 THEN 'Fail' ELSE 'PASS' END",
    "value": "CASE WHEN l_partkey % 149 = 3 THEN 'n/a' WHEN l_linenumber % 2 = 0 THEN cast(cast(l_quantity AS INTEGER) % 8 AS VARCHAR(9)) ELSE cast(cast(l_quantity AS INTEGER) * 9 AS VARCHAR(9)) END",
    "unit": "CASE WHEN l_partkey % 83 = 2 THEN 'V' WHEN l_linenumber % 2 = 0 THEN 'ohm' ELSE 'GΩ' END", "method": "CASE WHEN l_partkey % 71 = 2 THEN '' WHEN l_linenumber % 2 = 0 THEN '2W-probe' ELSE 'IR-DMM' END",
    "probe_from": "CASE WHEN l_partkey % 97 = 8 THEN '' WHEN l_partkey % 101 = 9 THEN 'X1.2' ELSE 'J5.1' END", "probe_to": "CASE WHEN l_linenumber % 2 = 0 THEN 'U1.3' WHEN l_partkey % 89 = 1 THEN 'J5.9' ELSE 'j5.gnd' END",
    "notes": "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE 'see microsection_J5.JPG' END",
}


def bringup_suite(spark, sf_dir):
    """Violations of each rule, run by run."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), F.concat_ws(".", "l_orderkey", "l_linenumber").alias("row"), *[F.expr(v).alias(k) for k, v in _COLUMNS.items()])
    found = bringup.check(rows, channels=CHANNELS)
    return found.groupBy("file", "rule", "level").agg(F.count("*").alias("n"), F.min("item").alias("first_item"), F.min("row").alias("first_row"))


def _sql() -> str:
    """DuckDB: a query for each rule, one after the other."""
    sheet = "s AS (SELECT l_suppkey AS file, l_orderkey || '.' || l_linenumber AS row, " + ", ".join(f"{v} AS {k}" for k, v in _COLUMNS.items()) + " FROM lineitem)"
    parts = []
    for r in bringup.suite(CHANNELS):
        said = f"'{r.name}' AS rule, '{r.level}' AS level"
        if r.scope == "row":
            parts.append(f"SELECT file, {said}, row, NULL AS item FROM s WHERE ({r.when}) AND NOT coalesce({r.holds}, false)")
        elif r.scope == "file":
            parts.append(f"SELECT file, {said}, NULL AS row, NULL AS item FROM s GROUP BY file HAVING NOT coalesce({r.holds}, false)")
        elif r.scope == "group":
            parts.append(f"SELECT file, {said}, NULL AS row, k AS item FROM (SELECT *, {r.key} AS k FROM s) WHERE k IS NOT NULL GROUP BY file, k HAVING NOT coalesce({r.holds}, false)")
        else:
            step = r.holds.split("step) = '")[1][:3]
            parts.append(f"SELECT f.file, {said}, NULL AS row, c.c AS item FROM (SELECT DISTINCT file FROM s) f, (SELECT unnest({list(CHANNELS)}) AS c) c ANTI JOIN s ON s.file = f.file AND trim(s.channel) = c.c AND trim(s.step) = '{step}'")
    return f"WITH {sheet}, v AS ({' UNION ALL '.join(parts)}) SELECT file, rule, level, count(*) AS n, min(item) AS first_item, min(row) AS first_row FROM v GROUP BY 1, 2, 3"


def named_statistics(spark, sf_dir):
    """Median, trimmed mean and spread of each channel's days, by statistics registered by name."""
    found = resampling.grouped(samples(spark, sf_dir), ["channel", "day"], "uv", "median", "trimmed_mean", "std")
    return rounded(found, "median", "trimmed_mean", "std")


def bootstrap_median(spark, sf_dir):
    """Median of each channel with its interval from 200 resamples of little bags."""
    return rounded(resampling.bootstrap(samples(spark, sf_dir), ["channel"], "uv", ["event_id"], "median", 200), "estimate", "low", "high")


SQL = {
    "bringup_suite": _sql(),
    "named_statistics": f"""WITH {SAMPLES_SQL}, r AS (SELECT channel, day, uv, row_number() OVER (PARTITION BY channel, day ORDER BY uv) - 1 AS i, count(*) OVER (PARTITION BY channel, day) AS n FROM samples)
        SELECT channel, day, count(*) AS n, round(median(uv), 6) + 0.0 AS median, round(avg(uv) FILTER (i >= n // 10 AND i < n - n // 10), 6) + 0.0 AS trimmed_mean, round(stddev_pop(uv), 6) + 0.0 AS std FROM r GROUP BY channel, day""",
}
QUERIES = {f.__name__: f for f in (bringup_suite, named_statistics, bootstrap_median)}
