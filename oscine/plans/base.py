"""Views of the driver's tables as signals: events are samples of five channels (event_type), a day is a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oscine.operators import windowing as W

START = "2024-01-01"
DAY_SQL = f"date_diff('day', DATE '{START}', CAST(ts AS DATE))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit(START).cast("date")).cast("long")
    return events.select(F.col("event_type").alias("channel"), day.alias("day"), "ts", "event_id", "user_id", F.col("value").alias("uv"))


def seconds(column: str = "ts") -> F.Column:
    """Whole microseconds since the first day, as the timestamps have no zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '{START} 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


MICROS_SQL = f"(epoch_us(ts) - epoch_us(TIMESTAMP '{START}'))"


def daily_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.tumbling(samples(spark, sf_dir), ["channel"], "day", rms=W.rms("uv"))


SAMPLES_SQL = f"samples AS (SELECT event_type AS channel, CAST({DAY_SQL} AS BIGINT) AS day, ts, event_id, user_id, value AS uv FROM events)"
DAILY_SQL = f"{SAMPLES_SQL}, daily AS (SELECT channel, day, count(*) AS n, sqrt(avg(uv * uv)) AS rms FROM samples GROUP BY 1, 2)"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Rounds columns, and turns a negative zero into zero."""
    return df.withColumns({x: F.round(F.col(x), digits) + F.lit(0.0) for x in names})


def quickly_rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """What rounded gives, for very many rows: round writes each number out as a decimal; here only those near the middle between
    two results, large ones and those that aren't numbers are left to it."""

    def quick(x: Column) -> Column:
        scaled = F.abs(x) * 10.0**digits + 0.5
        whole = F.floor(scaled)
        sure = (F.abs(x) < 10.0 ** (11 - digits)) & (scaled - whole > 0.001) & (scaled - whole < 0.999)
        return F.when(sure, F.signum(x) * (whole / 10.0**digits)).otherwise(F.round(x, digits)) + F.lit(0.0)

    return df.withColumns({x: quick(F.col(x)) for x in names})
