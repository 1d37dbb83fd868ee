"""Spectra of the embeddings, taken as series of 64 samples at 640 Hz."""

from __future__ import annotations

from pyspark.sql import functions as F

from oscine.operators import spectral as P
from oscine.plans.base import rounded, table

N, FS = 64, 640.0


def _powers(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", P.periodogram(F.col("embedding"), FS).alias("power"))


def _measure(spark, sf_dir, name, column, digits=6):
    return rounded(_powers(spark, sf_dir).select("vec_id", column.alias(name)), name, digits=digits)


def psd_dft(spark, sf_dir):
    rows = _powers(spark, sf_dir).select("vec_id", F.posexplode("power").alias("bin", "power"))
    return rounded(rows.select("vec_id", "bin", (F.col("bin") * FS / N).alias("hz"), (F.col("power") * 1e3).alias("power")), "hz", "power")


def bandpower(spark, sf_dir):
    return _measure(spark, sf_dir, "bandpower", P.band_power(F.col("power"), 20, 120, FS / N))


def spectral_slope(spark, sf_dir):
    return _measure(spark, sf_dir, "slope", P.band_slope(F.col("power"), 10, 310, FS / N), 5)


def spectral_edge(spark, sf_dir):
    return _measure(spark, sf_dir, "edge_hz", P.power_edge(F.col("power"), FS / N))


def spectral_flatness(spark, sf_dir):
    return _measure(spark, sf_dir, "flatness", P.band_flatness(F.col("power"), 100, 300, FS / N))


def line_ratio(spark, sf_dir):
    return _measure(spark, sf_dir, "line_ratio", P.line_to_band(F.col("power"), 60, 10, 200, FS / N))


_PSD = """e AS (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x0 FROM embeddings),
    x AS (SELECT vec_id, i, x0 - avg(x0) OVER (PARTITION BY vec_id) AS x FROM e),
    f AS (SELECT vec_id, k, sum(x * cos(-2 * pi() * k * i / 64)) AS re, sum(x * sin(-2 * pi() * k * i / 64)) AS im FROM x, range(33) t(k) GROUP BY 1, 2),
    psd AS (SELECT vec_id, CAST(k AS INTEGER) AS bin, k * 10.0::DOUBLE AS hz, CASE WHEN k IN (0, 32) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END * (re * re + im * im) / (64 * 640.0::DOUBLE) AS power FROM f)"""
SQL = {
    "psd_dft": f"WITH {_PSD} SELECT vec_id, bin, hz, round(power * 1e3, 6) AS power FROM psd",
    "bandpower": f"WITH {_PSD} SELECT vec_id, round(sum(power) * 10, 6) AS bandpower FROM psd WHERE hz BETWEEN 20 AND 120 GROUP BY 1",
    "spectral_slope": f"WITH {_PSD} SELECT vec_id, round(regr_slope(log10(power + 1e-30), log10(hz)), 5) + 0.0 AS slope FROM psd WHERE hz BETWEEN 10 AND 310 GROUP BY 1",
    "spectral_edge": f"""WITH {_PSD}, c AS (SELECT vec_id, hz, sum(power) OVER (PARTITION BY vec_id ORDER BY bin) / sum(power) OVER (PARTITION BY vec_id) AS s FROM psd)
        SELECT vec_id, min(hz) AS edge_hz FROM c WHERE s >= 0.95 - 1e-12 GROUP BY 1""",
    "spectral_flatness": f"WITH {_PSD} SELECT vec_id, round(exp(avg(ln(greatest(power, 1e-30)))) / avg(power), 6) AS flatness FROM psd WHERE hz BETWEEN 100 AND 300 GROUP BY 1",
    "line_ratio": f"WITH {_PSD} SELECT vec_id, round(sum(power) FILTER (bin BETWEEN 5 AND 7) / sum(power) FILTER (hz BETWEEN 10 AND 200), 6) AS line_ratio FROM psd GROUP BY 1",
}
QUERIES = {k: globals()[k] for k in SQL}
