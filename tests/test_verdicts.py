"""Verdicts, short feature vectors, and writers of captures and of ordered tables."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscine.operators import dsp, features, verdicts
from oscine.sources import frames, sinks


def test_reasons(spark):
    rows = [(1, [0.2, 0.5, 0.3]), (2, [0.4, 0.2, 0.4]), (3, None)]
    found = verdicts.with_reasons(spark.createDataFrame(rows, "i int, p array<double>"), "p", ["drug", "noise", "drop"], ["drug", "drop"])
    one, two, three = found.orderBy("i").collect()
    assert (one.reason_code, one.binary_label, one.confidence) == ("noise", "positive", 0.5) and one.reason_probs == {"drug": 0.2, "noise": 0.5, "drop": 0.3}
    assert (two.reason_code, two.binary_label, round(two.p_positive, 9)) == ("drug", "positive", 0.8)
    assert (three.reason_code, three.binary_label, three.reason_probs) == (None, None, None)


def test_perturbed_has_three_windows_of_baseline(spark):
    values = [10.0, 10.2, 9.8, 10.0, 30.0, 30.0, 30.0, 30.0]
    trace = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "s string, w long, v double")
    for seconds in (0.1, 1.0, 3.0):
        r = verdicts.perturbed(trace, ["s"], "w", "v", seconds, 1.0, 5.0).first()
        assert (r.detected, r.start) == (True, 4) and r.z_at_start > 100


def test_ablation_and_ceilings(spark):
    truth = spark.createDataFrame([("a", True, "x"), ("b", True, "y"), ("c", False, "z"), ("d", False, "z")], "s string, changed boolean, label string")
    said = spark.createDataFrame([("a", True), ("c", True), ("d", False)], "s string, detected boolean")
    found = {r.method: r for r in verdicts.ablation({"one": said}, truth, ["s"], "changed", "label").collect()}
    assert (found["one"].n, found["one"].correct, found["one"].sensitivity, found["one"].false_share) == (4, 2, 0.5, 0.5)
    assert (found["majority"].correct, found["majority"].accuracy) == (2, 0.5)
    entries = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("x",), (None,)], "kind string")
    rows = {r.bucket: (r.found, r.ceiling, r.over) for r in verdicts.against_ceilings(entries, "kind", {"a": 3, "b": 1, "c": 0}).collect()}
    assert rows == {"a": (3, 3, False), "b": (2, 1, True), "c": (0, 0, False), "residual": (2, 0, True)}
    assert {r.bucket: r.over for r in verdicts.against_ceilings(entries.limit(0), "kind", {}).collect()} == {"residual": False}


def test_nth_and_without(spark):
    rows = spark.createDataFrame([("n", i, f"u{i}") for i in range(4)] + [("m", 9, "u9")], "net string, x int, uuid string")
    assert [r.uuid for r in verdicts.nth(rows, "net", [F.desc("x")], 1).collect()] == ["u2"]
    assert {r.uuid for r in verdicts.without(rows, "uuid", ["u0", "u9"]).collect()} == {"u1", "u2", "u3"}


def test_short_vector(spark):
    fs, n = 2000.0, 4000
    rng = np.random.default_rng(4)
    x = rng.normal(0, 12, (3, n)) + 40 * np.sin(2 * np.pi * 120 * np.arange(n) / fs)
    x[0, 500:3500:97] -= 200
    got = dict(zip(features.SEVEN, features.short_vector(x, fs), strict=True))
    smooth = dsp.apply_filter(dsp.butterworth(2, 1.0, "high", fs), x)
    assert got["rms_mean"] == pytest.approx(np.sqrt((smooth**2).mean(1)).mean()) and got["rms_std"] == pytest.approx(np.sqrt((smooth**2).mean(1)).std())
    hz, power = dsp.welch(x, fs, n)
    step = hz[1] - hz[0]
    assert got["high_gamma_power"] == pytest.approx(power[:, (hz >= 80) & (hz <= 300)].sum(1).mean() * step) and got["high_gamma_power"] > 700
    assert got["spike_band_power"] == pytest.approx(power[:, (hz >= 300) & (hz <= 3000)].sum(1).mean() * step)
    own = np.mean([np.polyfit(np.log10(hz[m]), np.log10(p[m] + 1e-30), 1)[0] for p in power for m in [(hz >= 30) & (hz <= 300)]])
    assert got["spectral_slope"] == pytest.approx(own)
    fourth = [((r - r.mean()) ** 4).mean() / r.var() ** 2 - 3 for r in x]
    assert got["kurtosis"] == pytest.approx(np.mean(fourth)) and got["spike_rate_hz"] > 3
    windows = spark.createDataFrame([("a", c, x[c].tolist()) for c in range(3)] + [("b", 0, [1.0, 2.0, 3.0]), ("b", 1, [1.0, 2.0])], "rec string, channel int, values array<double>")
    rows = {r.rec: r for r in features.feature_vectors(windows, ["rec"], fs, short=True).collect()}
    assert [rows["a"][k] for k in features.SEVEN] == pytest.approx(list(got.values())) and all(np.isnan(rows["b"][k]) for k in features.SEVEN)
    assert np.isnan(features.feature_vectors(windows.where("rec = 'b'"), ["rec"], fs).first().rms_mean)


def test_capture_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, i * 50, [(i * 331 + c * 77) % 65536 - 32768 for c in range(64)]) for i in range(500)], "frame_id long, timestamp long, adc array<int>")
    built = frames.build(rows)
    sinks.captures(built.repartition(7), str(tmp_path / "c"), ["frame_id"])
    want = b"".join(bytes(r.raw) for r in built.orderBy("frame_id").collect())
    files = sorted(glob.glob(f"{tmp_path}/c/part-*"))
    assert b"".join(open(f, "rb").read().removesuffix(frames.SYNC) for f in files) == want
    assert {(r.frame_id, r.crc_valid, tuple(r.adc)) for r in frames.decode(frames.read(spark, f"{tmp_path}/c")).collect()} == {(r.frame_id, True, tuple(r.adc)) for r in rows.collect()}


def test_ordered_csv(spark, tmp_path):
    rows = spark.createDataFrame([((i * 37) % 100, f"x{i}", [1]) for i in range(100)], "k int, v string, gone array<int>")
    sinks.ordered_csv(rows.repartition(5), str(tmp_path / "o"), ["k"])
    lines = [line for f in sorted(glob.glob(f"{tmp_path}/o/part-*.csv")) for line in open(f).read().splitlines() if line != "k,v"]
    assert [int(line.split(",")[0]) for line in lines] == list(range(100))
