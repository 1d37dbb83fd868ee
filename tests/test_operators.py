"""Operators against what is known of their results."""

import math
import random
import struct
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscine.functions import scalars as S
from oscine.operators import detection as D
from oscine.operators import dsp, learning, relational, spectral
from oscine.operators import statistics as T
from oscine.operators import windowing as W
from oscine.sources import frames, rhd, synthetic


def test_adc_round_trip(spark):
    values = [100.0, -200.0, 0.0, 3000.0, 10000.0, -10000.0]
    codes = [r[0] for r in spark.createDataFrame([(v,) for v in values], "uv double").select(S.uv_to_adc("uv")).collect()]
    assert codes[-2:] == [32767, -32768]
    assert all(abs(c * 0.195 - v) < 0.195 for c, v in zip(codes[:4], values, strict=False))


def test_wilson(spark):
    low, high = S.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(0, 0), (5, 10), (10, 10)], "k int, n int").select(low, high).collect()
    assert tuple(rows[0]) == (0.0, 0.0)
    assert rows[1][0] == pytest.approx(0.2366, abs=1e-3) and rows[1][1] == pytest.approx(0.7634, abs=1e-3)
    assert rows[2][0] == pytest.approx(0.7225, abs=1e-3) and rows[2][1] == pytest.approx(1.0)


def test_crc_known_value(spark):
    assert frames.crc_of(np.frombuffer(b"123456789", np.uint8)[None, :])[0] == 0x29B1
    assert spark.range(1).select(S.crc16(F.lit(b"123456789"), 9)).first()[0] == 0x29B1


def test_crc_memory():
    records = np.zeros((10_000, 254), np.uint8)
    tracemalloc.start()
    assert len(set(frames.crc_of(records).tolist())) == 1
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * records.nbytes


def test_odd_codes(spark):
    series = {1: [], 2: None, 3: [1, None, -2], 4: list(range(70)), 5: [-1, 65536, 70000, -(2**31)]}
    built = frames.build(spark.createDataFrame([(k, k, v) for k, v in series.items()], "frame_id long, timestamp long, adc array<int>"))
    found = {r.frame_id: (r.crc_valid, r.adc) for r in frames.decode(built.select("raw")).collect()}
    want = {1: [], 3: [1, -2], 4: list(range(64)), 5: [-1, 0, 4464, 0]}
    assert found == {k: (True, v + [0] * (64 - len(v))) for k, v in want.items()}
    assert [r.raw for r in built.where("frame_id = 2").collect()] == [None]


def test_frames(spark, tmp_path):
    rows = spark.createDataFrame([(i, i * 50, [(-1) ** c * c * i for c in range(64)]) for i in (0, 1, 2, 5, 6)], "frame_id long, timestamp long, adc array<int>")
    raw = [bytes(r.raw) for r in frames.build(rows).orderBy("frame_id").collect()]
    assert all(len(x) == 256 for x in raw)
    bad = bytearray(raw[2])
    bad[20] ^= 0xFF
    (tmp_path / "a.bin").write_bytes(b"\x00\xa5junk" + raw[0] + raw[1] + bytes(bad) + raw[3] + raw[4] + raw[0][:100])
    decoded = frames.decode(frames.read(spark, str(tmp_path / "a.bin")))
    assert [(r.frame_id, r.crc_valid) for r in decoded.orderBy("pos").collect()] == [(0, True), (1, True), (2, False), (5, True), (6, True)]
    strict = frames.decode(frames.read(spark, str(tmp_path / "a.bin")), strict=True)
    gaps = D.gaps(strict.withColumn("block", F.floor(F.col("pos") / 3)), ["source"], ["pos"], "frame_id", "block").agg(F.sum("dropped")).first()[0]
    assert gaps == 3
    (tmp_path / "b.bin").write_bytes(b"".join(raw))
    back = frames.decode(frames.read(spark, str(tmp_path / "b.bin"), aligned=True)).orderBy("frame_id").collect()
    assert [list(r.adc) for r in back] == [[(-1) ** c * c * i for c in range(64)] for i in (0, 1, 2, 5, 6)]
    assert frames.samples(decoded, ["frame_id"]).count() == 5 * 64


def test_rhd(spark, tmp_path):
    def text(x):
        return struct.pack("<I", 2 * len(x)) + x.encode("utf-16-le") if x else struct.pack("<I", 0xFFFFFFFF)

    head = struct.pack("<I", rhd.MAGIC) + struct.pack(rhd.FIXED, 2, 0, 20000.0, *[0] * 10) + text("") * 3 + struct.pack("<hh", 0, 0) + text("") + struct.pack("<h", 1)
    head += text("Port A") + text("A") + struct.pack(rhd.GROUP, 1, 3, 2)
    for i, (kind, on) in enumerate([(0, 1), (0, 1), (1, 1)]):
        head += text(f"A-{i}") + text("") + struct.pack(rhd.CHANNEL, 0, 0, kind, on, *[0] * 8)
    blocks = b""
    for b in range(3):
        blocks += np.arange(b * 128, (b + 1) * 128, dtype="<i4").tobytes() + np.stack([np.full(128, 32768 + b), np.full(128, 32768 - 10)]).astype("<u2").tobytes() + bytes(2 * 32)
    (tmp_path / "x.rhd").write_bytes(head + blocks + b"tail")
    found = rhd.read(spark, str(tmp_path / "x.rhd")).orderBy("channel", "block_idx").collect()
    assert [(r.channel, r.block_idx, r.start_idx, r.name) for r in found] == [(c, b, b * 128, f"A-{c}") for c in (0, 1) for b in range(3)]
    assert found[2].uv == pytest.approx([0.39] * 128) and found[3].uv == pytest.approx([-1.95] * 128) and found[0].fs == 20000
    with pytest.raises(ValueError):
        rhd.header(b"nothing here")


@pytest.mark.parametrize(
    ("order", "cut", "kind", "inside", "outside"),
    [(2, 1.0, "high", 40.0, 0.02), (3, 300.0, "high", 3000.0, 10.0), (4, (55.0, 65.0), "band", 60.0, 120.0), (4, (990.0, 1010.0), "band", 1000.0, 60.0), (4, 100.0, "low", 5.0, 2000.0)],
)
def test_filters_at_20_khz(order, cut, kind, inside, outside):
    """The response is Butterworth's, stable, and what a tone keeps after the filter."""
    fs = 20_000.0
    f = dsp.butterworth(order, cut, kind, fs)
    assert np.abs(f.poles).max() < 1
    edges = np.atleast_1d(cut)
    assert np.abs(f.response(edges, fs)) == pytest.approx(math.sqrt(0.5), rel=1e-6)
    assert abs(f.response(inside, fs)) == pytest.approx(1, abs=1e-3) and abs(f.response(outside, fs)) < 0.01
    n = 40_000 if kind != "high" or cut > 1 else 400_000
    t = np.arange(n) / fs
    tone, other = np.sin(2 * np.pi * inside * t), np.sin(2 * np.pi * outside * t)
    y = dsp.apply_filter(f, (tone + (other if kind != "high" or cut > 1 else 0))[None, :])[0]
    middle = slice(n // 3, 2 * n // 3)
    assert np.abs(y - tone)[middle].max() < 0.02
    noise = np.random.default_rng(1).standard_normal((1, 20_000))
    assert np.sqrt((dsp.apply_filter(f, noise) ** 2).mean()) <= 1.1


def _recursive(f, x):
    """The filter as a cascade of one recursion for each pole, in complex numbers, from rest."""
    y = x.astype(complex) * f.gain
    for zero, pole in zip(f.zeros, f.poles, strict=True):
        out, last_in, last_out = np.empty_like(y), 0, 0
        for i, v in enumerate(y):
            last_out = v - zero * last_in + pole * last_out
            last_in, out[i] = v, last_out
        y = out
    return y.real


def test_filter_equals_the_recursion():
    rng = np.random.default_rng(3)
    for order, cut, kind in ((2, 20.0, "high"), (4, (80.0, 120.0), "band"), (3, 100.0, "low")):
        f = dsp.butterworth(order, cut, kind, 2000.0)
        rest = np.zeros(f.settles())
        x = np.concatenate([rest, rng.standard_normal(3000), rest])
        assert dsp.apply_filter(f, x[None, :], causal=True)[0] == pytest.approx(_recursive(f, x), abs=1e-5)
        assert dsp.apply_filter(f, x[None, :])[0] == pytest.approx(_recursive(f, _recursive(f, x)[::-1])[::-1], abs=1e-4)


def test_filter_queries_equal_whole_series(spark):
    """highpass_rms and bandpass_crosstalk against filters over each whole series."""
    from oscine.plans import generated_queries as G

    folder = "/root/testdata/sf0.001"
    series = {}
    for r in G.hourly(spark, folder).collect():
        series.setdefault(r.channel, {})[r.hour] = r.uv
    series = {c: np.array([v[k] for k in sorted(v)]) for c, v in series.items()}
    high = {c: dsp.apply_filter(dsp.butterworth(2, 0.5, "high", G.FS), v[None, :])[0] for c, v in series.items()}
    for r in G.highpass_rms(spark, folder).collect():
        part = high[r.channel][r.block_idx * G.SIZE : (r.block_idx + 1) * G.SIZE]
        assert r.rms == pytest.approx(np.sqrt((part**2).mean()), rel=1e-3)
    band = {c: (dsp.apply_filter(dsp.butterworth(4, (0.8, 1.25), "band", G.FS), v[None, :]) ** 2).sum() for c, v in series.items()}
    found = {r.channel: r.isolation_db for r in G.bandpass_crosstalk(spark, folder).collect()}
    assert len(found) == 5 and found["click"] == 0
    for c, v in found.items():
        assert v == pytest.approx(10 * np.log10(band[c] / band["click"]), abs=0.05)


def test_welch_and_resample_queries(spark):
    from oscine.plans import generated_queries as G

    folder = "/root/testdata/sf0.001"
    blocks = {(r.channel, r.block_idx): np.array(r["values"]) for r in G._blocks(spark, folder).collect()}
    for r in G.resample_error(spark, folder).collect():
        x = blocks[r.channel, r.block_idx]
        spectrum = np.fft.fft(x)
        spectrum[np.abs(np.fft.fftfreq(len(x))) > 0.25] = 0
        limit = np.abs(np.fft.fft(x)[len(x) // 4]) ** 2 * 2 / len(x) ** 2  # the bin at the lower rate's limit may go half
        assert abs(r.lost - ((x - np.fft.ifft(spectrum).real) ** 2).mean()) <= limit + 1e-6
    for r in G.welch_features(spark, folder).collect():
        hz, p = dsp.welch(blocks[r.channel, r.block_idx][None, :], G.FS, 48)
        inside = (hz >= 0.5) & (hz <= 4)
        assert r.bandpower == pytest.approx(p[0][inside].sum() * G.FS / 48, rel=0.3)


def test_filtered_blocks_equal_whole(spark):
    s = synthetic.recordings(spark, "crosstalk", 1, 2, 1000.0, 3.0, seed=1)
    keys = ["recording_id", "channel"]
    small = dsp.filtered(dsp.to_blocks(s, keys, "sample_idx", "uv", 500), keys, "values", 2, 20.0, "high", 1000.0, 500)
    whole = dsp.filtered(dsp.to_blocks(s, keys, "sample_idx", "uv", 3000), keys, "values", 2, 20.0, "high", 1000.0, 3000)
    a = np.concatenate([r.values for r in small.where("channel = 1").orderBy("block_idx").collect()])
    b = np.array(whole.where("channel = 1").first().values)
    assert len(a) == len(b) and np.abs(a - b)[100:-100].max() < 1e-3


def test_sine_rms_and_spectrum(spark):
    n, fs = 64, 640.0
    rows = [(0, i, 100 * math.sin(2 * math.pi * 100 * i / fs) + 5) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, x double")
    whole = df.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("x"))
    powers = whole.select("k", spectral.periodogram(F.col("x"), fs).alias("power"))
    own = powers.select(spectral.band_power(F.col("power"), 0, fs / 2, fs / n), spectral.power_edge(F.col("power"), fs / n), spectral.line_to_band(F.col("power"), 100, 0, fs / 2, fs / n)).first()
    assert own[0] == pytest.approx(5000, rel=1e-6) and own[1] == 100 and own[2] == pytest.approx(1)
    psd = powers.select("k", F.posexplode("power").alias("bin", "power")).withColumn("hz", F.col("bin") * fs / n)
    assert psd.orderBy(F.desc("power")).first().hz == 100
    assert spectral.bandpower(psd, ["k"], 0, fs / 2, fs / n).first().bandpower == pytest.approx(5000, rel=1e-6)
    assert spectral.edge(psd, ["k"]).first().edge_hz == 100
    assert W.tumbling(df.withColumn("w", F.lit(0)), ["k"], "w", rms=W.rms(F.col("x") - 5)).first().rms == pytest.approx(100 / math.sqrt(2))
    hz, p = dsp.welch(np.array([r[2] for r in rows]), fs, 32)
    assert hz[p.argmax()] == 100


def _cusum(z, drift):
    up = down = 0.0
    out = [0.0]
    for x in z[1:]:
        up, down = max(0.0, up + x - drift), max(0.0, down - x - drift)
        out.append(max(up, down))
    return out


def test_cusum_and_latch_against_loops(spark):
    rng = random.Random(3)
    series = {k: [rng.gauss(0, 2) for _ in range(40)] for k in range(8)}
    df = spark.createDataFrame([(k, i, z) for k, v in series.items() for i, z in enumerate(v)], "k int, i int, z double")
    traced = D.cusum(df, ["k"], "i", 0.5)
    for k, v in series.items():
        got = [r.cusum for r in traced.where(F.col("k") == k).orderBy("i").collect()]
        assert got == pytest.approx(_cusum(v, 0.5))
    fired = {(r.k, r.i) for r in D.latched(traced, ["k"], "i", "cusum", 3.0).collect()}
    want = set()
    for k, v in series.items():
        armed = True
        for i, s in enumerate(_cusum(v, 0.5)):
            if armed and s > 3:
                want.add((k, i))
                armed = False
            elif s <= 1.5:
                armed = True
    assert fired == want


def test_dead_time_keeps_greedily(spark):
    rng = random.Random(2)
    rows = {k: sorted(rng.sample(range(400), 150)) for k in (1, 2)} | {3: [0, 1, 2, 3, 5, 6, 9], 4: list(range(0, 300, 50))}
    df = spark.createDataFrame([(k, t) for k, v in rows.items() for t in v], "k int, t long").withColumn("block", F.floor(F.col("t") / 20))
    want = set()
    for k, v in rows.items():
        last = None
        for t in v:
            if last is None or t - last >= 3:
                want.add((k, t))
                last = t
    found = [(r.k, r.t) for r in W.dead_time(df, ["k"], "t", 3, "block").collect()]
    assert set(found) == want and len(found) == len(want)


def test_previous_row_by_blocks(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, 1.0, 2.0])) for k in "ab" for i in sorted(rng.sample(range(90), 40))]
    df = spark.createDataFrame(rows, "k string, i int, x double").withColumn("block", F.floor(F.col("i") / 10))
    found = {(r.k, r.i): r.before for r in W.previous(df, ["k"], "block", ["i"], "x", "before").collect()}
    assert found == {(k, i): rows[n - 1][2] if n and rows[n - 1][0] == k else None for n, (k, i, _) in enumerate(rows)}


def test_mahalanobis_of_three_measures(spark):
    rng = np.random.default_rng(4)
    x = {k: rng.normal(size=(30, 3)) @ rng.normal(size=(3, 3)) for k in "ab"}
    df = spark.createDataFrame([(k, i, *map(float, r)) for k, v in x.items() for i, r in enumerate(v)], "k string, i int, a double, b double, c double")
    found = {(r.k, r.i): r.d2 for r in T.mahalanobis(df, ["k"], ["a", "b", "c"]).collect()}
    for k, v in x.items():
        inverse = np.linalg.inv(np.cov(v.T) + 1e-6 * np.eye(3))
        away = v - v.mean(0)
        assert [found[k, i] for i in range(30)] == pytest.approx(((away @ inverse) * away).sum(1).tolist(), rel=1e-6)


def test_signed_rank_with_ties_and_bootstrap(spark):
    rng = random.Random(5)
    groups = {"ties": [rng.choice([-2, -1, 1, 2, 3]) for _ in range(40)], "none": [rng.uniform(-1, 2) for _ in range(20)], "few": [1.0, 2.0, -3.0]}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in groups.items() for i, v in enumerate(x)], "k string, i int, d double")
    found = {r.k: r for r in learning.wilcoxon(df.select("k", "d"), ["k"], "d").collect()}
    for k, x in groups.items():
        size = sorted(abs(v) for v in x)
        rank = {s: np.mean([i + 1 for i, y in enumerate(size) if y == s]) for s in size}
        w, n = sum(rank[abs(v)] for v in x if v > 0), len(x)
        assert (found[k].n, found[k].w) == (n, pytest.approx(w))
        if k == "ties":
            tied = sum(c**3 - c for c in (size.count(s) for s in set(size)))
            z = (w - n * (n + 1) / 4) / math.sqrt((n * (n + 1) * (2 * n + 1) - tied / 2) / 24)
            assert found[k].p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
        elif k == "few":
            assert found[k].p is None
        else:
            assert found[k].p == pytest.approx(learning.signed_rank_p(n, w))
    ci = {r.k: r for r in learning.bootstrap_mean(df, ["k"], "d", 200).collect()}
    for k in ("ties", "none"):
        spread = np.std(groups[k]) / math.sqrt(len(groups[k]))
        assert ci[k].low < np.mean(groups[k]) < ci[k].high and ci[k].high - ci[k].low == pytest.approx(2 * 1.96 * spread, rel=0.35)


def test_flat_baseline_detects_nothing(spark):
    df = spark.createDataFrame([(1, i, 1.0 if i < 5 else 9.0) for i in range(12)], "k int, i int, x double")
    traced = D.cusum(D.baseline_z(df, ["k"], "i", "x", 4), ["k"], "i", 0.5)
    assert D.first_alarm(traced, ["k"], "i", "cusum", 1.0, 4).first().alarm is None


def test_near_pairs_and_reach(spark):
    rng = random.Random(4)
    pts = [(i, rng.choice("ab"), rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(200)]
    df = spark.createDataFrame(pts, "id int, net string, x double, y double")
    got = {(r.id, r.id_r) for r in relational.near_pairs(df, df, ["net"], "x", "y", 0.7).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if a[1] == b[1] and abs(a[2] - b[2]) < 0.7 and abs(a[3] - b[3]) < 0.7}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    assert {tuple(r) for r in relational.reachable(edges, spark.createDataFrame([(1,)], "node long")).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_generated_rows_do_not_depend_on_partitions(spark):
    a = synthetic.recordings(spark, "neurotox", 1, 2, 500.0, 1.0, seed=9)
    assert a.repartition(7).orderBy("channel", "sample_idx").collect() == a.coalesce(1).orderBy("channel", "sample_idx").collect()
    noise = synthetic.recordings(spark, "baseline", 1, 4, 2000.0, 5.0, seed=1, rate_hz=0.0)
    assert 4.5 < noise.agg(W.rms("uv")).first()[0] < 5.5
    with pytest.raises(ValueError):
        synthetic.recordings(spark, "other")
    with pytest.raises(ValueError):
        synthetic.disturb(noise, "other", 1.0, 0, 1.0, 1)


def test_signed_rank():
    assert learning.signed_rank_p(6, 21) == pytest.approx(2 / 64)
    assert learning.signed_rank_p(6, 0) == pytest.approx(2 / 64)
    assert learning.signed_rank_p(10, 27.5) == 1.0
    assert learning.guarded(lambda: 1 / 0)[0] == "skipped"


def test_segments_and_rectangles(spark):
    rng = random.Random(6)

    def segment():
        x, y = rng.uniform(0, 20), rng.uniform(0, 20)
        return x, y, x + rng.uniform(-3, 3), y + rng.uniform(-3, 3)

    def plain(p, q):
        at = [np.array([p[0] + (p[2] - p[0]) * t, p[1] + (p[3] - p[1]) * t]) for t in np.linspace(0, 1, 201)]
        c, d = np.array(q[:2]), np.array(q[2:]) - np.array(q[:2])
        return min(np.linalg.norm(x - c - d * np.clip((x - c) @ d / (d @ d), 0, 1)) for x in at)

    left, right = [(i, *segment()) for i in range(40)], [(i, *segment()) for i in range(40)]
    schema = "id int, ax double, ay double, bx double, by double"
    found = {(r.id, r.id_r): r.distance for r in relational.near_segments(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 1.0, 2.5).collect()}
    for i, *p in left:
        for j, *q in right:
            far = plain(p, q)
            if far < 0.98:
                assert found[i, j] == pytest.approx(far, abs=0.03)
            elif far > 1.02:
                assert (i, j) not in found
    box = [F.lit(float(v)) for v in (0, 0, 2, 1)]
    d = spark.range(1).select(*[relational.rectangle_distance(F.lit(float(x)), F.lit(float(y)), *box) for x, y in ((1, 0.5), (5, 5), (-3, 0.5))]).first()
    assert tuple(d) == (0.0, 5.0, 3.0)


def test_small_scalars(spark):
    rows = spark.createDataFrame([(0.0, [1.0, 2.0, 3.0]), (None, []), (float("nan"), None), (1.5, [1.0])], "x double, v array<double>")
    assert [r[0] for r in rows.select(S.csv_number("x", 2)).collect()] == ["0.00", "", "", "1.50"]
    assert [r[0] for r in rows.select(S.cut_or_padded("v", 2)).collect()] == [[1.0, 2.0], [0.0, 0.0], None, [1.0, 0.0]]
    first = rows.limit(1).select(S.ticks_to_seconds(F.lit(40_000), 20_000.0), S.window_centre(F.lit(0), F.lit(200), 100.0), S.realtime_factor(F.lit(10), F.lit(4)), S.realtime_factor(F.lit(10), F.lit(0))).first()
    assert tuple(first) == (2.0, 1.0, 2.5, None)


def _plain_features(x, fs):
    """The features read off spectra by plain loops, for channels of one window."""
    n = x.shape[1]
    out = {"rms_raw": [], "mid": [], "slope": [], "kurtosis": []}
    for row in x:
        size = min(2048, n)
        w = np.array([0.5 - 0.5 * math.cos(2 * math.pi * i / size) for i in range(size)])
        parts = [row[s : s + size] for s in range(0, n - size + 1, size - size // 2)]
        power = np.mean([[abs(sum(v * c * np.exp(-2j * math.pi * k * i / size) for i, (v, c) in enumerate(zip(p - p.mean(), w, strict=True)))) ** 2 for k in range(size // 2 + 1)] for p in parts], 0)
        power = power / (fs * (w**2).sum()) * np.array([1, *[2] * (size // 2 - 1), 1])
        hz = np.arange(size // 2 + 1) * fs / size
        inside = (hz >= 30) & (hz <= 300)
        out["mid"].append(power[inside].sum() * fs / size)
        out["slope"].append(np.polyfit(np.log10(hz[inside]), np.log10(power[inside] + 1e-30), 1)[0])
        out["kurtosis"].append(((row - row.mean()) ** 4).mean() / row.var() ** 2 - 3)
    return out


def test_feature_vectors(spark):
    from oscine.operators import features

    rng = np.random.default_rng(8)
    fs, n = 640.0, 64
    x = {(r, w): rng.normal(size=(3, n)) * 60 + 5 for r in range(2) for w in range(2)}
    x[1, 1][2] = 7.0  # a flat channel
    rows = [(r, w, c, v.tolist()) for (r, w), chans in x.items() for c, v in enumerate(chans)]
    df = spark.createDataFrame(rows, "recording int, window_idx int, channel int, values array<double>")
    found = {(r.recording, r.window_idx): r for r in features.feature_vectors(df, ["recording", "window_idx"], fs).collect()}
    assert len(features.NAMES) == 23 and set(found) == set(x)
    for key, chans in x.items():
        want, got = _plain_features(chans[:2], fs), features.feature_vectors(df.where(f"recording = {key[0]} AND window_idx = {key[1]} AND channel < 2"), ["recording", "window_idx"], fs).first()
        assert got.mid_mean == pytest.approx(np.mean(want["mid"])) and got.mid_std == pytest.approx(np.std(want["mid"]))
        assert got.slope_mean == pytest.approx(np.mean(want["slope"])) and got.kurtosis_mean == pytest.approx(np.mean(want["kurtosis"]))
        assert got.pairwise_corr == pytest.approx(np.corrcoef(chans[:2])[0, 1], abs=1e-9)
    assert all(math.isfinite(v) for r in found.values() for v in r)
    spikes = np.zeros((1, 2000))
    spikes[0, [100, 105, 500, 900]] = -80.0
    assert features.spike_rates(spikes, 20_000.0)[0] == pytest.approx(3 / 0.1)  # the second comes within the refractory time
    long = spark.createDataFrame([(0, c, i, float(i + c)) for c in range(2) for i in range(25)], "r int, channel int, i int, x double")
    cut = {(w.window_idx, w.channel): w["values"] for w in features.windows_of(long, ["r"], "i", "x", 10, 5).collect()}
    assert sorted(cut) == [(w, c) for w in range(4) for c in range(2)] and cut[1, 1] == [float(v) for v in range(6, 16)]
    means = features.trial_rows(features.feature_vectors(df, ["recording", "window_idx"], fs), ["recording"], 1, 5).collect()
    assert all(m.rms_mean == pytest.approx(found[m.recording, 1].rms_mean) and m.n_windows == 1 for m in means)
