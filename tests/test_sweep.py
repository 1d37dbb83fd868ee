"""The detector's sweep and the bounded counters on streams against plain folds."""

import datetime as dt
import random

import pytest

from oscine.operators import detection
from oscine.streaming import sweep

GRID, WAITS, BASELINE, DRIFT = (1.0, 2.0, 4.0), (0, 3, 10), 5, 0.5
START = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def named_state(spark):
    before = spark.conf.get(sweep.STORE[0])
    sweep.rocksdb(spark)
    yield
    spark.conf.set(sweep.STORE[0], before)


def _run(spark, folder, batches, schema, build, mode):
    out = []
    for k, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = build(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out/{k}/batch_id={i}")).start().awaitTermination()
        out.append(spark.read.schema(stream.schema).parquet(f"{folder}/out/{k}").collect())
    return out


def _fold(series):
    """Alerts of one series of (window, value), in order."""
    early = [x for i, x in series if i < BASELINE]
    mean = sum(early) / BASELINE
    spread = max(sum(x * x for x in early) / BASELINE - mean * mean, 0) ** 0.5
    up = down = 0.0
    armed, kept, out = dict.fromkeys(GRID, True), {}, set()
    for i, x in series:
        if i < BASELINE:
            continue
        z = (x - mean) / spread if spread >= 1e-15 else 0.0
        up, down = max(0.0, up + z - DRIFT), max(0.0, down - z - DRIFT)
        top = max(up, down)
        for t in GRID:
            if top <= t / 2:
                armed[t] = True
            elif armed[t] and top > t:
                armed[t] = False
                for c in WAITS:
                    if (t, c) not in kept or i - kept[t, c] >= c:
                        kept[t, c] = i
                        out.add((t, c, i, round(top, 9)))
    return out


def _series(rng, n):
    level, out = 10.0, []
    for i in range(n):
        if rng.random() < 0.15:
            level = rng.choice([8.0, 10.0, 12.0])
        out.append((i, level + rng.gauss(0, 0.7)))
    return out


def _windows(name, series):
    return [(name, i, START + dt.timedelta(minutes=i + 1), x) for i, x in series]


SCHEMA = "device string, window_idx long, end timestamp, rms double"


def _build(late):
    return lambda stream: sweep.sweep(stream, "device", GRID, WAITS, BASELINE, DRIFT, late)


def test_sweep_in_any_order_equals_the_fold_and_the_batch(spark, tmp_path):
    rng = random.Random(5)
    series = {name: _series(rng, 90) for name in ("a", "b")}
    rows = [r for name, s in series.items() for r in _windows(name, s)]
    rng.shuffle(rows)
    found = _run(spark, tmp_path, [rows[:60], rows[60:70], rows[70:]], SCHEMA, _build("1 day"), "append")
    got = [(r.device, r.threshold, r.cooldown, r.window_idx, round(r.statistic, 9)) for part in found for r in part]
    want = {(name, *x) for name, s in series.items() for x in _fold(s)}
    assert set(got) == want and len(got) == len(want) > 20
    scored = detection.baseline_z(spark.createDataFrame(rows, SCHEMA), ["device"], "window_idx", "rms", BASELINE).where(f"window_idx >= {BASELINE}")
    trace = detection.cusum(scored.withColumn("k", scored["window_idx"] + 1), ["device"], "k", DRIFT).drop("k")
    batch = {(r.device, r.threshold, r.cooldown, r.window_idx, round(r.cusum, 6)) for r in detection.sweep(trace, ["device"], "window_idx", "cusum", list(GRID), list(WAITS), block=7).collect()}
    assert batch == {(*x[:4], round(x[4], 6)) for x in want}


def test_sweep_goes_on_behind_the_watermark(spark, tmp_path):
    """A window that never comes holds its series up until the watermark has passed, though no further row of it comes."""
    series = _series(random.Random(8), 60)
    without = [r for r in _windows("a", series) if r[1] not in (20, 21)]
    other = _windows("b", [(i, 1.0) for i in range(200)])
    first, second, third = _run(spark, tmp_path, [without, other, _windows("a", [series[20]])], SCHEMA, _build("10 minutes"), "append")
    before = {x for x in _fold([p for p in series if p[0] < 20])}
    # the watermark moves between two batches of one run, and the last windows of a wait in the first
    assert {(r.threshold, r.cooldown, r.window_idx) for r in first} >= {x[:3] for x in before}
    got = [(r.threshold, r.cooldown, r.window_idx, round(r.statistic, 9)) for part in (first, second, third) for r in part if r.device == "a"]
    want = _fold([p for p in series if p[0] not in (20, 21)])
    assert set(got) == want and len(got) == len(want)
    assert not [r for r in third if r.device == "a"]  # too late


COUNTED = "device string, frame_id long, crc_valid boolean"


def test_counters_stay_bounded_under_steady_loss(spark, tmp_path):
    """Every third frame is lost for good; the state holds what patience numbers can hold, and counts stay exact."""
    rng = random.Random(2)
    numbers = [i for i in range(6000) if i % 3]
    batches = []
    for lo in range(0, len(numbers), 1000):
        part = numbers[lo : lo + 1000]
        late = [part[k] for k in range(0, len(part), 7)]  # arrive one batch later
        batches.append((part, late))
    rows, held = [], []
    for part, late in batches:
        now = [x for x in part if x not in set(late)] + held
        rng.shuffle(now)
        rows.append([("d", x, True) for x in now] + [("d", now[0], True), ("d", 5, False)])
        held = late
    rows.append([("d", x, True) for x in held])
    found = _run(spark, tmp_path, rows, COUNTED, lambda s: sweep.bounded_counters(s, "device", patience=3200), "update")
    last = found[-1][-1]
    assert (last.seen, last.bad, last.repeated, last.late) == (len(numbers) + 2 * len(batches), len(batches), len(batches), 0)
    assert last.dropped == numbers[-1] - numbers[0] + 1 - len(numbers)
    assert max(r.open_spans for part in found for r in part) <= 3200 // 3 + 1200


def test_counters_wrap_and_late(spark, tmp_path):
    top = (1 << 32) - 2
    rows = [[("d", x, True) for x in (top, 1, 2)], [("d", top + 1, True), ("d", 500, True)], [("d", 0, True), ("d", 501, True)]]
    found = _run(spark, tmp_path, rows, COUNTED, lambda s: sweep.bounded_counters(s, "device", patience=100), "update")
    a, b, c = (part[-1] for part in found)
    assert (a.seen, a.dropped) == (3, 2)  # the last number and the first
    assert (b.dropped, b.late, b.open_spans) == (1 + 497, 0, 1)
    assert (c.seen, c.dropped, c.late) == (7, 498, 1)  # 0 comes for a gap that is settled
