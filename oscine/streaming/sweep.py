"""A detector with many thresholds and dead times at once on a stream, and frame counters whose state stays bounded.

Both keep named state (the RocksDB store must be the session's): what belongs to one threshold or one gap is one entry of a map,
read and written alone. rocksdb() gives the settings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from oscine.streaming.detector import merged

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def rocksdb(spark: SparkSession) -> None:
    """Lets the session's streams keep named state."""
    spark.conf.set(*STORE)


class _Sweep(StatefulProcessor):
    """State of a series: the trace (next window, sums of the baseline, both sides of the CUSUM), for each threshold whether it is
    armed, for each threshold and dead time the last alert that was kept, and the windows that came before their turn."""

    def __init__(self, key: str, thresholds: list[float], cooldowns: list[int], baseline: int, drift: float, release: float):
        self.key, self.thresholds, self.cooldowns = key, thresholds, cooldowns
        self.baseline, self.drift, self.release = baseline, drift, release

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trace = handle.getValueState("trace", "next long, total double, squares double, up double, down double, late long")
        self.armed = handle.getMapState("armed", "threshold double", "armed boolean")
        self.kept = handle.getMapState("kept", "threshold double, cooldown long", "window_idx long")
        self.early = handle.getMapState("early", "window_idx long", "rms double, end long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        values = {int(i): (float(x), int(e)) for i, x, e in zip(batch["window_idx"], batch["rms"], batch["end_ms"], strict=True)}
        known = dict((k[0], tuple(v)) for k, v in self.early.iterator())
        yield from self._run(key, {**known, **values}, known, None)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed a waiting window's end: windows before it won't come any more."""
        known = dict((k[0], tuple(v)) for k, v in self.early.iterator())
        yield from self._run(key, known, known, expiredTimerInfo.getExpiryTimeInMs())

    def _run(self, key: tuple, waiting: dict, known: dict, passed: int | None) -> Iterator[pd.DataFrame]:
        at, total, squares, up, down, late = self.trace.get() if self.trace.exists() else (0, 0.0, 0.0, 0.0, 0.0, 0)
        armed = {k[0]: v[0] for k, v in self.armed.iterator()} or dict.fromkeys(self.thresholds, True)
        kept = {tuple(k): v[0] for k, v in self.kept.iterator()}
        before = dict(armed), dict(kept)
        late += sum(i < at for i in waiting)
        waiting = {i: v for i, v in waiting.items() if i >= at}
        out = []
        while waiting:
            i = min(waiting)
            if i > at and (passed is None or waiting[i][1] > passed):
                break
            at = i
            x, end = waiting.pop(i)
            if at < self.baseline:
                total, squares = total + x, squares + x * x
            else:
                mean = total / self.baseline
                spread = max(squares / self.baseline - mean * mean, 0.0) ** 0.5
                z = (x - mean) / spread if spread >= 1e-15 else 0.0
                up, down = max(0.0, up + z - self.drift), max(0.0, down - z - self.drift)
                top = max(up, down)
                for t in self.thresholds:
                    if top <= self.release * t:
                        armed[t] = True
                    elif armed[t] and top > t:
                        armed[t] = False
                        for c in self.cooldowns:
                            if (t, c) not in kept or at - kept[t, c] >= c:
                                kept[t, c] = at
                                out.append((key[0], t, c, at, top))
            at += 1
        self.trace.update((at, total, squares, up, down, late))
        for t, v in armed.items():
            if before[0].get(t) != v or t not in before[0]:
                self.armed.updateValue((t,), (v,))
        for k, v in kept.items():
            if before[1].get(k) != v:
                self.kept.updateValue(k, (v,))
        for i in known.keys() - waiting.keys():
            self.early.removeKey((i,))
        for i, v in waiting.items():
            if i not in known:
                self.early.updateValue((i,), v)
        if waiting:
            self.handle.registerTimer(min(e for _, e in waiting.values()))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "threshold", "cooldown", "window_idx", "statistic"])

    def close(self) -> None:
        pass


def sweep(windows: DataFrame, key: str, thresholds: list[float], cooldowns: list[int], baseline: int, drift: float, late: str, release: float = 0.5) -> DataFrame:
    """Alerts of every threshold and cooldown (windows between two alerts at least) as rows: key, threshold, cooldown, window_idx,
    statistic. windows: key, window_idx from 0, end (timestamp), rms; they may come in any order. A series is worked on window
    by window; a window waits for those before it until the watermark, late behind the latest end, has passed its own end, also
    where no further row of its series comes. Windows later than that are counted and left out. The trace is computed once."""
    rows = windows.withWatermark("end", late).select(key, F.col("window_idx").cast("long").alias("window_idx"), "end", F.unix_millis("end").alias("end_ms"), F.col("rms").cast("double").alias("rms"))
    processor = _Sweep(key, [float(t) for t in thresholds], [int(c) for c in cooldowns], baseline, drift, release)
    schema = f"{key} string, threshold double, cooldown long, window_idx long, statistic double"
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


class _Counters(StatefulProcessor):
    """State of a device: its counts, and the spans of numbers seen within the last patience numbers, an entry each."""

    def __init__(self, key: str, wrap: int, patience: int):
        self.key, self.wrap, self.patience = key, wrap, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "seen long, bad long, repeated long, settled long, late long, low long")
        self.spans = handle.getMapState("spans", "first long", "last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, bad, repeated, settled, late, low = self.counts.get() if self.counts.exists() else (0, 0, 0, 0, 0, None)
        known = {k[0]: v[0] for k, v in self.spans.iterator()}
        spans = sorted([a, b] for a, b in known.items())
        for part in rows:
            good = part.loc[part["crc_valid"].astype(bool), "frame_id"].to_numpy(np.int64)
            seen, bad = seen + len(part), bad + len(part) - len(good)
            if not len(good):
                continue
            near = spans[-1][1] if spans else int(good[0])
            numbers = near + (good - near + self.wrap // 2) % self.wrap - self.wrap // 2
            if low is not None:
                late += int((numbers < low).sum())
                numbers = numbers[numbers >= low]
            if len(numbers):
                spans, new = merged(spans, numbers)
                repeated += len(numbers) - new
            while len(spans) > 1 and spans[0][1] < spans[-1][1] - self.patience:  # the gap behind it is settled
                settled += spans[1][0] - spans[0][1] - 1
                low = spans[1][0]
                spans = spans[1:]
        self.counts.update((seen, bad, repeated, settled, late, low))
        now = dict(map(tuple, spans))
        for a in known.keys() - now.keys():
            self.spans.removeKey((a,))
        for a, b in now.items():
            if known.get(a) != b:
                self.spans.updateValue((a,), (b,))
        dropped = settled + sum(b[0] - a[1] - 1 for a, b in zip(spans, spans[1:]))
        yield pd.DataFrame([(key[0], seen, bad, repeated, dropped, late, len(spans))], columns=[self.key, "seen", "bad", "repeated", "dropped", "late", "open_spans"])

    def close(self) -> None:
        pass


def bounded_counters(frames: DataFrame, key: str, patience: int = 65536, wrap: int = 1 << 32) -> DataFrame:
    """Frames seen, bad, repeated, dropped and late so far of each device, update by update, and how many spans its state holds;
    frames: key, frame_id, crc_valid. Drops are the numbers between the first and the last good frame that no good frame had.
    A gap more than patience numbers behind the latest good one is settled: its frames are dropped for good, and a frame that
    comes for it all the same counts as late. So counts are exact for frames at most patience numbers late, repeated ones
    included, and the state holds no more spans than patience numbers can, however long frames are lost."""
    rows = frames.select(key, F.col("frame_id").cast("long").alias("frame_id"), "crc_valid")
    schema = f"{key} string, seen long, bad long, repeated long, dropped long, late long, open_spans long"
    return rows.groupBy(key).transformWithStateInPandas(_Counters(key, wrap, patience), schema, "Update", "None")
