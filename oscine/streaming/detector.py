"""Windows, gaps and detection over streams; the same columns as in batch.

Event time is a timestamp; rows later than the watermark are dropped, and a window's row comes when the watermark has passed
its end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from oscine.operators.windowing import rms
from oscine.sources.frames import cut


def windowed_rms(stream: DataFrame, keys: list[str], time: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Keys, window start, n and RMS of each closed window."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    found = timed.groupBy(*keys, F.window(time, width).alias("w")).agg(F.count("*").alias("n"), rms(value).alias("rms"))
    return found.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "rms")


_ALERT = "{key} string, window_idx long, end timestamp, statistic double"
_STATE = "n long, total double, squares double, up double, down double, armed boolean"


def cusum_alerts(windows: DataFrame, key: str, baseline: int, drift: float, threshold: float) -> DataFrame:
    """Alerts of a two-sided cumulative sum with a latch, window by window; windows: key, end, rms. State for each series: the
    sums of the baseline, both sides, and whether it is armed. Sums run from the end of the baseline on, as its spread isn't
    known before."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, squares, up, down, armed = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, True)
        rows = pd.concat(list(frames)).sort_values("end")
        out = []
        for end, x in zip(rows["end"], rows["rms"], strict=True):
            if n < baseline:
                total, squares = total + x, squares + x * x
            else:
                mean = total / baseline
                spread = max(squares / baseline - mean * mean, 0.0) ** 0.5
                z = (x - mean) / spread if spread >= 1e-15 else 0.0
                up, down = max(0.0, up + z - drift), max(0.0, down - z - drift)
                top = max(up, down)
                if armed and top > threshold:
                    out.append((group[0], n, end, top))
                    armed = False
                elif top <= threshold / 2:
                    armed = True
            n += 1
        state.update((n, float(total), float(squares), float(up), float(down), bool(armed)))
        if out:
            yield pd.DataFrame(out, columns=[key, "window_idx", "end", "statistic"])

    return windows.select(key, "end", "rms").groupBy(key).applyInPandasWithState(step, _ALERT.format(key=key), _STATE, "append", GroupStateTimeout.NoTimeout)


def merged(spans: list[list[int]], numbers: np.ndarray) -> tuple[list[list[int]], int]:
    """Spans of numbers, first and last, with more numbers put in, and how many of those were new."""
    before = sum(b - a + 1 for a, b in spans)
    new = np.unique(numbers)
    breaks = np.flatnonzero(np.diff(new) > 1)
    more = list(zip(new[np.append(0, breaks + 1)].tolist(), new[np.append(breaks, len(new) - 1)].tolist(), strict=True)) if len(new) else []
    out: list[list[int]] = []
    for a, b in sorted([*map(tuple, spans), *more]):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out, sum(b - a + 1 for a, b in out) - before


def _packed(spans: np.ndarray) -> bytes:
    """Spans, a row of first and last each, as their steps in bytes that are as few as the largest takes."""
    steps = np.diff(spans.ravel(), prepend=0)
    kind = np.min_scalar_type(int(steps[1:].max())) if len(steps) > 1 else np.dtype(np.uint8)
    return np.array([kind.itemsize, *steps[:1]], np.int64).tobytes() + steps[1:].astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    head = np.frombuffer(data[:16], np.int64)
    if len(head) < 2:
        return np.zeros((0, 2), np.int64)
    return np.cumsum(np.append(head[1:], np.frombuffer(data[16:], f"u{head[0]}").astype(np.int64))).reshape(-1, 2)


def _joined(spans: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Spans of numbers with more numbers put in, in whole arrays."""
    both = np.concatenate([spans, np.repeat(np.unique(numbers), 2).reshape(-1, 2)])
    both = both[np.argsort(both[:, 0], kind="stable")]
    upto = np.maximum.accumulate(both[:, 1])
    breaks = np.flatnonzero(both[1:, 0] > upto[:-1] + 1)
    return np.column_stack([both[np.append(0, breaks + 1), 0], upto[np.append(breaks, len(both) - 1)]])


def frame_counters(frames: DataFrame, key: str, wrap: int = 1 << 32) -> DataFrame:
    """Frames seen, bad, repeated and dropped so far of each device, update by update; frames: key, frame_id, crc_valid. Drops
    are the numbers between the first and the last good frame that no good frame had, so that neither the order of arrival nor
    a frame that comes twice matters; numbers start again at wrap. The state is the spans of numbers seen, one for each gap, in
    one to eight bytes an end; of an update's frames only the numbers are held."""

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, bad, repeated, packed = state.get if state.exists else (0, 0, 0, b"")
        spans, found = _unpacked(bytes(packed)), []
        for rows in parts:
            found.append(rows.loc[rows["crc_valid"].astype(bool), "frame_id"].to_numpy(np.int64))
            seen, bad = seen + len(rows), bad + len(rows) - len(found[-1])
        good = np.concatenate(found)
        if len(good):
            near = int(spans[-1, 1]) if len(spans) else int(good[0])
            before = int((spans[:, 1] - spans[:, 0] + 1).sum())
            spans = _joined(spans, near + (good - near + wrap // 2) % wrap - wrap // 2)
            repeated += len(good) - (int((spans[:, 1] - spans[:, 0] + 1).sum()) - before)
        state.update((seen, bad, repeated, _packed(spans)))
        dropped = int((spans[1:, 0] - spans[:-1, 1] - 1).sum())
        yield pd.DataFrame([(group[0], seen, bad, repeated, dropped)], columns=[key, "seen", "bad", "repeated", "dropped"])

    grouped = frames.select(key, "frame_id", "crc_valid").groupBy(key)
    return grouped.applyInPandasWithState(step, f"{key} string, seen long, bad long, repeated long, dropped long", "seen long, bad long, repeated long, spans binary", "update", GroupStateTimeout.NoTimeout)


def frames_of_pieces(stream: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """key, n, raw of the records of a stream of pieces of captures. A piece's last bytes wait in the state for the piece that
    completes them; pieces of a batch are taken in order, and batches as they come."""

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, rest = state.get if state.exists else (0, b"")
        found: list[bytes] = []
        for piece in pd.concat(list(parts)).sort_values(order)[data]:
            records, rest = cut(bytes(rest) + bytes(piece or b""))
            found += records
        state.update((n + len(found), bytes(rest)))
        if found:
            yield pd.DataFrame({key: group[0], "n": range(n, n + len(found)), "raw": found})

    grouped = stream.select(key, order, data).groupBy(key)
    return grouped.applyInPandasWithState(step, f"{key} string, n long, raw binary", "n long, rest binary", "append", GroupStateTimeout.NoTimeout)
