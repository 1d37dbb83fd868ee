"""One plan for all shifts against each shift scored by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscine.operators import learning, shifts

SHIFTS = {"scale": lambda s: {"x": F.col("x") * (1 - s)}, "swap": lambda s: {"x": F.col("y") * s, "y": F.col("x")}, "still": lambda s: {}}
LEVELS = [0.25, 1.0]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    label = rng.integers(0, 2, 160)
    values = [(i, float(c), float(c + rng.normal(0, 0.8)), float(rng.normal())) for i, c in enumerate(label)]
    return spark.createDataFrame(values, "i long, label double, x double, y double")


@pytest.fixture(scope="module")
def model(rows):
    return learning.forest(rows, ["x", "y"], "label", trees=8, depth=4)


def _plain(p, y):
    pos, neg = p[y == 1], p[y == 0]
    auroc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    fpr = min((neg >= t).mean() for t in np.unique(p) if (pos >= t).sum() >= 0.9 * len(pos))
    bins = np.minimum((p * 10).astype(int), 9)
    ece = sum((bins == b).mean() * abs(p[bins == b].mean() - y[bins == b].mean()) for b in np.unique(bins))
    return [len(p), ((p >= 0.5) == (y == 1)).mean(), auroc, fpr, ece]


def test_every_shift_as_if_alone(spark, rows, model):
    found = {(r["shift"], r.severity): r for r in shifts.evaluated(model, rows, "label", SHIFTS, LEVELS).collect()}
    assert set(found) == {("none", 0.0), *((n, s) for n in SHIFTS for s in LEVELS)}
    again = learning.forest(rows, ["x", "y"], "label", trees=8, depth=4)  # fitted for itself, with the same seed
    for (name, severity), r in found.items():
        own = rows.withColumns(SHIFTS[name](F.lit(severity))) if name != "none" else rows
        scored = learning.predicted(again, own).select("label", F.col("p")[1].alias("p")).toPandas()
        assert [r.n, r.accuracy, r.auroc, r.fpr_at_tpr, r.ece] == pytest.approx(_plain(scored["p"].to_numpy(), scored["label"].to_numpy()))
    assert found["still", 1.0].auroc == found["none", 0.0].auroc


def test_worst_and_pivot(spark):
    found = spark.createDataFrame(
        [("none", 0.0, 0.95, 0.1), ("a", 0.25, 0.9, 0.2), ("a", 1.0, 0.6, 0.5), ("b", 0.25, 0.8, 0.7), ("b", 1.0, 0.6, 0.6)], "shift string, severity double, auroc double, fpr_at_tpr double"
    )
    assert tuple(shifts.worst(found).first()) == ("a", 1.0, 0.6, "b", 0.7, pytest.approx(0.725))
    table = {r["shift"]: r for r in shifts.pivoted(found, "auroc", LEVELS).collect()}
    assert (table["a"].at_0_25, table["a"].at_1_0, table["a"].none, table["a"].drop) == (0.9, 0.6, 0.95, pytest.approx(0.35))
    assert shifts.worst(found.limit(0)).first().worst_shift is None and shifts.pivoted(found.limit(0), "auroc", LEVELS).count() == 0


def test_shifts_see_the_row_as_it_is(spark):
    rows = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 5.0)], "i long, x double, y double")
    got = {(r.i, r["shift"], r.severity): (r.x, r.y) for r in shifts.shifted(rows, SHIFTS, [0.5]).collect()}
    assert got[1, "swap", 0.5] == (1.5, 2.0) and got[1, "scale", 0.5] == (1.0, 3.0) and got[1, "none", 0.0] == (2.0, 3.0)
    assert got[2, "swap", 0.5] == (2.5, None) and got[2, "scale", 0.5] == (None, 5.0) and len(got) == 8


def test_detector_under_shifts(spark):
    rng = np.random.default_rng(1)
    trace = spark.createDataFrame([(c, w, float(10 + rng.normal(0, 0.5))) for c in "ab" for w in range(40)], "channel string, w long, v double")
    jump = {"jump": lambda s: {"v": F.when(F.col("w") >= 20, F.col("v") + 5 * s).otherwise(F.col("v"))}}
    found = {r.severity: r for r in shifts.detected(trace, ["channel"], "w", "v", jump, [0.0, 1.0], 10, 0.5, 8.0).collect()}
    rows = shifts.detected(trace, ["channel"], "w", "v", jump, [0.0, 1.0], 10, 0.5, 8.0).where("shift = 'jump'").orderBy("severity").collect()
    assert [r.series for r in rows] == [2, 2] and rows[1].alarms == 2 and 10 <= rows[1].latency <= 12 and rows[0].confidence < rows[1].confidence
    assert found[0.0].alarms == rows[0].alarms  # no shift and one of severity 0
