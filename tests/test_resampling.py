"""Statistics by name and their bootstrap against numpy on the resamples themselves."""

import numpy as np
import pytest

from oscine.operators import resampling as R

PLAIN = {
    "mean": np.mean, "median": np.median, "std": np.std,
    "trimmed_mean": lambda x: np.sort(x)[int(0.1 * len(x)) : len(x) - int(0.1 * len(x))].mean(),
}


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_statistics_of_counts(name):
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        x = np.sort(rng.normal(size=n).round(1))
        counts = rng.multinomial(3 * n, np.full(n, 1 / n), 30)
        assert R.known(name)(x, counts) == pytest.approx([PLAIN[name](np.repeat(x, c)) for c in counts])


ROWS = "g string, i long, x double"


def _rows():
    rng = np.random.default_rng(5)
    rows = [(g, i, float(v)) for g, n in (("a", 400), ("b", 31), ("one", 1)) for i, v in enumerate(rng.exponential(size=n).round(2))]
    return rows + [("a", 900, None), ("b", 901, float("nan")), ("none", 1, None), (None, 1, 2.0), (None, 2, 4.0)]


def _by_group():
    out = {}
    for g, _, x in _rows():
        if x is not None and x == x:
            out.setdefault(g, []).append(x)
    return out


def test_grouped(spark):
    found = R.grouped(spark.createDataFrame(_rows(), ROWS).repartition(4), ["g"], "x", *PLAIN).collect()
    want = _by_group()
    assert {r.g: r.n for r in found} == {g: len(x) for g, x in want.items()}
    for r in found:
        assert [r[n] for n in PLAIN] == pytest.approx([f(np.array(want[r.g])) for f in PLAIN.values()], abs=1e-9)


@pytest.mark.parametrize("name", ["median", "trimmed_mean"])
def test_bootstrap_of_one_shard(spark, name):
    rounds, seed = 300, 7
    df = spark.createDataFrame(_rows(), ROWS)
    found = {r.g: r for r in R.bootstrap(df, ["g"], "x", ["i"], name, rounds, seed=seed).collect()}
    assert {tuple(r) for r in R.bootstrap(df.repartition(5), ["g"], "x", ["i"], name, rounds, seed=seed).collect()} == {tuple(r) for r in found.values()}
    for g, x in _by_group().items():
        x = np.sort(x)
        counts = np.random.default_rng(R.seed_of(seed, g, 0)).multinomial(len(x), np.full(len(x), 1 / len(x)), rounds)
        drawn = [PLAIN[name](np.repeat(x, c)) for c in counts]
        assert [found[g].estimate, found[g].low, found[g].high] == pytest.approx([PLAIN[name](x), *np.percentile(drawn, [2.5, 97.5])])


def test_bootstrap_in_shards(spark, monkeypatch):
    """Little bags give the interval of the plain bootstrap, nearly, and hold no more than a shard each."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(rng.normal(10, 2, 6000))], ROWS)
    whole = R.bootstrap(df, ["g"], "x", ["i"], "median", 400).first()
    monkeypatch.setattr(R, "SHARD", 1000)
    dealt = R.bootstrap(df, ["g"], "x", ["i"], "median", 400).first()
    assert dealt.n == 6000 and dealt.estimate == pytest.approx(whole.estimate, abs=0.05)
    assert dealt.high - dealt.low == pytest.approx(whole.high - whole.low, rel=0.35)


def test_a_statistic_of_the_user(spark):
    R.register("share_above_two", lambda x, counts: counts @ (x > 2) / counts.sum(1))
    found = {r.g: r.share_above_two for r in R.grouped(spark.createDataFrame(_rows(), ROWS), ["g"], "x", "share_above_two").collect()}
    assert found == {g: pytest.approx(np.mean(np.array(x) > 2)) for g, x in _by_group().items()}
    with pytest.raises(ValueError, match="no statistic"):
        R.grouped(spark.createDataFrame([], ROWS), ["g"], "x", "mode")
    assert R.bootstrap(spark.createDataFrame([], ROWS), ["g"], "x", ["i"], "mean").count() == 0
