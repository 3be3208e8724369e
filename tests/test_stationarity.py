import math

import numpy as np
import pytest

from chronoloom.functions.unitroot import adf_lags, mackinnon_p
from chronoloom.operators import search, stationarity

rng = np.random.default_rng(11)
WALK = np.cumsum(rng.normal(size=300)).tolist()
SERIES = {
    "noise": rng.normal(size=80).tolist(),
    "walk": WALK,
    "twice": np.cumsum(WALK).tolist(),
    "shifted": (1e6 + rng.normal(size=200)).tolist(),
    "short": [1.0, 5.0, 2.0, 4.0, 3.0, 7.0, 1.0],
}


def direct_adf(y):
    """Ordinary least squares for every lag count, without sharing any sums."""
    y = np.asarray(y, dtype=float) - np.mean(y)
    n, top, dy = len(y), adf_lags(len(y)), np.diff(y)

    def regress(lags, first):
        x = np.array([[1.0, y[i], *[dy[i - j] for j in range(1, lags + 1)]] for i in range(first, n - 1)])
        t = dy[first:]
        beta, *_ = np.linalg.lstsq(x, t, rcond=None)
        return x, t, beta, float(((t - x @ beta) ** 2).sum())

    def aic(lags):
        x, t, _, rss = regress(lags, top)
        return len(t) * (math.log(2 * math.pi) + math.log(rss / len(t)) + 1) + 2 * x.shape[1]

    use = min(range(top + 1), key=aic)
    x, t, beta, rss = regress(use, use)
    error = math.sqrt(rss / (len(t) - len(beta)) * np.linalg.inv(x.T @ x)[1, 1])
    return beta[1] / error, use


@pytest.mark.parametrize("layout", [{}, {"chunk_rows": 40}, {"rows_per_task": 0, "chunk_rows": 64}])
def test_adf_equals_direct_regression(make, layout):
    got = {r["series_id"]: r for r in stationarity.adf_test(make(SERIES, **layout)).collect()}
    for name, y in SERIES.items():
        stat, lags = direct_adf(y)
        assert got[name]["lags"] == lags
        assert got[name]["statistic"] == pytest.approx(stat, rel=1e-6)
        assert got[name]["p_value"] == pytest.approx(mackinnon_p(stat), rel=1e-5)


@pytest.mark.parametrize("layout", [{}, {"chunk_rows": 40}])
def test_adf_of_differences(make, layout):
    got = {(r["series_id"], r["d"]): r for r in stationarity.adf_test(make(SERIES, **layout), 2).collect()}
    for name in ("walk", "twice"):
        y = np.array(SERIES[name])
        for d in (1, 2):
            y = np.concatenate([[0.0], np.diff(y)])
            stat, lags = direct_adf(y)
            assert got[name, d]["lags"] == lags
            assert got[name, d]["statistic"] == pytest.approx(stat, rel=1e-5)


def test_published_critical_values():
    for tau, p in [(-3.43, 0.0100), (-2.86, 0.0502), (-2.57, 0.0994)]:
        assert mackinnon_p(tau) == pytest.approx(p, abs=2e-4)
    assert mackinnon_p(3.0) == 1.0 and mackinnon_p(-20.0) == 0.0


def test_get_d(make):
    got = {r[0]: r[1] for r in stationarity.get_d(make({**SERIES, "flat": [1.0] * 30})).collect()}
    assert got["noise"] == 0 and got["walk"] == 1 and got["twice"] == 2
    assert got["flat"] is None


def test_untestable(make):
    got = {r["series_id"]: r for r in stationarity.adf_test(make({"flat": [2] * 20, "tiny": [1, 2, 4]})).collect()}
    assert not got["flat"]["testable"] and not got["tiny"]["testable"]
    assert got["flat"]["p_value"] is None


def test_suggest_orders(make):
    ar = [0.0]
    for e in np.random.default_rng(4).normal(size=399):
        ar.append(0.7 * ar[-1] + float(e))
    level = np.cumsum(ar).tolist()
    got = {r["series_id"]: r for r in search.suggest_orders(make({"ar": ar, "sum": level, "flat": [1] * 9})).collect()}
    assert got["ar"]["d"] == 0 and got["ar"]["p_values"][:1] == [1]
    assert got["sum"]["d"] == 1 and got["sum"]["p_values"][:1] == [1]
    assert got["ar"]["q_values"] == list(range(1, len(got["ar"]["q_values"]) + 1)) != []
    assert (got["flat"]["d"], got["flat"]["p_values"], got["flat"]["q_values"]) == (None, [], [])


def test_d_goes_on_until_the_series_is_stationary(make):
    noise = np.random.default_rng(11).normal(size=300)
    values = {f"d{d}": _integrated(noise, d) for d in (0, 1, 4, 6)} | {"flat": np.full(50, 3.0), "tiny": np.array([1.0, 2.0, 4.0])}
    df = make(values)
    got = {r["series_id"]: r["d"] for r in stationarity.get_d(df).collect()}
    assert [got[k] for k in ("d0", "d1", "d4")] == [0, 1, 4]
    assert got["flat"] is None and got["tiny"] is None
    first = {}
    for r in stationarity.adf_test(df, 7).orderBy("d").collect():  # the same differences in one pass
        if r["p_value"] is not None and r["p_value"] <= 0.05:
            first.setdefault(r["series_id"], r["d"])
    assert {k: v for k, v in got.items() if v is not None} == first
    bounded = {r["series_id"]: r["d"] for r in stationarity.get_d(df, 3).collect()}
    assert bounded["d4"] is None and bounded["d1"] == 1
    suggested = {r["series_id"]: r["d"] for r in search.suggest_orders(df).collect()}
    assert suggested == got


def _integrated(values, times):
    for _ in range(times):
        values = np.cumsum(values)
    return values
