import math

import numpy as np
import pytest

from chronoloom.operators import correlation
from chronoloom.operators.difference import difference

rng = np.random.default_rng(3)
SERIES = {
    "noise": rng.normal(size=60).round(3).tolist(),
    "walk": (100 + np.cumsum(rng.normal(size=83))).round(3).tolist(),
    "ar": None,
    "short": [1.0, 3.0, 2.0],
}
_ar = [0.0]
for e in rng.normal(size=119):
    _ar.append(0.8 * _ar[-1] + float(e))
SERIES["ar"] = [round(v, 3) for v in _ar]


def direct_acf(x):
    x = np.asarray(x) - np.mean(x)
    n, k = len(x), min(int(10 * math.log10(len(x))), len(x) - 1)
    return [float(x[j:] @ x[:n - j] / (x @ x)) for j in range(k + 1)]


def direct_pacf(x):
    x = np.asarray(x) - np.mean(x)
    n = len(x)
    k = max(min(int(10 * math.log10(n)), n // 2 - 1), 1)
    r = np.array([x[j:] @ x[:n - j] / (n - j) for j in range(k + 1)])
    out = [1.0]
    for j in range(1, k + 1):
        toeplitz = np.array([[r[abs(a - b)] for a in range(j)] for b in range(j)])
        out.append(float(np.linalg.solve(toeplitz, r[1:j + 1])[-1]))
    return out


def by_series(df):
    out = {}
    for r in df.orderBy("series_id", "lag").collect():
        out.setdefault(r["series_id"], []).append(r)
    return out


@pytest.mark.parametrize("chunk_rows", [1000, 16])
def test_acf(make, chunk_rows):
    got = by_series(correlation.acf(make(SERIES, chunk_rows=chunk_rows)))
    for name, x in SERIES.items():
        want = direct_acf(x)
        assert [r["value"] for r in got[name]] == pytest.approx(want, abs=1e-10)
        n = len(x)
        bounds = [0.0] + [1.959963984540054 * math.sqrt((1 + 2 * sum(v * v for v in want[1:k])) / n)
                          for k in range(1, len(want))]
        assert [r["bound"] for r in got[name]] == pytest.approx(bounds)
        assert got[name][0]["significant"]


@pytest.mark.parametrize("chunk_rows", [1000, 16])
def test_pacf(make, chunk_rows):
    got = by_series(correlation.pacf(make(SERIES, chunk_rows=chunk_rows)))
    for name, x in SERIES.items():
        assert [r["value"] for r in got[name]] == pytest.approx(direct_pacf(x), abs=1e-9)


def test_h_values(make, h):
    got = by_series(correlation.acf(make({"a": h})))["a"]
    assert [r["value"] for r in got[1:4]] == pytest.approx([0.687970, 0.390977, 0.123604], abs=1e-6)
    assert [r["bound"] for r in got[1:4]] == pytest.approx([0.619795, 0.864743, 0.930174], abs=1e-6)
    part = by_series(correlation.pacf(make({"a": h})))["a"]
    assert [r["value"] for r in part[1:3]] == pytest.approx([0.764411, -0.229993], abs=1e-6)


def ranges(diagnostics):
    full = {r[0]: r[1] for r in correlation.full_range(diagnostics, "v").collect()}
    run = {r[0]: r[1] for r in correlation.immediate_range(diagnostics, "v").collect()}
    return full, run


@pytest.mark.parametrize("kind", [correlation.acf, correlation.pacf])
def test_ranges(make, kind):
    diagnostics = kind(make(SERIES))
    full, run = ranges(diagnostics)
    for name, rows in by_series(diagnostics).items():
        sig = [r["lag"] for r in rows if abs(r["value"]) >= r["bound"]]
        assert full[name] == sig
        want = []
        for lag in sig[1:]:
            if lag != len(want) + 1:
                break
            want.append(lag)
        assert run[name] == want
        assert set(want) <= set(sig)


def test_immediate_run_on_arrays_matches_long_form(make):
    products = correlation.lag_products(make(SERIES))
    rows = correlation.pacf_pairs(correlation.acf_pairs(products)).select(
        "series_id", correlation.immediate_run(correlation.F.col("acf")).alias("q"),
        correlation.immediate_run(correlation.F.col("pacf")).alias("p")).collect()
    df = make(SERIES)
    _, q = ranges(correlation.acf(df))
    _, p = ranges(correlation.pacf(df))
    assert {r["series_id"]: r["q"] for r in rows} == q
    assert {r["series_id"]: r["p"] for r in rows} == p


def test_constant_and_tiny_series(make):
    df = make({"flat": [2, 2, 2, 2], "one": [1], "two": [1, 2]})
    assert {r["series_id"] for r in correlation.acf(df).collect()} == {"two"}
    assert correlation.pacf(df).count() == 0


@pytest.mark.parametrize("chunk_rows", [1000, 3])
@pytest.mark.parametrize("d", [1, 2])
def test_difference(make, h, chunk_rows, d):
    values = [None, *h[:4], None, *h[4:]]
    got = difference(make({"a": values}, chunk_rows=chunk_rows), d)
    want = [float("nan") if v is None else v for v in values]
    for _ in range(d):
        want = [0.0] + [b - a for a, b in zip(want, want[1:])]
        want = [0.0 if math.isnan(v) else v for v in want]
    assert [r[0] for r in got.orderBy("seq").select("value").collect()] == pytest.approx(want)
