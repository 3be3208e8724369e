import math

import numpy as np
import pytest

from chronoloom.functions import affine
from chronoloom.functions import arima as solver
from chronoloom.operators import arima, search
from chronoloom.operators.evaluate import mape, select_best
from chronoloom.operators.forecast import closed_form_forecasts

rng = np.random.default_rng(7)


def arma(n, phi=(), theta=(), level=0.0, seed=0):
    r = np.random.default_rng(seed)
    e = r.normal(size=n + 100)
    y = np.zeros(n + 100)
    for t in range(3, n + 100):
        y[t] = e[t] + sum(f * y[t - 1 - i] for i, f in enumerate(phi)) + sum(m * e[t - 1 - i] for i, m in enumerate(theta))
    return level + y[100:]


def residuals(w, phi, theta, c):
    e = np.zeros(len(w))
    for t in range(len(w)):
        e[t] = w[t] - c - sum(f * w[t - 1 - i] for i, f in enumerate(phi) if t > i) - sum(
            m * e[t - 1 - i] for i, m in enumerate(theta) if t > i)
    return e


def direct_ar_forecast(history, p, d):
    """Least squares on lag columns, written out."""
    w = np.diff(history, n=d)
    x = np.array([[*([1.0] if d == 0 else []), *[w[t - i] for i in range(1, p + 1)]] for t in range(p, len(w))])
    beta, *_ = np.linalg.lstsq(x, w[p:], rcond=None)
    step = np.array([*([1.0] if d == 0 else []), *[w[-i] for i in range(1, p + 1)]]) @ beta
    return step + sum((-1) ** (i + 1) * math.comb(d, i) * history[-i] for i in range(1, d + 1))


def steps_of(df):
    return {(r["series_id"], r["p"], r["d"], r["q"], r["seq"]): r["forecast"] for r in df.collect()}


def grid(df, p, d, q):
    return search.candidate_grid(df, search.OrderGrid(p, d, q))


@pytest.mark.parametrize("chunk_rows", [1000, 13])
def test_ar_steps_equal_direct_least_squares(make, chunk_rows):
    y = arma(60, (0.5, 0.2), level=30)
    df = make({"a": y})
    got = steps_of(arima.rolling_steps(df, grid(df, [0, 1, 2, 3], [0, 1, 2], [0]), max_p=3, max_d=2, max_q=0,
                                       chunk_rows=chunk_rows))
    assert len(got) == 12 * 18
    for (_, p, d, _, seq), forecast in got.items():
        if p or d:
            want = direct_ar_forecast(y[:seq - 1], p, d) if p else sum(
                (-1) ** (i + 1) * math.comb(d, i) * y[seq - 1 - i] for i in range(1, d + 1))
        else:
            want = y[:seq - 1].mean()
        assert forecast == pytest.approx(want, rel=1e-7)


@pytest.mark.parametrize("p,q", [(0, 1), (1, 1), (0, 2), (2, 1)])
@pytest.mark.parametrize("constant", [False, True])
def test_moving_average_fit_is_a_minimum_of_the_sum_of_squares(p, q, constant):
    w = arma(60, (0.5, 0.1)[:p], (0.5, 0.2)[:q], seed=p * 3 + q)
    burn = solver.burn_in(p, q)
    x = solver.lagged_rows(w, 64)[burn:]
    params, v, sigma2, settled = solver.fit((x.T @ x)[None], np.array([60.0 - burn]), p, q, constant)
    level = params[0, -1] if constant else 0.0

    def total(phi, theta, level):
        e = residuals(w, phi, theta, 0.0)[burn:] - level
        return float(e @ e)

    best = total(params[0, :p], params[0, p:p + q], level)
    assert best == pytest.approx(sigma2[0] * (60 - burn), rel=1e-8)
    for i in range(params.shape[1]):
        for h in (-1e-3, 1e-3):
            moved = params[0].copy()
            moved[i] += h
            assert total(moved[:p], moved[p:p + q], moved[-1] if constant else 0.0) >= best - 1e-9


def direct_theta(w, burn):
    """Least conditional sum of squares of (0, q=1) without constant, by ever finer grids over an uncut recursion."""
    def total(theta):
        e = np.zeros((len(w), len(theta)))
        for t in range(len(w)):
            e[t] = w[t] - (theta * e[t - 1] if t else 0)
        return (e[burn:] ** 2).sum(axis=0), e[-1]

    low, high = -1.05, 1.05
    for _ in range(9):
        theta = np.linspace(low, high, 201)
        with np.errstate(all="ignore"):
            sums, last = total(theta)
        at = int(np.nanargmin(sums))
        low, high = theta[max(at - 2, 0)], theta[min(at + 2, 200)]
    return theta[at], theta[at] * last[at]


@pytest.mark.parametrize("theta", [-0.5, -0.98, -1.0])
def test_moving_average_near_one_is_not_cut(make, theta):
    w = arma(1000, (), (theta,), seed=4)
    y = np.cumsum(np.concatenate([[50.0], w]))
    df = make({"a": y})
    want, following = direct_theta(w, solver.burn_in(0, 1))
    for chunk_rows in (2000, 300):
        model = arima.arima_fit(df, grid(df, [0], [1], [1]), max_p=0, max_d=1, max_q=1, chunk_rows=chunk_rows).first()
        assert model["settled"] and model["error"] is None
        assert model["ma"][0] == pytest.approx(want, abs=1e-6)
        assert model["next_value"] == pytest.approx(y[-1] + following, abs=1e-5)


def test_chunks_agree_where_the_whole_history_is_needed(make):
    df = make({"near": np.cumsum(arma(420, (), (-0.97,), seed=6)), "far": arma(300, (0.5,), (0.3,), seed=7)})
    candidates = grid(df, [0, 1], [1], [1])
    steps = lambda rows: steps_of(arima.rolling_steps(df, candidates, max_p=1, max_d=1, max_q=1, chunk_rows=rows, ratio=0.95))
    whole, parts = steps(1000), steps(90)
    assert whole.keys() == parts.keys() and len(whole) == 2 * (21 + 15)
    for key, value in whole.items():
        assert parts[key] == pytest.approx(value, rel=1e-5, abs=1e-5)


def uncut(w, end, start, p, q, constant):
    """The fit on ``w[:end]`` by plain recursion and Gauss-Newton steps, and the value that it expects next."""
    burn, k = solver.burn_in(p, q), p + q + constant

    def sweep(b):
        e, de = np.zeros(end + 1), np.zeros((end + 1, k))
        for t in range(end + 1):
            past = [w[t - i] if t - i >= 0 else 0.0 for i in range(1, p + 1)]
            errors = [e[t - j] if t - j >= 0 else 0.0 for j in range(1, q + 1)]
            e[t] = (w[t] if t < end else 0.0) - np.dot(b[:p], past) - np.dot(b[p:p + q], errors)
            de[t, :p], de[t, p:p + q] = [-x for x in past], [-x for x in errors]
            for j in range(1, q + 1):
                if t - j >= 0:
                    de[t] -= b[p + j - 1] * de[t - j]
        level = b[-1] if constant else 0.0
        slopes = de.copy()
        if constant:
            slopes[:, -1] = -1.0
        return e[burn:end] - level, slopes[burn:end], -e[end] + level

    def evaluate(trial, rows):
        found = [sweep(b) for b in trial]
        return (np.array([r @ r for r, _, _ in found]), np.array([j.T @ r for r, j, _ in found]), np.array([j.T @ j for _, j, _ in found]))

    params, s, settled = solver.descend(np.array([start], dtype=float), evaluate, 1e-15)
    return params[0], s[0] / (end - burn), sweep(params[0])[2]


@pytest.mark.parametrize("p,q,constant,phi,theta", [(0, 1, False, (), (-0.98,)), (0, 1, False, (), (-1.0,)), (1, 1, True, (0.5,), (-0.95,)),
                                                    (1, 2, True, (0.4,), (-0.6, -0.3)), (0, 3, False, (), (0.5, 0.3, 0.15))])
def test_refits_of_prefixes_equal_direct_fits(p, q, constant, phi, theta):
    w = arma(400, phi, theta, seed=p + 3 * q)
    ends = np.arange(280, 401)
    start = np.tile([*[0.3] * p, *(np.array(theta) * 0.9), *[0.0] * constant], (len(ends), 1))
    params, following, sigma2, settled = affine.refit_prefixes(w, ends, start, p, q, constant)
    assert settled.all()
    for i in (0, 50, 120):
        want, variance, nxt = uncut(w, ends[i], start[i], p, q, constant)
        assert params[i] == pytest.approx(want, abs=3e-6) and sigma2[i] == pytest.approx(variance, rel=1e-8)
        assert following[i] == pytest.approx(nxt, abs=3e-6)


@pytest.mark.parametrize("p,q,constant", [(0, 1, False), (2, 2, True)])
def test_recursion_is_an_affine_map_of_the_state(p, q, constant):
    """Slopes equal differences; stretches compose through their offsets and transfer matrices."""
    w = arma(300, (0.5, 0.1)[:p], (0.4, 0.2)[:q])
    k, rows = p + q + constant, affine.input_rows(w, p)[:-1]
    at = np.array([0.4, 0.1][:p] + [0.3, 0.2][:q] + [0.7] * constant)

    def terms(b):
        r = affine.Recursion(b[None], p, q, constant)
        return r.terms(r.sweep(rows)[0])[0]

    recursion = affine.Recursion(at[None], p, q, constant)
    values, end = recursion.sweep(rows)
    middle, h = terms(at), 1e-4
    assert middle[:, 0] == pytest.approx(residuals(w, at[:p], at[p:p + q], 0.0) - (0.7 if constant else 0.0), abs=1e-9)
    for i in range(k):
        step = np.eye(k)[i] * h
        assert (terms(at + step) - terms(at - step))[:, 0] / (2 * h) == pytest.approx(middle[:, 1 + i], abs=1e-5)
        for o, name in enumerate(recursion.further):
            if name[-1] == i:
                below = 1 + name[0] if len(name) == 2 else 1 + k + recursion.further.index(name[:-1])
                assert (terms(at + step) - terms(at - step))[:, below] / (2 * h) == pytest.approx(middle[:, 1 + k + o], abs=2e-5)
    first, state = recursion.sweep(rows[:137])
    second, last = recursion.sweep(rows[137:], state)
    assert np.concatenate([first, second], axis=1) == pytest.approx(values, abs=1e-9)
    offset = recursion.sweep(rows[137:])[1]
    assert (recursion.transfer(163) @ state[:, :, None])[:, :, 0] + offset == pytest.approx(end, abs=1e-9)
    assert last == pytest.approx(end, abs=1e-9)


def test_no_group_is_larger_than_a_chunk(make, monkeypatch):
    """Packed chunks hold their rows and the few before them, whatever the history; the refit groups only chunk summaries."""
    df = make({"near": np.cumsum(arma(900, (), (-0.98,), seed=6))})
    seen = []
    pack = arima.pack
    monkeypatch.setattr(arima, "pack", lambda *a: seen.append(pack(*a)) or seen[-1])
    steps = arima.rolling_steps(df, grid(df, [0], [1], [1]), max_p=0, max_d=1, max_q=1, chunk_rows=90)
    assert all(r["settled"] for r in steps.collect())
    sizes = [(r["chunk"], len(r["values"])) for r in seen[0].collect()]
    assert sorted(c for c, _ in sizes) == list(range(10)) and max(n for _, n in sizes) == 91


def test_long_history_takes_the_distributed_way(make):
    """The same fits and forecasts in one chunk, in chunks and directly."""
    w = arma(1500, (0.3,), (-0.97,), seed=11)
    df = make({"a": w, "b": np.cumsum(arma(700, (), (-1.0,), seed=12)) + 40})
    candidates = grid(df, [0, 1], [0, 1], [1])
    options = dict(max_p=1, max_d=1, max_q=1)
    one = {(r["series_id"], r["p"], r["d"]): r for r in arima.arima_fit(df, candidates, **options, chunk_rows=5000).collect()}
    many = {(r["series_id"], r["p"], r["d"]): r for r in arima.arima_fit(df, candidates, **options, chunk_rows=200).collect()}
    assert one.keys() == many.keys()
    for key, r in one.items():
        for column in ("ar", "ma", "const", "sigma2", "next_value"):
            assert many[key][column] == pytest.approx(r[column], rel=1e-5, abs=1e-6), (key, column)
        assert many[key]["settled"] == r["settled"]
    steps = lambda rows: steps_of(arima.rolling_steps(df, candidates, **options, ratio=0.9, chunk_rows=rows))
    whole, parts = steps(5000), steps(200)
    assert whole.keys() == parts.keys()
    for key, value in whole.items():
        assert parts[key] == pytest.approx(value, rel=1e-5, abs=1e-5)


def test_unsettled_fits_are_named(make, monkeypatch):
    monkeypatch.setattr(solver, "MAX_STEPS", 1)
    df = make({"a": arma(60, (0.5,), (0.4,), seed=3)})
    steps = arima.rolling_steps(df, grid(df, [1], [0], [1]), max_p=1, max_d=0, max_q=1)
    scores = mape(steps).first()
    assert scores["mape"] is not None
    assert scores["error"] is None or scores["error"].endswith("fits not settled")


def test_recovers_parameters(make):
    df = make({"arma": arma(4000, (0.6,), (0.4,), level=5, seed=2), "ma": arma(4000, (), (-0.7,), seed=3)})
    got = {r["series_id"]: r for r in arima.arima_fit(df, grid(df, [1], [0], [1]), max_p=1, max_d=0, max_q=1).collect()}
    assert got["arma"]["ar"] == pytest.approx([0.6], abs=0.05)
    assert got["arma"]["ma"] == pytest.approx([0.4], abs=0.05)
    assert got["arma"]["const"] == pytest.approx(5 * 0.4, abs=0.4)
    assert got["arma"]["sigma2"] == pytest.approx(1.0, abs=0.08)


@pytest.mark.parametrize("p,d,q", [(1, 0, 1), (0, 1, 1), (2, 1, 2), (3, 0, 0)])
def test_chunks_do_not_change_the_answer(make, p, d, q):
    values = {"a": np.cumsum(arma(150, (0.4,), (0.3,), seed=9)) if d else arma(150, (0.4,), (0.3,), seed=9),
              "b": rng.normal(size=40)}
    df = make(values)
    candidates = grid(df, [p], [d], [q])
    options = dict(max_p=p, max_d=d, max_q=q, memory=40)
    whole = steps_of(arima.rolling_steps(df, candidates, **options, chunk_rows=1000))
    parts = steps_of(arima.rolling_steps(df, candidates, **options, chunk_rows=17))
    assert whole.keys() == parts.keys()
    for key, value in whole.items():
        assert parts[key] == pytest.approx(value, rel=1e-5, abs=1e-5)
    fit = lambda rows: {r["series_id"]: r for r in arima.arima_fit(df, candidates, **options, chunk_rows=rows).collect()}
    one, many = fit(1000), fit(17)
    for s in values:
        assert one[s]["next_value"] == pytest.approx(many[s]["next_value"], rel=1e-5, abs=1e-5)
        assert one[s]["ar"] == pytest.approx(many[s]["ar"], abs=1e-4)


def test_fit_next_value_is_the_step_after_the_last(make):
    y = arma(61, (0.5,), (0.3,), level=10, seed=5)
    shorter, full = make({"a": y[:60]}), make({"a": y})
    for p, d, q in [(1, 0, 1), (2, 1, 0), (0, 2, 1), (1, 0, 0)]:
        model = arima.arima_fit(shorter, grid(shorter, [p], [d], [q]), max_p=p, max_d=d, max_q=q).first()
        # the pivot of the rolling evaluation differs (other training rows), which only matters at the start
        step = steps_of(arima.rolling_steps(full, grid(full, [p], [d], [q]), max_p=p, max_d=d, max_q=q))["a", p, d, q, 61]
        assert model["next_value"] == pytest.approx(step, rel=2e-2)


def test_h_closed_forms(make, h):
    scores = {(r["p"], r["d"], r["q"]): r["mape"] for r in search.closed_form_scores(make({"a": h})).collect()}
    assert scores[0, 0, 0] == pytest.approx(68.908339, abs=1e-5)
    assert scores[0, 1, 0] == pytest.approx(21.774923, abs=1e-5)
    assert scores[0, 2, 0] == pytest.approx(2.774964, abs=1e-5)
    assert scores[1, 0, 0] == pytest.approx(3.797263, abs=1e-5)


@pytest.mark.parametrize("chunk_rows", [1000, 4])
def test_closed_forms_in_chunks(make, h, chunk_rows):
    y = arma(50, (0.6,), level=1000)
    rows = closed_form_forecasts(make({"a": y, "h": h, "flat": [3] * 8}, chunk_rows=chunk_rows)).collect()
    assert len(rows) == 15 + 3 + 3
    for r in rows:
        if r["series_id"] == "a":
            assert r["f_1_0_0"] == pytest.approx(direct_ar_forecast(y[:r["seq"] - 1], 1, 0), rel=1e-8)
            assert r["f_0_0_0"] == pytest.approx(y[:r["seq"] - 1].mean())
        if r["series_id"] == "flat":
            assert [r[f"f_{o}"] for o in ("0_0_0", "0_1_0", "0_2_0", "1_0_0")] == [3.0] * 4


def test_solver_agrees_with_closed_form(make, h):
    df = make({"a": h, "b": arma(40, (0.3,), level=9)})
    orders = [(0, 0, 0), (0, 1, 0), (0, 2, 0), (1, 0, 0)]
    a = {(r["series_id"], r["p"], r["d"], r["q"]): r["mape"] for r in search.closed_form_scores(df, orders).collect()}
    candidates = grid(df, [0, 1], [0, 1, 2], [0])
    b = {(r["series_id"], r["p"], r["d"], r["q"]): r["mape"] for r in mape(
        arima.rolling_steps(df, candidates, max_p=1, max_d=2, max_q=0)).collect()}
    for key, value in a.items():
        assert b[key] == pytest.approx(value, rel=1e-8)


def test_zero_actual_never_wins_and_never_raises(make):
    df = make({"z": [1, 2, 3, 4, 5, 6, 7, 0, 9, 1], "n": [1, 1, 1, 1, 1, 1, 1, 0, 0, 0]})
    scores = {(r["series_id"], r["p"], r["d"], r["q"]): r["mape"] for r in search.closed_form_scores(df).collect()}
    assert scores["z", 0, 1, 0] == math.inf
    assert math.isnan(scores["n", 0, 1, 0])
    best = {r["series_id"]: r for r in select_best(search.closed_form_scores(df, [(0, 1, 0)]), df).collect()}
    for r in best.values():
        assert (r["ref_mape"], r["ref_p"], r["ref_d"], r["ref_q"]) == (100.0, 0, 0, 0)
    assert best["z"]["mape"] == math.inf and best["n"]["mape"] is None


def test_select_best_rules(spark):
    rows = [("tie", 1, 0, 1, 5.0), ("tie", 0, 1, 0, 5.0), ("tie", 2, 0, 0, 5.0), ("high", 0, 0, 0, 150.0),
            ("failed", 1, 1, 1, None), ("nan", 0, 0, 0, float("nan")), ("nan", 1, 0, 0, 60.0)]
    scored = spark.createDataFrame(rows, "series_id string, p int, d int, q int, mape double")
    series = spark.createDataFrame([(s,) for s in ("tie", "high", "failed", "nan", "none")], "series_id string")
    got = {r["series_id"]: r for r in select_best(scored, series).collect()}
    pick = lambda s, pre="": tuple(got[s][f"{pre}{c}"] for c in ("mape", "p", "d", "q"))
    assert pick("tie") == pick("tie", "ref_") == (5.0, 0, 1, 0)
    assert pick("high") == (150.0, 0, 0, 0) and pick("high", "ref_") == (100.0, 0, 0, 0)
    assert pick("failed") == (None,) * 4 and got["failed"]["n_candidates"] == 1
    assert pick("nan") == (60.0, 1, 0, 0)
    assert pick("none", "ref_") == (100.0, 0, 0, 0) and got["none"]["n_candidates"] == 0


def test_short_history_is_an_error_row_not_a_failure(make):
    df = make({"a": [1.0, 2.0, 4.0, 3.0]})
    rows = arima.rolling_steps(df, grid(df, [5], [0], [0]), max_p=5, max_d=0, max_q=0).collect()
    assert rows and all(r["forecast"] is None and r["error"] for r in rows)
    scored = search.score_candidates(df, grid(df, [5, 0], [0], [0]))
    best = select_best(scored, df).first()
    assert (best["p"], best["d"], best["q"], best["n_candidates"]) == (0, 0, 0, 2)


def test_candidates(make, spark, h):
    df = make({"a": h})
    got = sorted(tuple(r) for r in grid(df, [1, 2, 1], [0, 1], [0, 0]).collect())
    assert got == [("a", 1, 0, 0), ("a", 1, 1, 0), ("a", 2, 0, 0), ("a", 2, 1, 0)]
    hints = spark.createDataFrame([("a", 1, [1, 2], [1]), ("b", 0, [], [1]), ("c", None, [1], [1])],
                                  "series_id string, d int, p_values array<int>, q_values array<int>")
    auto = search.candidate_grid(df, search.OrderGrid(), hints)
    assert sorted(tuple(r) for r in auto.collect()) == [("a", 1, 1, 1), ("a", 2, 1, 1)]
    some = search.candidate_grid(df, search.OrderGrid(d=[0], include_zero=True), hints)
    assert sorted(r[0] for r in some.collect()) == ["a"] * 6 + ["b"] * 2 + ["c"] * 4


def test_full_ranges_as_candidates(make):
    """All significant lags and 0, by themselves and through the grid."""
    df = make({"a": arma(120, (0.7,), level=40, seed=1)})
    run, every = (search.suggest_orders(df, full=full).first() for full in (False, True))
    assert every["p_values"][0] == every["q_values"][0] == 0 and run["d"] == every["d"]
    assert set(run["p_values"]) <= set(every["p_values"]) and set(run["q_values"]) <= set(every["q_values"])
    best = search.order_search(df, search.OrderGrid(q=[0], full=True)).first()
    assert best["n_candidates"] == len(every["p_values"])


def test_search_is_no_worse_than_any_candidate(make):
    df = make({"a": arma(60, (0.5,), level=40, seed=1), "b": arma(50, (), (0.5,), level=40, seed=2)})
    candidates = grid(df, [0, 1], [0, 1], [0, 1])
    scored = search.score_candidates(df, candidates)
    lowest = {}
    for r in scored.collect():
        lowest[r["series_id"]] = min(lowest.get(r["series_id"], math.inf), r["mape"])
    best = {r["series_id"]: r for r in search.order_search(df, search.OrderGrid([0, 1], [0, 1], [0, 1])).collect()}
    for s, v in lowest.items():
        assert best[s]["mape"] == pytest.approx(v) and best[s]["n_candidates"] == 8


def test_auto_search_without_candidates_gives_the_fallback(make):
    noise = np.random.default_rng(21).normal(size=100) + 50
    best = search.order_search(make({"flat": [4] * 20, "noise": noise}), search.OrderGrid()).collect()
    got = {r["series_id"]: r for r in best}
    assert (got["flat"]["ref_mape"], got["flat"]["n_candidates"]) == (100.0, 0)
