"""ARMA fits from a Gram matrix of lagged values, many at once.

Row t of a differenced series w is x_t = (1, w_t, w_{t-1}, ..., w_{t-M}), with
zeros before the first value. Residuals of an ARMA(p,q) are
e_t = w_t - c - sum phi_i w_{t-i} - sum theta_j e_{t-j}; written as an
autoregression cut after M lags, e_t = v . x_t with v a function of the
parameters. Their sum of squares over any stretch of rows is v' A v, where A is
the sum of x_t x_t' over that stretch. A is additive, so Spark can build it per
chunk and add it up; a fit then costs the same whatever the length of history.

* q = 0: least squares on the rows that have all p lags (conditional likelihood).
* q > 0: conditional sum of squares, started from the two-step regression of
  Hannan and Rissanen and refined by damped Gauss-Newton steps. With history no
  longer than M nothing is cut; beyond that the cut part decays like the
  M-th power of the largest moving-average root, and ``cut_matters`` says where
  that is not small. Those fits go on without a cut: on short histories in
  ``fit_whole``, row by row for a stack of fits, else in ``affine``.

All functions work on stacks: A is (B, M+2, M+2), parameters are (B, ...).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

MAX_STEPS = 60
TOLERANCE = 1e-12
# Share of a residual weight that may be cut off: its square is far below the rounding of the sum of squares.
NEGLIGIBLE = 1e-8


def burn_in(p: int, q: int) -> int:
    """First rows left out of the sum of squares."""
    return max(p, q + 1) if q else p


def lagged_rows(w: np.ndarray, memory: int) -> np.ndarray:
    """x_t for every row of ``w``, zeros standing in for values before it."""
    padded = np.concatenate([np.zeros(memory), w])
    windows = np.lib.stride_tricks.sliding_window_view(padded, memory + 1)[:, ::-1]
    return np.concatenate([np.ones((len(w), 1)), windows], axis=1)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Stacked symmetric solves; singular ones fall back to the smallest solution."""
    if a.shape[-1] == 0:
        return np.zeros(b.shape)
    scale = np.sqrt(np.maximum(np.einsum("bii->bi", a), 0.0))
    scale = np.where(scale > 0, scale, 1.0)
    corr = a / scale[:, :, None] / scale[:, None, :]
    rhs = (b / scale)[..., None]
    try:
        x = np.linalg.solve(corr, rhs)
        lost = ~np.all(np.isfinite(x), axis=(1, 2)) | (np.abs(x).max(axis=(1, 2)) > 1e10)
    except np.linalg.LinAlgError:
        x, lost = np.zeros_like(rhs), np.ones(len(a), dtype=bool)
    if lost.any():
        x[lost] = np.linalg.pinv(corr[lost], rcond=1e-12, hermitian=True) @ rhs[lost]
    return x[..., 0] / scale


def _regress(a: np.ndarray, y: int, on: list[int]) -> np.ndarray:
    on = np.asarray(on, dtype=int)
    return solve(a[:, on[:, None], on[None, :]], a[:, on, y])


def _inverse(theta: np.ndarray, length: int) -> np.ndarray:
    """First coefficients of 1 / (1 + theta_1 B + ... + theta_k B^k).

    After L coefficients the rest of the division is B^L r(B) / theta(B) with r of
    degree k - 1, so the next L coefficients are k shifted copies of the first L.
    """
    b, k = theta.shape
    out = np.zeros((b, length))
    out[:, 0] = 1.0
    if k == 0:
        return out
    have = min(max(k, 2), length)
    for j in range(1, have):
        for i in range(1, min(j, k) + 1):
            out[:, j] -= theta[:, i - 1] * out[:, j - i]
    while have < length:
        take = min(have, length - have)
        block = out[:, have:have + take]
        for i in range(min(k, take)):
            rest = -sum(theta[:, j - 1] * out[:, have + i - j] for j in range(i + 1, k + 1))
            block[:, i:] += rest[:, None] * out[:, :take - i]
        have += take
    return out


def _filter(phi: np.ndarray, series: np.ndarray) -> np.ndarray:
    """Coefficients of (1 - phi_1 B - ...) * series(B)."""
    out = series.copy()
    for i in range(1, phi.shape[1] + 1):
        out[:, i:] -= phi[:, i - 1, None] * series[:, :-i]
    return out


def _square(theta: np.ndarray) -> np.ndarray:
    """Coefficients 1..2k of (1 + theta_1 B + ...)^2."""
    b, k = theta.shape
    full = np.concatenate([np.ones((b, 1)), theta], axis=1)
    out = np.zeros((b, 2 * k + 1))
    for i in range(k + 1):
        out[:, i:i + k + 1] += full[:, i, None] * full
    return out[:, 1:]


def _weights(params: np.ndarray, p: int, q: int, constant: bool, memory: int, slopes: bool):
    """v with e_t = v . x_t, and its derivatives (B, M+2, parameters)."""
    b = len(params)
    phi, theta = params[:, :p], params[:, p:p + q]
    psi = _inverse(theta, memory + 1)
    v = np.zeros((b, memory + 2))
    v[:, 1:] = _filter(phi, psi)
    if constant:
        v[:, 0] = -params[:, -1]
    if not slopes:
        return v, None
    chi = _filter(phi, _inverse(_square(theta), memory + 1))
    dv = np.zeros((b, memory + 2, params.shape[1]))
    for i in range(1, p + 1):
        dv[:, 1 + i:, i - 1] = -psi[:, :memory + 1 - i]
    for i in range(1, q + 1):
        dv[:, 1 + i:, p + i - 1] = -chi[:, :memory + 1 - i]
    if constant:
        dv[:, 0, -1] = -1.0
    return v, dv


def _quadratic(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        s = (v[:, None, :] @ (a @ v[:, :, None]))[:, 0, 0]
    return np.where(np.isfinite(s), s, np.inf)


def _start(a: np.ndarray, n_obs: np.ndarray, p: int, q: int, constant: bool, memory: int) -> np.ndarray:
    """Hannan-Rissanen start values; the length of the first autoregression follows the history."""
    n = np.maximum(n_obs, 2)
    long = np.minimum(np.maximum(10 * np.log10(n), p + q + 1), np.maximum(n // 3, 1))
    long = np.minimum(long, max(memory - q, 1)).astype(int)
    out = np.empty((len(a), p + q + constant))
    for size in np.unique(long):
        at = long == size
        out[at] = _two_step(a[at], int(size), p, q, constant, memory)
    return out


def _two_step(a: np.ndarray, long: int, p: int, q: int, constant: bool, memory: int) -> np.ndarray:
    """Residuals of a long autoregression become regressors of a second regression."""
    ones = [0] if constant else []
    coefficients = _regress(a, 1, ones + list(range(2, 2 + long)))
    resid = np.zeros((len(a), memory + 2))
    resid[:, 1] = 1.0
    resid[:, 2:2 + long] = -coefficients[:, len(ones):]
    if constant:
        resid[:, 0] = -coefficients[:, 0]
    basis = np.zeros((len(a), memory + 2, 1 + p + q + len(ones)))
    basis[:, 1, 0] = 1.0
    for i in range(1, p + 1):
        basis[:, 1 + i, i] = 1.0
    for j in range(1, q + 1):
        basis[:, 1 + j:, p + j] = resid[:, 1:memory + 2 - j]
        basis[:, 0, p + j] = resid[:, 0]
    if constant:
        basis[:, 0, -1] = 1.0
    reduced = basis.transpose(0, 2, 1) @ a @ basis
    found = _regress(reduced, 0, list(range(1, reduced.shape[1])))
    if constant:  # c to the level of the cut autoregression
        at_one = 1.0 + found[:, p:p + q].sum(axis=1)
        found[:, -1] /= np.where(np.abs(at_one) > 0.05, at_one, 0.05)
    plain = np.zeros_like(found)
    plain[:, :p] = (direct := _regress(a, 1, list(range(2, 2 + p)) + ones))[:, :p]
    if constant:
        plain[:, -1] = direct[:, -1]
    best, lowest = plain, _quadratic(a, _weights(plain, p, q, constant, memory, False)[0])
    for shrink in (1.0, 0.7, 0.4):
        trial = found.copy()
        trial[:, p:p + q] *= shrink
        s = _quadratic(a, _weights(trial, p, q, constant, memory, False)[0])
        better = s < lowest
        best, lowest = np.where(better[:, None], trial, best), np.where(better, s, lowest)
    return best


def _products(a: np.ndarray, v: np.ndarray, dv: np.ndarray):
    """Sum of squares, its half gradient and the Gauss-Newton matrix from one pass over A."""
    with np.errstate(all="ignore"):
        both = np.concatenate([v[:, :, None], dv], axis=2)
        form = both.transpose(0, 2, 1) @ (a @ both)
    s = np.where(np.isfinite(form[:, 0, 0]), form[:, 0, 0], np.inf)
    return s, form[:, 0, 1:], form[:, 1:, 1:]


def descend(params: np.ndarray, evaluate: Callable, tolerance: float = TOLERANCE):
    """Damped Gauss-Newton steps from ``params``; ``evaluate(params, rows)`` gives the sum of squares, its half gradient and the
    Gauss-Newton matrix for these rows of the stack. Returns parameters, sums of squares and which rows settled: no step
    gains any more, or the fit is perfect.
    """
    params, active = params.copy(), np.arange(len(params))
    s, slope, hess = evaluate(params, active)
    damping, settled = np.full(len(params), 1e-4), np.zeros(len(params), dtype=bool)
    for _ in range(MAX_STEPS):
        settled[active] = (s[active] == 0) | (damping[active] >= 1e8)
        active = active[np.isfinite(s[active]) & ~settled[active]]
        if not active.size:
            break
        damped = hess[active]
        np.einsum("bii->bi", damped)[...] *= 1.0 + damping[active][:, None]
        trial = params[active] - solve(damped, slope[active])
        s_new, slope_new, hess_new = evaluate(trial, active)
        gain = s[active] - s_new
        better = gain > 0
        up = active[better]
        params[up], s[up] = trial[better], s_new[better]
        slope[up], hess[up] = slope_new[better], hess_new[better]
        damping[active] = np.where(better, damping[active] * 0.2, damping[active] * 8.0)
        done = better & (gain <= tolerance * s[active])
        settled[active[done]] = True
        active = active[~done]
    return params, s, settled


def fit(a: np.ndarray, n_obs: np.ndarray, p: int, q: int, constant: bool):
    """Parameters (phi, theta, level), residual weights v, residual variance and which fits settled."""
    memory = a.shape[-1] - 2
    if q == 0:
        ones = [0] if constant else []
        found = _regress(a[:, :2 + p, :2 + p], 1, list(range(2, 2 + p)) + ones)
        v = np.zeros((len(a), memory + 2))
        v[:, 1] = 1.0
        v[:, 2:2 + p] = -found[:, :p]
        if constant:
            v[:, 0] = -found[:, -1]
        return found, v, _quadratic(a, v) / n_obs, np.ones(len(a), dtype=bool)
    held = [np.arange(len(a)), a]

    def evaluate(trial: np.ndarray, rows: np.ndarray):
        if len(rows) != len(held[0]):
            held[:] = rows, a[rows]
        with np.errstate(all="ignore"):
            return _products(held[1], *_weights(trial, p, q, constant, memory, True))

    params, s, settled = descend(_start(a, n_obs, p, q, constant, memory), evaluate)
    return params, _weights(params, p, q, constant, memory, False)[0], s / n_obs, settled


def cut_matters(params: np.ndarray, history: np.ndarray, p: int, q: int, memory: int) -> np.ndarray:
    """Whether leaving out lags beyond ``memory`` can change a fit: longer history and a slowly fading moving average."""
    if q == 0:
        return np.zeros(len(params), dtype=bool)
    companion = np.zeros((len(params), q, q))
    companion[:, 0, :] = -params[:, p:p + q]
    companion[:, np.arange(1, q), np.arange(q - 1)] = 1.0
    companion[~np.isfinite(companion)] = 0.0
    largest = np.abs(np.linalg.eigvals(companion)).max(axis=1)
    with np.errstate(over="ignore"):
        return (history > memory) & (largest ** memory > NEGLIGIBLE)


def _recursion(w: np.ndarray, ends: np.ndarray, params: np.ndarray, p: int, q: int, constant: bool):
    """Sum of squares, half gradient, Gauss-Newton matrix and next value for histories ``w[:end]``, one recursion for all."""
    n, k, burn = len(params), p + q + constant, burn_in(p, q)
    phi, theta = params[:, :p], params[:, p:p + q]
    level = params[:, -1] if constant else np.zeros(n)
    s, slope, hess = np.zeros(n), np.zeros((n, k)), np.zeros((n, k, k))
    past, past_slopes = np.zeros((n, q)), np.zeros((q, n, k))
    following = np.zeros(n)
    padded = np.concatenate([np.zeros(p), w, [0.0]])
    with np.errstate(all="ignore"):
        for t in range(int(ends.max(initial=0)) + 1):
            lags = padded[t:t + p][::-1]
            known = phi @ lags + np.einsum("bj,bj->b", theta, past)
            at_end = ends == t
            following[at_end] = (level + known)[at_end]
            e = padded[t + p] - known
            de = np.zeros((n, k))
            de[:, :p], de[:, p:p + q] = -lags, -past
            if constant:
                de[:, -1] = 0.0
            for j in range(q):
                de -= theta[:, j, None] * past_slopes[j]
            if t >= burn:
                r, dr = np.where(t < ends, e - level, 0.0), np.where((t < ends)[:, None], de, 0.0)
                if constant:
                    dr[:, -1] = np.where(t < ends, -1.0, 0.0)
                s += r * r
                slope += r[:, None] * dr
                hess += dr[:, :, None] * dr[:, None, :]
            past = np.concatenate([e[:, None], past[:, :-1]], axis=1)
            past_slopes = np.concatenate([de[None], past_slopes[:-1]])
        bad = ~(np.isfinite(s) & np.isfinite(slope).all(axis=1) & np.isfinite(hess).all(axis=(1, 2)))
    s[bad], slope[bad], hess[bad] = np.inf, 0.0, np.eye(k)
    return s, slope, hess, following


def fit_whole(w: np.ndarray, ends: np.ndarray, start: np.ndarray, p: int, q: int, constant: bool):
    """Fits on the histories ``w[:end]`` without any cut: parameters, next values, residual variances and which settled."""
    params, s, settled = descend(start, lambda trial, rows: _recursion(w, ends[rows], trial, p, q, constant)[:3], 1e-13)
    return params, _recursion(w, ends, params, p, q, constant)[3], s / np.maximum(ends - burn_in(p, q), 1), settled
