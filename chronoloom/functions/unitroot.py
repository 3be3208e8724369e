"""Augmented Dickey-Fuller statistic from sums of lagged products.

``chunk_sums`` gives what each chunk of a series contributes; the contributions
add up over chunks (Spark does that), and ``adf_from_sums`` turns the total into
the statistic and p-value. Regression: first difference on a constant, the lagged
level and L lagged differences.

The products of two lagged differences depend on the pair of lags only through
their distance, up to a few rows at either end of the series. So a chunk sums
L + 1 products, not L^2, and the end rows travel along as ``head`` and ``tail``.
"""

from __future__ import annotations

import math

import numpy as np

from .segments import group_numbers, lag_sums

# Response surface of MacKinnon (1994), one series, constant only.
TAU_MAX = 2.74
TAU_MIN = -18.83
TAU_STAR = -1.61
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def adf_lags(n: int) -> int:
    """Largest lag tried for a series of length ``n`` (negative: too short)."""
    return min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2)


def mackinnon_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    x = sum(c * tau**i for i, c in enumerate(SMALL_P if tau <= TAU_STAR else LARGE_P))
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def critical_value(p: float) -> float:
    """The statistic whose p-value is ``p`` (0 < p < 1): the p-value grows with the statistic, so bisection finds it."""
    low, high = TAU_MIN, TAU_MAX
    while high - low > 1e-12:
        mid = (low + high) / 2
        low, high = (mid, high) if mackinnon_p(mid) <= p else (low, mid)
    return low


def chunk_sums(y: np.ndarray, seq: np.ndarray, own: np.ndarray, n: np.ndarray, lags: np.ndarray,
               starts: np.ndarray) -> list[np.ndarray]:
    """Per group: dd[0..L], yd[0..L], sum y, sum y^2, head[L+2], tail[L+2].

    Rows are in order; a group starts with up to L + 2 carried-over rows. ``n``
    and ``lags`` are given per row. Sums run over own rows with seq >= L + 2.
    """
    first = np.zeros(len(y), dtype=bool)
    first[starts] = True
    level = np.where(first, 0.0, np.concatenate([[0.0], y[:-1]]))
    dy = np.where(first, 0.0, y - level)
    use = own & (seq >= lags + 2)
    most = int(max(lags[starts].max(), 0))
    dd = lag_sums(np.where(use, dy, 0.0), dy, starts, most)
    yd = lag_sums(np.where(use, level, 0.0), dy, starts, most)
    level = np.where(use, level, 0.0)
    sy, syy = np.add.reduceat(level, starts), np.add.reduceat(level**2, starts)
    group = group_numbers(len(y), starts)
    ends = np.zeros((2, len(starts), most + 2))
    for side, place in enumerate((seq - 1, seq - (n - lags - 1))):
        at = own & (place >= 0) & (place <= lags + 1)
        ends[side, group[at], place[at]] = y[at]
    return [np.zeros(0) if k < 0 else np.concatenate(
        [dd[g, :k + 1], yd[g, :k + 1], [sy[g], syy[g]], ends[0, g, :k + 2], ends[1, g, :k + 2]])
        for g, k in enumerate(lags[starts])]


def _gram(sums: np.ndarray, n: int, lags: int):
    """Gram matrix in the order: constant, level, lagged differences 1..L, target."""
    k = lags + 1
    dd, yd = sums[:k], sums[k:2 * k]
    sy, syy = sums[2 * k], sums[2 * k + 1]
    head, tail = sums[2 * k + 2:2 * k + 4 + lags], sums[2 * k + 4 + lags:]
    first = np.diff(head)[::-1]  # differences at row L+2, L+1, ..., 2
    last = np.diff(tail)[::-1]   # differences at row n, n-1, ..., n-L
    diff = np.empty((k, k))
    diff[0] = diff[:, 0] = dd
    before = first[1:]           # row L+1, L, ..., 2
    for a in range(lags):
        diff[a + 1, a + 1:] = diff[a, a:-1] + before[a] * before[a:] - last[a] * last[a:lags]
        diff[a + 1:, a + 1] = diff[a + 1, a + 1:]
    total = tail[::-1][:k] - head[::-1][1:]  # sum of the difference lagged by a
    size = lags + 3
    g = np.empty((size, size))
    order = np.r_[2:lags + 2, size - 1]      # lags 1..L, then the target
    lag_of = np.r_[1:lags + 1, 0]
    g[np.ix_(order, order)] = diff[np.ix_(lag_of, lag_of)]
    g[0, 0], g[0, 1], g[1, 0], g[1, 1] = n - 1 - lags, sy, sy, syy
    g[0, order] = g[order, 0] = total[lag_of]
    g[1, order] = g[order, 1] = yd[lag_of]
    return g, head


def _best_lag(g: np.ndarray, n_obs: int, lags: int) -> int:
    """Lag with the lowest AIC; one Cholesky factor gives every nested residual sum."""
    scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
    corr = g / np.outer(scale, scale)
    try:
        z = np.linalg.cholesky(corr[:-1, :-1] + 0.0)
        part = np.linalg.solve(z, corr[:-1, -1])
        rss = (corr[-1, -1] - np.cumsum(part**2)[1:]) * g[-1, -1]
    except np.linalg.LinAlgError:
        rss = np.array([g[-1, -1] - g[-1, :m] @ np.linalg.pinv(g[:m, :m], hermitian=True) @ g[:m, -1]
                        for m in range(2, lags + 3)])
    rss = np.maximum(rss, np.finfo(float).tiny)
    aic = n_obs * (math.log(2 * math.pi) + np.log(rss / n_obs) + 1) + 2 * np.arange(2, lags + 3)
    return int(np.argmin(aic))


def adf_from_sums(sums: np.ndarray, n: int) -> tuple[float, float, int] | None:
    """(statistic, p-value, lags used); None for a constant or too short series."""
    lags = adf_lags(n)
    if lags < 0 or not np.all(np.isfinite(sums)):
        return None
    g, head = _gram(np.asarray(sums, dtype=float), n, lags)
    steps = np.diff(head)
    if g[-1, -1] <= 0 and not np.any(steps[:lags]):
        return None
    use = _best_lag(g, n - 1 - lags, lags)
    # the chosen lag is refitted on all rows it allows: add the rows the common sample left out
    keep = np.r_[0:use + 2, lags + 2]
    g = g[np.ix_(keep, keep)]
    for row in range(use + 2, lags + 2):  # 1-based row of the series
        lagged = steps[row - 2 - use:row - 2][::-1]
        x = np.r_[1.0, head[row - 2], lagged, steps[row - 2]]
        g += np.outer(x, x)
    n_obs = n - 1 - use
    xx, xy = g[:-1, :-1], g[:-1, -1]
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    inverse = np.linalg.pinv(xx / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)
    beta = inverse @ xy
    rss = g[-1, -1] - beta @ xy
    free = n_obs - len(beta)
    if free <= 0 or inverse[1, 1] <= 0:
        return None
    if rss <= 1e-14 * g[-1, -1]:  # exact fit
        stat = math.copysign(math.inf, beta[1]) if beta[1] else 0.0
    else:
        stat = beta[1] / math.sqrt(rss / free * inverse[1, 1])
    return stat, mackinnon_p(stat), use
