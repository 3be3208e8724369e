"""Residuals of ARMA models and their derivatives on any stretch of rows, and refits from one expansion.

For given parameters the residuals e_t and their derivatives obey a linear recursion with a constant matrix: the state, the last q values
of each of them, goes through a stretch of rows as an affine map. So a stretch can be worked on before its state is known
(``sweep`` from zero gives the offset, ``transfer`` the matrix), maps compose over stretches, and inside a stretch blocks of rows are one
matrix product each.

``expand`` needs no recursion per refit: at an anchor it takes residuals with derivatives up to the third. The sums of their
products over a history make the sum of squares a polynomial in the distance from the anchor, whose minimum is the refit on that
history. Refits whose step is too long for the expansion are told so, with a nearer anchor.

Rows are [w_t, w_{t-1}, ..., w_{t-p}]. Everything is stacked over parameter rows (B, k): phi, theta and, with a constant, the level.
"""

from __future__ import annotations

import itertools
import math

import numpy as np

from .arima import burn_in, descend, solve

#: Rows of a block; numbers of a stack of sweeps that are held at once.
BLOCK, STACK_VALUES = 32, 4_000_000
#: A step is short enough when what the expansion leaves out moves no residual by more than about this share of their deviation.
REST = 2e-7
#: A longer step is cut where its second order reaches this share of its first.
CUT = 0.25
#: Pieces of a run of refits that are too far from their anchor; each gets an anchor of its own.
PIECES = 4
MAX_ROUNDS = 16


def derivatives(p: int, q: int, order: int = 3) -> list[tuple[int, ...]]:
    """Parameters of each value of a recursion: e itself, first, second and third derivatives. Residuals are linear in phi."""
    names = [(), *[(i,) for i in range(p + q)], *[(i, j) for j in range(p, p + q) for i in range(j + 1)],
             *[(i, j, k) for k in range(p, p + q) for j in range(p, k + 1) for i in range(j + 1)]]
    return [name for name in names if len(name) <= order]


class Recursion:
    """The recursion of e and its derivatives up to an order for a stack of parameters."""

    def __init__(self, params: np.ndarray, p: int, q: int, constant: bool, order: int = 3):
        self.params, self.p, self.q, self.constant = params, p, q, constant
        self.names = derivatives(p, q, order)
        at = {name: o for o, name in enumerate(self.names)}
        b, self.n_out = len(params), len(self.names)
        self.size = self.n_out * q
        theta = params[:, p:p + q]
        # value = input + weights . state, where the state has lags 1..q of each value
        self.weights = np.zeros((b, self.n_out, self.size))
        for o, name in enumerate(self.names):
            self.weights[:, o, o * q:(o + 1) * q] = -theta
            for k, i in enumerate(name):
                if i >= p:
                    self.weights[:, o, at[name[:k] + name[k + 1:]] * q + i - p] -= 1.0
        self.step = np.zeros((b, self.size, self.size))
        for o in range(self.n_out if q else 0):
            self.step[:, o * q] = self.weights[:, o]
            for lag in range(1, q):
                self.step[:, o * q + lag, o * q + lag - 1] = 1.0
        self.enter = np.zeros((b, self.n_out, 1 + p))
        self.enter[:, 0, 0] = 1.0
        for i in range(p):
            self.enter[:, 0, 1 + i] = -params[:, i]
            if order:
                self.enter[:, 1 + i, 1 + i] = -1.0
        self._blocks(max(BLOCK, q))

    def _blocks(self, rows: int) -> None:
        """What a block of rows answers to its inputs and to the state it starts from."""
        b, p, q, self.rows = len(self.params), self.p, self.q, rows
        inner = np.zeros((b, self.size, 1 + p))
        if q:
            inner[:, ::q] = self.enter
        state = np.concatenate([np.broadcast_to(np.eye(self.size), (b, self.size, self.size)), inner], axis=2)
        answers = np.empty((b, rows, self.n_out, self.size + 1 + p))
        with np.errstate(all="ignore"):
            for t in range(rows):
                answers[:, t] = self.weights @ state
                state = self.step @ state
        self.through = state[:, :, :self.size]
        self.of_state = answers[..., :self.size].reshape(b, rows * self.n_out, self.size)
        impulse = np.concatenate([self.enter[:, None], answers[:, :-1, :, self.size:]], axis=1)
        lag = np.arange(rows) - np.arange(rows)[:, None]
        shaped = np.where((lag >= 0)[None, :, :, None, None], impulse[:, np.maximum(lag, 0)], 0.0)
        self.of_input = shaped.transpose(0, 1, 4, 2, 3).reshape(b, rows * (1 + p), rows * self.n_out)

    def transfer(self, rows: int) -> np.ndarray:
        """The matrix that takes the state through this many rows."""
        with np.errstate(all="ignore"):
            return np.linalg.matrix_power(self.step, rows)

    def sweep(self, inputs: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(B, rows, values) and the state (B, size) after the last row; ``start`` defaults to zeros."""
        b, n, rows = len(self.params), len(inputs), self.rows
        start = np.zeros((b, self.size)) if start is None else start
        blocks = -(-n // rows)
        padded = np.zeros((blocks * rows, inputs.shape[1]))
        padded[:n] = inputs
        with np.errstate(all="ignore"):
            values = (padded.reshape(1, blocks, -1) @ self.of_input).reshape(b, blocks, rows, self.n_out)
            # lags 1..q of each value at the end of each block
            offsets = values[:, :, rows - self.q:][:, :, ::-1].transpose(0, 1, 3, 2).reshape(b, blocks, self.size)
            states, state = np.empty((b, blocks, self.size)), start
            for s in range(blocks):
                states[:, s] = state
                state = (self.through @ state[:, :, None])[:, :, 0] + offsets[:, s]
            values += (states @ self.of_state.transpose(0, 2, 1)).reshape(values.shape)
        values = values.reshape(b, blocks * rows, self.n_out)[:, :n]
        before = start.reshape(b, self.n_out, self.q).transpose(0, 2, 1)[:, ::-1]
        last = np.concatenate([before, values], axis=1)
        last = last[:, last.shape[1] - self.q:]
        return values, last[:, ::-1].transpose(0, 2, 1).reshape(b, self.size)

    def terms(self, values: np.ndarray) -> np.ndarray:
        """Residual, its first derivatives and its further ones: the factors of the sums of products."""
        first = 1 + self.p + self.q
        if not self.constant:
            return values
        level = np.broadcast_to(self.params[:, None, -1:], values[..., :1].shape)
        return np.concatenate([values[..., :1] - level, values[..., 1:first], np.full_like(level, -1.0), values[..., first:]], axis=-1)

    @property
    def further(self) -> list[tuple[int, ...]]:
        """Parameters of the second and third derivatives."""
        return [name for name in self.names if len(name) > 1]


def products(terms: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of products of one set of terms (rows, terms) over the rows before each of the ascending ``cuts``: (cuts, triangle)."""
    x, y = np.triu_indices(terms.shape[1])
    out = np.zeros((len(cuts), len(x)))
    inside = cuts > 0
    if inside.any():
        first = np.concatenate(([0], cuts[inside][:-1]))
        empty = first == cuts[inside]
        rows = terms[:cuts[inside][-1]]
        with np.errstate(all="ignore"):
            for k in range(len(x)):
                sums = np.add.reduceat(rows[:, x[k]] * rows[:, y[k]], np.minimum(first, len(rows) - 1))
                sums[empty] = 0.0
                out[inside, k] = np.cumsum(sums)
    return out


def _square(triangle: np.ndarray) -> np.ndarray:
    n = int((np.sqrt(8 * triangle.shape[1] + 1) - 1) / 2)
    x, y = np.triu_indices(n)
    out = np.empty((len(triangle), n, n))
    out[:, x, y] = triangle
    out[:, y, x] = triangle
    return out


def _factor(name: tuple[int, ...]) -> float:
    """What a derivative counts in a Taylor sum over sorted names."""
    return 1.0 / math.prod(math.factorial(name.count(i)) for i in set(name))


class Model:
    """Sums of squares as polynomials in the distance from an anchor, one for each history."""

    def __init__(self, triangle: np.ndarray, k: int, further: list[tuple[int, ...]]):
        with np.errstate(all="ignore"):
            self.form, self.k, self.further = _square(triangle), k, further

    def monomials(self, step: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(step)), *step.T, *[_factor(name) * step[:, name].prod(axis=1) for name in self.further]], axis=1)

    def evaluate(self, step: np.ndarray, rows: np.ndarray):
        """Sum of squares, half gradient and half second derivative."""
        form, m = self.form[rows], self.monomials(step)
        slope = np.zeros((len(step), m.shape[1], self.k))
        slope[:, 1 + np.arange(self.k), np.arange(self.k)] = 1.0
        for o, name in enumerate(self.further):
            for at, i in enumerate(name):
                slope[:, 1 + self.k + o, i] += _factor(name) * step[:, name[:at] + name[at + 1:]].prod(axis=1)
        with np.errstate(all="ignore"):
            on = (form @ m[:, :, None])[:, :, 0]
            s = np.einsum("bi,bi->b", m, on)
            gradient = np.einsum("bik,bi->bk", slope, on)
            second = slope.transpose(0, 2, 1) @ form @ slope
        return np.where(np.isfinite(s), s, np.inf), gradient, second

    def polish(self, step: np.ndarray) -> np.ndarray:
        """Newton steps on the gradient, which is exact where sums of squares no longer tell steps apart."""
        every, last = np.arange(len(step)), np.full(len(step), np.inf)
        for _ in range(4):
            _, gradient, hess = self.evaluate(step, every)
            with np.errstate(all="ignore"):
                on = (self.form @ self.monomials(step)[:, :, None])[:, :, 0]
            for o, name in enumerate(self.further):
                for a, b in itertools.permutations(range(len(name)), 2):
                    rest = tuple(i for at, i in enumerate(name) if at not in (a, b))
                    hess[:, name[a], name[b]] += on[:, 1 + self.k + o] * _factor(name) * step[:, rest].prod(axis=1)
            usable = np.isfinite(hess).all(axis=(1, 2)) & np.isfinite(gradient).all(axis=1)
            move = np.zeros_like(step)
            move[usable] = solve(hess[usable], gradient[usable])
            size = np.abs(move).max(axis=1, initial=0.0)
            closer = usable & (size < last)
            step, last = np.where(closer[:, None], step - move, step), np.where(closer, size, -1.0)
        return step

    def sizes(self, step: np.ndarray, moving: range) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Root sums of squares of the first and of the second order of the change of the residuals, of the first that comes from the
        moving-average part ``moving``, and an estimate of the fourth order.

        Orders grow by the step of that part alone (residuals are linear in the others), so the fourth is to the third what that
        part's third is to its second, or its second to its first.
        """
        m, names = self.monomials(step), [(), *[(i,) for i in range(self.k)], *self.further]

        def size(order: int, only_moving: bool) -> np.ndarray:
            at = np.array([o for o, name in enumerate(names) if len(name) == order and (not only_moving or all(i in moving for i in name))])
            with np.errstate(all="ignore"):
                total = np.einsum("bi,bij,bj->b", m[:, at], self.form[:, at[:, None], at], m[:, at])
            return np.sqrt(np.maximum(total, 0.0))

        one, two, three = (size(order, True) for order in (1, 2, 3))
        with np.errstate(all="ignore"):
            growth = np.fmax(np.where(two > 0, three / two, 0.0), np.where(one > 0, two / one, 0.0))
        return size(1, False), size(2, False), one, size(3, False) * growth


def expand(recursion: Recursion, triangle: np.ndarray, count: np.ndarray):
    """Refits on some histories, of ``count`` residuals, from the products at one anchor (a stack of one).

    Returns parameters (histories, k), sums of squares, which of them are good (the step is short enough for the expansion) and
    which found a minimum at all.
    """
    anchor = recursion.params[0]
    k = len(anchor)
    model = Model(triangle, k, recursion.further)
    step, _, settled = descend(np.zeros((len(triangle), k)), model.evaluate)
    step = np.where(settled[:, None], model.polish(step), step)
    s = model.evaluate(step, np.arange(len(step)))[0]
    first, second, moved, fourth = model.sizes(step, range(recursion.p, recursion.p + recursion.q))
    with np.errstate(all="ignore"):
        # what is left out pulls the minimum by its product with the residuals, which the past does not foretell, and with the slopes
        rest = np.where(fourth > 0, 4 * fourth / (moved * np.sqrt(count)) + 5 * fourth / np.sqrt(s), 0.0)
        good = settled & np.isfinite(s) & (rest <= REST)
        share = np.where(second > CUT * first, CUT * first / second, 1.0)
    share = np.where(np.isfinite(share), share, 0.0)
    step = np.where(good[:, None], step, step * share[:, None])
    return anchor + step, s, good, settled


def following(recursion: Recursion, values: np.ndarray, start: np.ndarray, rows: np.ndarray, at: np.ndarray, params: np.ndarray) -> np.ndarray:
    """The expected value after ``at`` rows, by the expansion to the parameters of each; ``rows`` has one row more than ``values``."""
    p, q = recursion.p, recursion.q
    before = start.reshape(recursion.n_out, q).T[::-1]
    known = np.concatenate([before, values])
    step = params - recursion.params[0]
    level = params[:, -1] if recursion.constant else np.zeros(len(params))
    out = level + np.einsum("bi,bi->b", params[:, :p], rows[at, 1:])
    for lag in range(1, q + 1):
        v = known[at + q - lag]
        e = v[:, 0] + np.einsum("bi,bi->b", v[:, 1:1 + p + q], step[:, :p + q])
        for o, name in enumerate(recursion.further):
            e = e + v[:, 1 + p + q + o] * step[:, name].prod(axis=1) * _factor(name)
        out = out + params[:, p + lag - 1] * e
    return out


def input_rows(w: np.ndarray, p: int, before: np.ndarray | None = None) -> np.ndarray:
    """[w_t, w_{t-1}, ..., w_{t-p}] for each value, and for the one after the last (whose w is 0); ``before`` holds earlier values, else zeros."""
    earlier = np.zeros(p)
    if before is not None and p:
        held = before[-p:]
        earlier[p - len(held):] = held
    padded = np.concatenate([earlier, w, [0.0]])
    return np.lib.stride_tricks.sliding_window_view(padded, p + 1)[:, ::-1]


def open_pieces(good: np.ndarray, params: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(first, end, anchor): successive refits that are not good, in up to PIECES parts, and what the expansion found at the middle of each."""
    edge = np.diff(np.concatenate(([0], (~good).astype(np.int8), [0])))
    out = []
    for first, end in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        cuts = np.unique(np.linspace(first, end, PIECES + 1).astype(int))
        out += [(int(a), int(b), params[(a + b) // 2]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [piece for piece in out if np.isfinite(piece[2]).all()]


def refit_prefixes(w: np.ndarray, ends: np.ndarray, start: np.ndarray, p: int, q: int, constant: bool):
    """Fits on the histories ``w[:end]`` (ascending ends) by uncut recursions: parameters, next values, residual variances, which settled.

    One recursion at an anchor serves every history whose fit lies near; the others get anchors of their own, from the expansion
    at the middle one of each run of them.
    """
    rows, burn = input_rows(w, p), burn_in(p, q)
    params, nxt = start.astype(float).copy(), np.full(len(ends), np.nan)
    s, done = np.full(len(ends), np.inf), np.zeros(len(ends), dtype=bool)
    runs = [(0, len(ends), start[len(ends) // 2])] if len(ends) else []
    for _ in range(MAX_ROUNDS):
        further = []
        for lo in range(0, len(runs), 64):
            for first, end, recursion, values in _swept(runs[lo:lo + 64], rows, ends, p, q, constant):
                own, at = slice(first, end), ends[first:end]
                terms = recursion.terms(values[None])[0]
                triangle = products(terms[burn:], np.maximum(at - burn, 0))
                params[own], s[own], good, _ = expand(recursion, triangle, at - burn)
                nxt[own] = following(recursion, values, np.zeros(recursion.size), rows, at, params[own])
                done[own] = good
                further += [(first + a, first + b, anchor.copy()) for a, b, anchor in open_pieces(good, params[own])]
        runs = further
        if not runs:
            break
    return params, nxt, s / np.maximum(ends - burn, 1), done


def _swept(runs, rows: np.ndarray, ends: np.ndarray, p: int, q: int, constant: bool):
    """(first, end, recursion, values up to the last history) of each run; several runs go through the rows together."""
    width = len(derivatives(p, q))
    together = max(1, STACK_VALUES // max(width * int(ends[-1]) + (1 + p) * width * max(BLOCK, q) ** 2, 1))
    for lo in range(0, len(runs), together):
        part = runs[lo:lo + together]
        stack = Recursion(np.array([r[2] for r in part]), p, q, constant)
        values, _ = stack.sweep(rows[:ends[max(r[1] for r in part) - 1]])
        for k, (first, end, anchor) in enumerate(part):
            yield first, end, Single(stack, k), values[k, :ends[end - 1]]


class Single(Recursion):
    """One of a stack."""

    def __init__(self, stack: Recursion, k: int):
        self.__dict__ |= stack.__dict__
        self.params = stack.params[k:k + 1]
