"""ARIMA fits and rolling one-step forecasts over chunked series.

Two passes over (series, chunk) groups of bounded size:

1. each chunk adds up its Gram matrix of lagged values (``functions.arima``);
   SQL windows turn the per-chunk sums into the state at the start of each chunk;
2. each chunk replays its rows from that state and refits at every scored row.

A refit costs the same at row 100 and at row 10^9, and chunks do not wait for
each other. All orders that share a number of differences share the state.

The state holds MEMORY lags. Moving-average fits for which lags beyond that
matter go on from there without a cut: at once where the history lies in one chunk
(``functions.affine``), else in rounds over the chunks of the series concerned (``refit``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.affine import refit_prefixes
from ..functions.arima import burn_in, cut_matters, fit, fit_whole, lagged_rows
from ..functions.columns import HOLDOUT_RATIO, holdout_point
from ..session import checkpointed
from .index import (chunk_rows_of, counted, few_series, longest_of, most_chunks, rechunk, shuffle_partitions, single_chunk,
                    with_halo)
from .refit import ORDER_KEYS, pack, refit

# Lags in the state when an order has a moving-average part; fits that need more go on without a cut.
MEMORY = 64
# Up to this many rows a stack of uncut fits is cheaper row by row than by expansions; both give the same fits.
SHORT_ROWS = 1_000
# Rows of history that are added to a Gram matrix at a time.
BLOCK_ROWS = 16_384
# Chunks are smaller than elsewhere, because a row here costs a fit: a long series
# is cut into about FIT_CHUNKS pieces, none outside these sizes.
FIT_CHUNKS = 64
FIT_CHUNK_ROWS = (512, 8_192)
# Numbers in one stack of Gram matrices: bounds the memory of a task.
STACK_VALUES = 800_000

STEP_SCHEMA = ("series_id string, p int, d int, q int, seq bigint, actual double, forecast double, error string, "
               "settled boolean")
MODEL_SCHEMA = ("series_id string, p int, d int, q int, n bigint, const double, ar array<double>, "
                "ma array<double>, sigma2 double, next_value double, error string, settled boolean")


class _Shape:
    """Sizes shared by both passes."""

    def __init__(self, longest: int, max_p: int, max_q: int, memory: int):
        self.memory = max(max_p, min(memory, max(longest - 1, 1)) if max_q else 0, max_q, 1)
        self.width = self.memory + 2
        self.upper = np.triu_indices(self.width)
        self.head = max(burn_in(max_p, max_q), max_p)
        self.state = len(self.upper[0]) + self.head

    def gram(self, state: np.ndarray) -> np.ndarray:
        g = np.zeros((self.width, self.width))
        g[self.upper] = state[:len(self.upper[0])]
        return g + np.triu(g, 1).T

    def head_rows(self, state: np.ndarray) -> np.ndarray:
        return lagged_rows(state[len(self.upper[0]):], self.memory)


# What a pass adds to each row: how many differenced values lie before it, what the expected next difference is added to, the level
# that is measured from, and parameters if the fit has to go on from them.
OPEN_SCHEMA = "place bigint, base double, pivot double, params array<double>"


def _differenced(part: pd.DataFrame, d: int):
    """Rows of one chunk: differenced values (0 where undefined) and which rows count."""
    y, seq = part["value"].to_numpy(dtype=float), part["seq"].to_numpy()
    w = np.zeros(len(y))
    w[d:] = np.diff(y, n=d)
    if d == 0:
        w -= part["pivot"].iloc[0]
    w[seq <= d] = 0.0
    return y, seq, w, part["own"].to_numpy() & (seq > d)


def _gram_of(w: np.ndarray, use: np.ndarray, memory: int) -> np.ndarray:
    """Sum of x_t x_t' over the rows in use."""
    total = np.zeros((memory + 2, memory + 2))
    for lo in range(0, len(w), BLOCK_ROWS):
        before = max(lo - memory, 0)
        x = lagged_rows(w[before:lo + BLOCK_ROWS], memory)[lo - before:][use[lo:lo + BLOCK_ROWS]]
        total += x.T @ x
    return total


def _prepare(df: DataFrame, candidates: DataFrame, shape: _Shape, max_d: int, ratio: float, chunk_rows: int | None):
    """Rows in chunks of a size for fits, and one task row per (series, chunk)."""
    if chunk_rows is None:
        least, most = FIT_CHUNK_ROWS
        chunk_rows = min(max(longest_of(df) // FIT_CHUNKS, least), most)
    rows = rechunk(df.select("series_id", "seq", "n", "chunk", "value"), chunk_rows)
    per_series = Window.partitionBy("series_id")
    train = F.when(F.col("seq") <= holdout_point(F.col("n"), ratio), F.col("value"))
    chunks = rows.groupBy("series_id", "chunk").agg(
        F.sum(train).alias("_s"), F.count(train).alias("_c"), F.max("n").alias("n"))
    chunks = chunks.select("series_id", "chunk", "n", F.coalesce(
        F.try_divide(F.sum("_s").over(per_series), F.sum("_c").over(per_series)), F.lit(0.0)).alias("pivot"))
    orders = candidates.groupBy("series_id").agg(
        F.sort_array(F.collect_set(F.struct("d", "p", "q"))).alias("orders"))
    tasks = chunks.join(few_series(orders, df), "series_id")
    return rows, tasks


def _cogrouped(rows: DataFrame, tasks: DataFrame):
    """Rows and task row of each (series, chunk); both come from one table, hence the renaming."""
    tasks = tasks.withColumnsRenamed({"series_id": "_id", "chunk": "_chunk"})
    tasks = tasks.select(F.col("_id").alias("series_id"), F.col("_chunk").alias("chunk"),
                         *[c for c in tasks.columns if c not in ("_id", "_chunk")])
    # a set number of partitions: their size says nothing about the work, so they must not be merged for it
    groups = most_chunks(rows)
    spread = shuffle_partitions(rows) if groups is None else min(shuffle_partitions(rows), 4 * groups + 1)
    rows, tasks = (t.repartition(spread, "series_id", "chunk") for t in (rows, tasks))
    return rows.groupBy("series_id", "chunk").cogroup(tasks.groupBy("series_id", "chunk"))


def _chunk_states(rows: DataFrame, tasks: DataFrame, shape: _Shape) -> DataFrame:
    """``(series_id, chunk, d, state)``: Gram and head rows of everything before the chunk."""
    def reduce_chunk(key, part: pd.DataFrame, task: pd.DataFrame) -> pd.DataFrame:
        if task.empty or part.empty:
            return pd.DataFrame()
        part = part.sort_values("seq").assign(pivot=task["pivot"].iloc[0])
        ds, states = sorted({o["d"] for o in task["orders"].iloc[0]}), []
        for d in ds:
            _, seq, w, use = _differenced(part, d)
            head = np.zeros(shape.head)
            first = seq[use] - d - 1
            inside = first < shape.head
            head[first[inside]] = w[use][inside]
            states.append(np.concatenate([_gram_of(w, use, shape.memory)[shape.upper], head]))
        return pd.DataFrame({"series_id": key[0], "chunk": key[1], "d": np.array(ds, dtype=np.int32), "state": states})

    parts = _cogrouped(rows, tasks.select("series_id", "chunk", "pivot", "orders")).applyInPandas(
        reduce_chunk, "series_id string, chunk bigint, d int, state array<double>")
    spots = parts.select("series_id", "d", "chunk", F.posexplode("state").alias("pos", "v"))
    earlier = Window.partitionBy("series_id", "d", "pos").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    spots = spots.withColumn("v", F.coalesce(F.sum("v").over(earlier), F.lit(0.0)))
    back = spots.groupBy("series_id", "chunk", "d").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("_s"))
    back = back.select("series_id", "chunk", F.struct("d", F.transform("_s", lambda s: s["v"]).alias("state")).alias("_t"))
    return back.groupBy("series_id", "chunk").agg(F.collect_list("_t").alias("states"))


def _with_states(rows: DataFrame, tasks: DataFrame, shape: _Shape) -> DataFrame:
    if single_chunk(rows):
        return tasks.withColumn("states", F.array().cast("array<struct<d:int,state:array<double>>>"))
    return tasks.join(_chunk_states(rows, tasks, shape), ["series_id", "chunk"], "left")


def _start_state(task: pd.DataFrame, d: int, shape: _Shape) -> np.ndarray:
    states = task["states"].iloc[0]
    for s in () if states is None else states:
        if s["d"] == d:
            return np.asarray(s["state"], dtype=float).copy()
    return np.zeros(shape.state)


def _with_own_head(state: np.ndarray, seq, w, use, d: int, shape: _Shape) -> np.ndarray:
    """Head rows that lie in this very chunk."""
    first = seq[use] - d - 1
    inside = first < shape.head
    offset = len(shape.upper[0])
    state[offset + first[inside]] = w[use][inside]
    return state


def _fit_order(grams: np.ndarray, n_obs: np.ndarray, head_grams: np.ndarray, p: int, q: int, d: int):
    """Fit a stack of histories; moving-average orders need every lag, others only p."""
    burn = burn_in(p, q)
    width = grams.shape[-1] if q else 2 + p
    a = grams[:, :width, :width] - head_grams[burn][:width, :width]
    n_obs = n_obs - burn
    a[n_obs < 1] = 0.0  # nothing to fit on: the caller drops these
    return fit(a, np.maximum(n_obs, 1).astype(float), p, q, constant=d == 0)


def _passes(rows: DataFrame, tasks: DataFrame, shape: _Shape, max_p: int, max_d: int, max_q: int, chosen, work, schema: str,
            chunk_rows: int | None, redo) -> DataFrame:
    """``work`` on the chosen chunks, from their states; rows whose fit was cut go on with ``refit`` and are put right by ``redo``."""
    halo = with_halo(rows, shape.memory + max_d)
    ready = _with_states(halo, tasks, shape).where(chosen)
    first = _cogrouped(halo.where(chosen), ready).applyInPandas(work, f"{schema}, {OPEN_SCHEMA}")
    extra = [c.split()[0] for c in OPEN_SCHEMA.split(", ")]
    if single_chunk(rows) or max_q == 0:
        return first.drop(*extra)
    first = checkpointed(first)
    cut = first.where("params IS NOT NULL")
    if cut.isEmpty():
        return first.drop(*extra)
    runs = checkpointed(cut.groupBy(*ORDER_KEYS).agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.max_by("params", "place").alias("anchor")))
    pivots = tasks.select("series_id", "pivot").distinct().join(runs.select("series_id").distinct(), "series_id")
    found = refit(pack(rows, few_series(pivots, rows), max_p, max_d, chunk_rows), runs)
    found = found.withColumnsRenamed({"params": "new", "s": "new_s"}).withColumn("found", F.lit(True))
    joined = first.join(found, [*ORDER_KEYS, "place"], "left").withColumn("found", F.col("found") & F.col("params").isNotNull())
    settled = F.when(F.col("params").isNull(), F.col("settled")).otherwise(F.coalesce("found", F.lit(False)))
    columns = {"settled": settled, **{name: F.when(F.col("found"), value).otherwise(F.col(name)) for name, value in redo.items()}}
    return joined.withColumns(columns).select(*[c for c in first.columns if c not in extra])


def _head_grams(state: np.ndarray, shape: _Shape) -> np.ndarray:
    x = shape.head_rows(state)
    outer = x[:, :, None] * x[:, None, :]
    return np.concatenate([np.zeros((1, shape.width, shape.width)), np.cumsum(outer, axis=0)])


def rolling_steps(df: DataFrame, candidates: DataFrame, *, max_p: int, max_d: int, max_q: int,
                  memory: int = MEMORY, ratio: float = HOLDOUT_RATIO,
                  chunk_rows: int | None = None) -> DataFrame:
    """Refit before every scored row and forecast it: ``STEP_SCHEMA`` rows.

    ``candidates`` has ``series_id, p, d, q`` with values up to the given maxima.
    """
    df = counted(df)
    shape = _Shape(longest_of(df), max_p, max_q, memory)
    rows, tasks = _prepare(df, candidates, shape, max_d, ratio, chunk_rows)
    scored = (F.col("chunk") + 1) * chunk_rows_of(rows) > holdout_point(F.col("n"), ratio)

    whole = single_chunk(rows)

    def replay(key, part: pd.DataFrame, task: pd.DataFrame) -> pd.DataFrame:
        if task.empty or part.empty:
            return _frame([])
        part = part.sort_values("seq").assign(pivot=task["pivot"].iloc[0])
        k = int(int(task["n"].iloc[0]) * ratio)
        by_d: dict[int, list] = {}
        for o in task["orders"].iloc[0]:
            by_d.setdefault(o["d"], []).append((o["p"], o["q"]))
        out = []
        for d, orders in by_d.items():
            y, seq, w, use = _differenced(part, d)
            target = part["own"].to_numpy() & (seq > k)
            if not target.any():
                continue
            state = _with_own_head(_start_state(task, d, shape), seq, w, use, d, shape)
            run, heads = shape.gram(state), _head_grams(state, shape)
            run = run + _gram_of(w, use & ~target, shape.memory)
            spots = np.flatnonzero(target)
            first = max(int(spots[0]) - shape.memory, 0)
            x = lagged_rows(w[first:], shape.memory)
            size = max(16, min(1024, STACK_VALUES // shape.width**2))
            for lo in range(0, len(spots), size):
                at = spots[lo:lo + size]
                rows_at = x[at - first]
                xs = np.where(use[at][:, None], rows_at, 0.0)
                # history before row i: what came before the stack plus the rows above i
                grams = np.empty((len(at) + 1, shape.width, shape.width))
                grams[0] = run
                np.multiply(xs[:, :, None], xs[:, None, :], out=grams[1:])
                np.cumsum(grams, axis=0, out=grams)
                grams, run = grams[:-1], grams[-1].copy()
                history = np.maximum(seq[at] - 1 - d, 0)
                for p, q in orders:
                    out.append(_score(key, (p, d, q), grams, history, heads, rows_at, y[at], seq[at], w[d:] if whole else None, w[at]))
        return _frame(out)

    redo = {"forecast": F.col("base") + F.col("following"), "error": F.lit(None).cast("string")}
    return _passes(rows, tasks, shape, max_p, max_d, max_q, scored, replay, STEP_SCHEMA, chunk_rows, redo)


def _uncut(series: np.ndarray):
    return fit_whole if len(series) <= SHORT_ROWS else refit_prefixes


def _score(key, order, grams, history, heads, x, y, seq, series, w) -> pd.DataFrame:
    """Forecasts of one order for a stack of rows; ``series`` is the differenced history, if all of it is at hand."""
    p, d, q = order
    error, settled, cut = None, np.ones(len(y), dtype=bool), np.full(len(y), None, dtype=object)
    try:
        params, v, _, settled = _fit_order(grams, history, heads, p, q, d)
        # the residual is linear in the row, so forecast = value - residual
        forecast = y - np.einsum("bi,bi->b", v, x[:, :v.shape[1]])
        short = history <= burn_in(p, q)
        more = ~short & cut_matters(params, history, p, q, grams.shape[-1] - 2)
        if more.any() and series is not None:
            _, following, _, settled[more] = _uncut(series)(series, history[more], params[more], p, q, d == 0)
            forecast[more] = y[more] - w[more] + following
        elif more.any():
            cut[np.flatnonzero(more)] = [list(x) for x in params[more]]
        forecast = np.where(short, np.nan, forecast)
        error = "history too short for the order" if short.any() else None
    except (np.linalg.LinAlgError, ValueError, FloatingPointError) as e:
        forecast, error = np.full(len(y), np.nan), f"{type(e).__name__}: {e}"
    errors = np.where(np.isfinite(forecast), None, error or "no finite forecast")
    return pd.DataFrame({"series_id": key[0], "p": p, "d": d, "q": q, "seq": seq, "actual": y,
                         "forecast": np.where(np.isfinite(forecast), forecast, np.nan), "error": errors, "settled": settled,
                         "place": history, "base": y - w, "pivot": None, "params": cut})


def _frame(parts: list[pd.DataFrame]) -> pd.DataFrame:
    if not parts:
        return pd.DataFrame()
    out = pd.concat(parts, ignore_index=True)
    out["forecast"] = out["forecast"].astype(object).where(out["forecast"].notna(), None)
    return out


def arima_fit(df: DataFrame, orders: DataFrame, *, max_p: int, max_d: int, max_q: int,
              memory: int = MEMORY, chunk_rows: int | None = None) -> DataFrame:
    """Fit each ``(series_id, p, d, q)`` on the whole series: ``MODEL_SCHEMA`` rows.

    ``const`` is the intercept of the regression form (0 when d > 0) and
    ``next_value`` the forecast of the row after the last.
    """
    df = counted(df)
    shape = _Shape(longest_of(df), max_p, max_q, memory)
    rows, tasks = _prepare(df, orders, shape, max_d, HOLDOUT_RATIO, chunk_rows)
    final = (F.col("chunk") + 1) * chunk_rows_of(rows) >= F.col("n")

    whole = single_chunk(rows)

    def finish(key, part: pd.DataFrame, task: pd.DataFrame) -> pd.DataFrame:
        if task.empty or part.empty:
            return pd.DataFrame()
        part = part.sort_values("seq").assign(pivot=task["pivot"].iloc[0])
        return pd.DataFrame([_model(key, part, task, (o["p"], o["d"], o["q"]), shape, whole) for o in task["orders"].iloc[0]])

    ar, ma = F.expr("slice(new, 1, p)"), F.expr("slice(new, p + 1, q)")

    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    redo = {"ar": ar, "ma": ma, "next_value": F.col("base") + F.col("following"),
            "const": F.when(F.col("d") > 0, 0.0).otherwise(F.element_at("new", -1) * (1 + total(ma)) + F.col("pivot") * (1 - total(ar))),
            "sigma2": F.col("new_s") / (F.col("place") - F.greatest(F.col("p"), F.col("q") + 1))}
    return _passes(rows, tasks, shape, max_p, max_d, max_q, final, finish, MODEL_SCHEMA, chunk_rows, redo)


def _model(key, part: pd.DataFrame, task: pd.DataFrame, order, shape: _Shape, whole: bool) -> dict:
    """The fit of one order at the end of a series, whose last chunk ``part`` is (``whole``: there is no other)."""
    p, d, q = order
    y, seq, w, use = _differenced(part, d)
    n = int(task["n"].iloc[0])
    model = {"series_id": key[0], "p": p, "d": d, "q": q, "n": n, "const": None, "ar": None, "ma": None, "sigma2": None,
             "next_value": None, "error": None, "settled": True, "place": max(n - d, 0), "base": None, "pivot": None, "params": None}
    state = _with_own_head(_start_state(task, d, shape), seq, w, use, d, shape)
    gram = shape.gram(state) + _gram_of(w, use, shape.memory)
    history = np.array([max(n - d, 0)])
    try:
        found, v, sigma2, settled = _fit_order(gram[None], history, _head_grams(state, shape), p, q, d)
        nxt = lagged_rows(np.append(w[-shape.memory:], 0.0), shape.memory)[-1]
        step = -float(v[0] @ nxt[:v.shape[1]])
        if cut_matters(found, history, p, q, shape.memory)[0]:
            if whole:
                found, following, sigma2, settled = _uncut(w[d:])(w[d:], history, found, p, q, d == 0)
                step = float(following[0])
            else:
                model["params"] = found[0].tolist()
        ar, ma = found[0, :p], found[0, p:p + q]
        pivot = float(part["pivot"].iloc[0]) if d == 0 else 0.0
        level = -y[-d:] @ _binomial(d) if d else pivot
        model |= {"base": float(level), "pivot": pivot}
        model |= {"const": float(found[0, -1] * (1 + ma.sum()) + pivot * (1 - ar.sum())) if d == 0 else 0.0,
                  "ar": ar.tolist(), "ma": ma.tolist(), "sigma2": float(sigma2[0]),
                  "next_value": step + float(level), "settled": bool(settled[0])}
    except (np.linalg.LinAlgError, ValueError, FloatingPointError) as e:
        model["error"] = f"{type(e).__name__}: {e}"
    return model


def _binomial(d: int) -> np.ndarray:
    """Weights of the last d values, oldest first, in a d-th difference."""
    weights = np.array([1.0])
    for _ in range(d):
        weights = np.convolve(weights, [1.0, -1.0])
    return weights[1:][::-1]
