"""Candidate orders, their rolling scores and the winner."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import absolute_percentage
from ..session import checkpointed
from . import arima
from .correlation import acf_pairs, full_run, immediate_run, lag_products, pacf_pairs
from .difference import difference_by
from .evaluate import ORDER, mape, select_best
from .forecast import CLOSED_FORM, closed_form_forecasts, order_name
from .index import attach, counted, held
from .stationarity import get_d


@dataclass(frozen=True)
class OrderGrid:
    """Values to try per field; ``None`` takes them from the data."""

    p: Sequence[int] | None = None
    d: Sequence[int] | None = None
    q: Sequence[int] | None = None
    include_zero: bool = False  # add 0 to the p and q found in the data
    full: bool = False  # all significant lags (0 among them), not only the first unbroken run of them

    @property
    def explicit(self) -> bool:
        return None not in (self.p, self.d, self.q)


def suggest_orders(df: DataFrame, max_d: int | None = None, full: bool = False) -> DataFrame:
    """``(series_id, d, p_values, q_values)`` from unit-root test, PACF and ACF: the first unbroken run of significant lags, or
    with ``full`` all significant lags and 0.

    ``d`` is NULL, and the ranges empty, for a series without an answer
    (constant, too short, or not stationary within ``max_d`` differences if that is given).
    """
    df = counted(df)
    d = get_d(df, max_d)
    most = int(d.agg(F.max("d")).first()[0] or 0) if max_d is None else max_d
    flat = difference_by(held(attach(df, d), df), most)
    products = pacf_pairs(acf_pairs(lag_products(flat, keep="d")))
    run = full_run if full else immediate_run
    return products.select("series_id", "d", run(F.col("pacf")).alias("p_values"), run(F.col("acf")).alias("q_values"))


def candidate_grid(series: DataFrame, grid: OrderGrid, suggestions: DataFrame | None = None) -> DataFrame:
    """``(series_id, p, d, q)`` without repeats; fields left to the data need ``suggestions``."""
    ints = lambda values: F.array(*[F.lit(int(v)) for v in dict.fromkeys(values)]).cast("array<int>")
    if grid.explicit:
        rows = series.select("series_id").distinct()
        columns = {f: ints(getattr(grid, f)) for f in ORDER}
    else:
        if suggestions is None:
            raise ValueError("fields left to the data need suggestions")
        rows = suggestions
        zero = ints([0]) if grid.include_zero else F.array().cast("array<int>")
        columns = {
            "p": F.concat(zero, F.col("p_values")) if grid.p is None else ints(grid.p),
            "d": F.array_compact(F.array("d")) if grid.d is None else ints(grid.d),
            "q": F.concat(zero, F.col("q_values")) if grid.q is None else ints(grid.q),
        }
    # one array of distinct triples per series, then one explode: no join, no shuffle
    triples = F.flatten(F.transform(columns["p"], lambda p: F.flatten(F.transform(
        columns["d"], lambda d: F.transform(columns["q"], lambda q: F.struct(
            p.alias("p"), d.alias("d"), q.alias("q")))))))
    return rows.select("series_id", F.inline(F.array_distinct(triples)))


def closed_form_scores(df: DataFrame, orders: Iterable[Sequence[int]] = CLOSED_FORM) -> DataFrame:
    """Scores of closed-form orders: every order in the same pass over the rows."""
    wanted = [o for o in CLOSED_FORM if o in {tuple(x) for x in orders}]
    steps = closed_form_forecasts(df, wanted)
    sums = []
    for o in wanted:
        f = F.col(order_name(o))
        value = F.avg(absolute_percentage(F.col("actual"), f)) * 100
        sums.append(F.when(F.count_if(f.isNull()) == 0, value).alias(order_name(o)))
    per_series = steps.groupBy("series_id").agg(F.count("*").alias("n_steps"), *sums)
    rows = [F.struct(*[F.lit(v).alias(c) for c, v in zip(ORDER, o)], F.col(order_name(o)).alias("mape"))
            for o in wanted]
    return per_series.select("series_id", F.inline(F.array(*rows)), "n_steps").select(
        "series_id", *ORDER, "mape", "n_steps", F.lit(None).cast("string").alias("error"))


def closed_form_steps(df: DataFrame, orders: Iterable[Sequence[int]] = CLOSED_FORM) -> DataFrame:
    """The same orders as one row per scored row and order."""
    wanted = [o for o in CLOSED_FORM if o in {tuple(x) for x in orders}]
    rows = [F.struct(*[F.lit(v).alias(c) for c, v in zip(ORDER, o)], F.col(order_name(o)).alias("forecast"))
            for o in wanted]
    return closed_form_forecasts(df, wanted).select(
        "series_id", "seq", "actual", F.inline(F.array(*rows))).select(
        "series_id", *ORDER, "seq", "actual", "forecast", F.lit(None).cast("string").alias("error"), F.lit(True).alias("settled"))


def _distinct_orders(candidates: DataFrame) -> list[tuple[int, int, int]]:
    """The different orders of all series together: a small set, whatever the data size."""
    return sorted((r["p"], r["d"], r["q"]) for r in candidates.select(*ORDER).distinct().collect())


def _split_orders(orders):
    closed = [o for o in orders if o in CLOSED_FORM]
    return closed, [o for o in orders if o not in CLOSED_FORM]


def _solver_steps(df: DataFrame, candidates: DataFrame, orders, **options) -> DataFrame:
    p, d, q = (max(values) for values in zip(*orders))
    solved = ~F.struct(*ORDER).isin([F.struct(*[F.lit(v).alias(c) for c, v in zip(ORDER, o)]) for o in CLOSED_FORM])
    return arima.rolling_steps(df, candidates.where(solved), max_p=p, max_d=d, max_q=q, **options)


def rolling_origin_eval(df: DataFrame, candidates: DataFrame, *, orders=None, **options) -> DataFrame:
    """One row per (series, order, scored row): ``actual, forecast, error, settled``.

    ``orders`` lists the different orders in ``candidates`` when they are known.
    """
    closed, solver = _split_orders(_distinct_orders(candidates) if orders is None else orders)
    parts = []
    if closed:
        parts.append(closed_form_steps(df, closed).join(candidates, ["series_id", *ORDER], "left_semi"))
    if solver:
        parts.append(_solver_steps(df, candidates, solver, **options))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def score_candidates(df: DataFrame, candidates: DataFrame, *, orders=None, **options) -> DataFrame:
    """``(series_id, p, d, q, mape, n_steps, error)`` for every candidate."""
    closed, solver = _split_orders(_distinct_orders(candidates) if orders is None else orders)
    parts = []
    if closed:
        parts.append(closed_form_scores(df, closed))
    if solver:
        parts.append(mape(_solver_steps(df, candidates, solver, **options)).select(
            "series_id", *ORDER, "mape", "n_steps", "error"))
    if not parts:
        return candidates.select("series_id", *ORDER, F.lit(None).cast("double").alias("mape"),
                                 F.lit(0).cast("bigint").alias("n_steps"), F.lit(None).cast("string").alias("error"))
    scores = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # candidates without any scored row (one-row series) stay, with a NULL score
    return candidates.join(scores, ["series_id", *ORDER], "left").withColumn(
        "n_steps", F.coalesce("n_steps", F.lit(0).cast("bigint")))


def order_search(df: DataFrame, grid: OrderGrid, *, max_d: int | None = None, **options) -> DataFrame:
    """Best order per series over the grid (see ``select_best`` for the columns)."""
    df = counted(df)
    suggestions = None if grid.explicit else suggest_orders(df, max_d, grid.full)
    candidates = candidate_grid(df, grid, suggestions)
    orders = None
    if suggestions is not None:
        # a few rows per series that took two passes over the data and are read again below
        candidates = checkpointed(candidates)
    else:
        orders = sorted({(p, d, q) for p in grid.p for d in grid.d for q in grid.q})
    scored = score_candidates(df, candidates, orders=orders, **options)
    return select_best(scored, df)
