"""Min-max and z-score scaling with parameters kept in a table.

A scaler table has ``series_id, column, method, p1, p2``: min and max for
``normalization``, mean and sample standard deviation for ``standardization``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import attach, counted, held

NORMALIZATION = "normalization"
STANDARDIZATION = "standardization"
COMBINED = "standardization+normalization"


@dataclass(frozen=True)
class ScaleStep:
    """One entry of a preprocessing plan: a column and the method for it."""

    column: str
    method: str


def minmax_fit(train: DataFrame, column: str = "value") -> DataFrame:
    return _fitted(train, column, NORMALIZATION, F.min(column), F.max(column))


def standard_fit(train: DataFrame, column: str = "value") -> DataFrame:
    return _fitted(train, column, STANDARDIZATION, F.avg(column), F.stddev_samp(column))


def _fitted(train: DataFrame, column: str, method: str, p1: Column, p2: Column) -> DataFrame:
    return train.groupBy("series_id").agg(p1.alias("p1"), p2.alias("p2")).select(
        "series_id", F.lit(column).alias("column"), F.lit(method).alias("method"), "p1", "p2")


def scaled(value: Column, method: str, p1: Column, p2: Column) -> Column:
    """A constant column scales to 0.5 (min-max) or 0.0 (z-score)."""
    if method == NORMALIZATION:
        return F.when(p1 == p2, F.lit(0.5) + value * 0).otherwise((value - p1) / F.nullif(p2 - p1, F.lit(0.0)))
    return F.when(F.coalesce(p2, F.lit(0.0)) == 0, value * 0).otherwise(
        (value - p1) / F.nullif(p2, F.lit(0.0)))


def unscaled(value: Column, method: str, p1: Column, p2: Column) -> Column:
    """Inverse of ``scaled``; a constant column goes back to its one value."""
    if method == NORMALIZATION:
        return F.when(p1 == p2, p1 + value * 0).otherwise(value * (p2 - p1) + p1)
    return value * F.coalesce(p2, F.lit(0.0)) + p1


def _with_parameters(df: DataFrame, scaler: DataFrame, steps: Sequence[ScaleStep]) -> DataFrame:
    """Join all parameters at once: one row per series, one column pair per step."""
    picks = []
    for i, step in enumerate(steps):
        here = (F.col("column") == step.column) & (F.col("method") == step.method)
        picks += [F.max(F.when(here, F.col(p))).alias(f"_{p}_{i}") for p in ("p1", "p2")]
    return attach(counted(df), scaler.groupBy("series_id").agg(*picks), "left")


def _expand(plan: Sequence[ScaleStep]) -> list[ScaleStep]:
    steps = []
    for step in plan:
        for method in step.method.split("+"):
            if method not in (NORMALIZATION, STANDARDIZATION):
                raise ValueError(f"unknown preprocessing method: {method}")
            steps.append(ScaleStep(step.column, method))
    if len({(s.column, s.method) for s in steps}) != len(steps):
        raise ValueError("a method may appear once per column")
    return steps


def scale_fit(train: DataFrame, plan: Sequence[ScaleStep]) -> DataFrame:
    """Fit a chain of methods on the training rows.

    Steps on the same column see the output of the step before. For the combined
    method that needs no second pass: min-max of a z-score is the z-score of the
    min and of the max, so every step comes out of one aggregation.
    """
    steps = _expand(plan)
    columns = list(dict.fromkeys(s.column for s in steps))
    stats = train.groupBy("series_id").agg(*[
        f(c).alias(f"{name}_{c}") for c in columns
        for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("sd", F.stddev_samp))])
    rows = []
    for c in columns:
        low, high, mean, sd = (F.col(f"{name}_{c}") for name in ("min", "max", "mean", "sd"))
        for step in (s for s in steps if s.column == c):
            p1, p2 = (low, high) if step.method == NORMALIZATION else (mean, sd)
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(step.method).alias("method"),
                                 p1.alias("p1"), p2.alias("p2")))
            after = lambda x: scaled(x, step.method, p1, p2)
            spread = F.nullif(p2 - p1 if step.method == NORMALIZATION else p2, F.lit(0.0))
            low, high, mean, sd = after(low), after(high), after(mean), F.coalesce(sd / spread, F.lit(0.0))
    return stats.select("series_id", F.inline(F.array(*rows)))


def apply_scaler(df: DataFrame, scaler: DataFrame, plan: Sequence[ScaleStep]) -> DataFrame:
    """Scale an indexed table with stored parameters (train, test or new rows)."""
    steps = _expand(plan)
    out = _with_parameters(df, scaler, steps)
    for i, step in enumerate(steps):
        out = out.withColumn(step.column, scaled(F.col(step.column), step.method,
                                                 F.col(f"_p1_{i}"), F.col(f"_p2_{i}")))
    return held(out.select(*df.columns), df)


def invert_scaler(df: DataFrame, scaler: DataFrame, plan: Sequence[ScaleStep]) -> DataFrame:
    """Back to original units."""
    steps = _expand(plan)
    out = _with_parameters(df, scaler, steps)
    for i, step in reversed(list(enumerate(steps))):
        out = out.withColumn(step.column, unscaled(F.col(step.column), step.method,
                                                   F.col(f"_p1_{i}"), F.col(f"_p2_{i}")))
    return held(out.select(*df.columns), df)


def minmax_scale(df: DataFrame, train: DataFrame | None = None, column: str = "value") -> DataFrame:
    """Fit on ``train`` (default: the rows themselves) and scale to [0, 1]."""
    plan = [ScaleStep(column, NORMALIZATION)]
    return apply_scaler(df, scale_fit(df if train is None else train, plan), plan)


def zscore_scale(df: DataFrame, train: DataFrame | None = None, column: str = "value") -> DataFrame:
    plan = [ScaleStep(column, STANDARDIZATION)]
    return apply_scaler(df, scale_fit(df if train is None else train, plan), plan)
