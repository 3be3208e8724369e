"""Forecast errors and the choice of the best order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import absolute_percentage

ORDER = ("p", "d", "q")

# Fixed value: a candidate must score below this to be named the winner.
WORST_MAPE = 100.0


def mape(steps: DataFrame, keys=("series_id", *ORDER)) -> DataFrame:
    """Mean absolute percentage error over ``actual`` / ``forecast`` rows.

    A zero actual makes it inf or NaN. A missing forecast makes it NULL, with the
    reason in ``error`` when the rows carry one. ``error`` also says how many fits
    had not settled when their steps ran out; these forecasts count.
    """
    failed = F.col("forecast").isNull()
    reasons = [F.max("error")] if "error" in steps.columns else []
    if reasons and "settled" in steps.columns:
        loose = F.count_if(~F.col("settled"))
        reasons.append(F.when(loose > 0, F.concat(loose.cast("string"), F.lit(" fits not settled"))))
    extra = [F.coalesce(*reasons).alias("error")] if reasons else []
    error = F.avg(absolute_percentage(F.col("actual"), F.col("forecast"))) * 100
    return steps.groupBy(*keys).agg(
        F.when(F.count_if(failed) == 0, error).alias("mape"), F.count("*").alias("n_steps"), *extra)


def select_best(scored: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """One row per series: the order with the lowest error.

    ``mape, p, d, q`` is the true minimum (NULL when nothing could be scored);
    ``ref_*`` is the same answer unless its error is not below 100, then
    ``(100, (0, 0, 0))``. Equal errors go to the smaller p + q, then p, d, q.
    ``series`` supplies the ids that must appear even without a candidate.
    """
    score = F.coalesce("mape", F.lit(float("nan")))
    rank = F.struct(score, F.col("p") + F.col("q"), *[F.col(c) for c in ORDER])
    usable = F.when(F.col("mape").isNotNull() & ~F.isnan("mape"), F.struct("mape", *ORDER))
    best = scored.groupBy("series_id").agg(
        F.min_by(usable, rank).alias("best"), F.count("*").alias("n_candidates"))
    if series is not None:
        best = series.select("series_id").distinct().join(best, "series_id", "left")
    wins = F.coalesce(F.col("best.mape") < WORST_MAPE, F.lit(False))
    pick = lambda c, other: F.when(wins, F.col(f"best.{c}")).otherwise(F.lit(other)).alias(f"ref_{c}")
    return best.select(
        "series_id", *[F.col(f"best.{c}").alias(c) for c in ("mape", *ORDER)],
        pick("mape", WORST_MAPE), *[pick(c, 0) for c in ORDER],
        F.coalesce("n_candidates", F.lit(0)).cast("bigint").alias("n_candidates"))
