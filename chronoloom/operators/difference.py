"""Differences that keep the length of the series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fill_missing
from .index import counted, held, in_chunk, with_halo


def _diff(value: Column) -> Column:
    """Value minus the one before; the first row and any gap give 0."""
    return fill_missing(value - F.lag(value, 1).over(in_chunk()))


def with_differences(df: DataFrame, d: int, extra_halo: int = 0) -> DataFrame:
    """Add ``v0`` (the value) to ``v<d>``; rows carried over stay, marked ``own = false``. The counts have to hold.

    All windows share one spec, so there is a single sort. Each difference spoils
    one carried row, hence the halo of ``d`` rows on top of ``extra_halo``.
    """
    out = with_halo(df, d + extra_halo).withColumn("v0", F.col("value"))
    for i in range(1, d + 1):
        out = out.withColumn(f"v{i}", _diff(F.col(f"v{i - 1}")))
    return out


def difference(df: DataFrame, d: int = 1) -> DataFrame:
    """``value`` differenced ``d`` times, first element 0 each time."""
    df = counted(df)
    out = with_differences(df, d).where("own")
    return held(out.withColumn("value", F.col(f"v{d}")).select(*df.columns), df)


def difference_by(df: DataFrame, max_d: int) -> DataFrame:
    """Difference each series by its own ``d`` column (at most ``max_d``)."""
    df = counted(df)
    out = with_differences(df, max_d).where("own")
    picked = F.element_at(F.array(*[F.col(f"v{i}") for i in range(max_d + 1)]), F.col("d") + 1)
    return held(out.withColumn("value", picked).select(*df.columns), df)
