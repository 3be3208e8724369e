"""Unit-root test and the number of differences it asks for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.segments import to_batch, whole_groups
from ..functions.unitroot import adf_from_sums, adf_lags, chunk_sums
from ..session import checkpointed
from .difference import difference, with_differences
from .index import add_arrays, counted, few_series, held, in_group_order, longest_of, single_chunk, with_series_mean

# Fixed value: a series counts as stationary at or below this p-value.
STATIONARY_P = 0.05
# Numbers of differences tested in one pass over the rows.
BLOCK_D = 4
# A series this much longer than its number of differences can still be tested.
LEAST_ROWS = 4


def adf_sums(df: DataFrame, max_d: int = 0) -> DataFrame:
    """``(series_id, d, n, sums)``: the test's sums for the series differenced 0..max_d times.

    One pass in which each (series, chunk) gives a short array; arrays of the
    chunks of a series are added up element by element.
    """
    df = counted(df)
    lags = max(adf_lags(longest_of(df)), 0)
    rows = with_differences(df.select("series_id", "seq", "n", "chunk", "value"), max_d, extra_halo=lags + 2)
    rows = with_series_mean(rows).withColumn("v0", F.col("v0") - F.col("mean"))  # the constant absorbs it
    names = [f"v{d}" for d in range(max_d + 1)]
    rows = in_group_order(rows, "seq", "n", "own", *names)

    def reduce_chunks(batches):
        for part, ids, starts in whole_groups(batches):
            n = part["n"][starts]
            used = np.array([adf_lags(int(v)) for v in n])
            lags = np.repeat(used, np.diff(np.append(starts, len(part["n"]))))
            for d, name in enumerate(names):
                sums = chunk_sums(part[name].astype(float), part["seq"], part["own"], part["n"], lags, starts)
                yield to_batch(ids, sums, d=np.full(len(ids), d, dtype=np.int32), n=n)

    parts = rows.mapInArrow(reduce_chunks, "series_id string, d int, n bigint, sums array<double>")
    return parts if single_chunk(df) else add_arrays(parts, ["series_id", "d", "n"], "sums")


def adf_test(df: DataFrame, max_d: int = 0) -> DataFrame:
    """``(series_id, d, n, statistic, p_value, lags, testable)``.

    A constant or too short series has NULL results and ``testable = false``.
    """
    def solve(batches):
        for batch in batches:
            found = [adf_from_sums(np.asarray(s, dtype=float), int(n)) if len(s) else None
                     for s, n in zip(batch["sums"], batch["n"])]
            out = batch[["series_id", "d", "n"]].copy()
            out["statistic"] = [None if f is None else f[0] for f in found]
            out["p_value"] = [None if f is None else f[1] for f in found]
            out["lags"] = pd.array([None if f is None else f[2] for f in found], dtype="Int32")
            out["testable"] = [f is not None for f in found]
            yield out

    return adf_sums(df, max_d).mapInPandas(
        solve, "series_id string, d int, n bigint, statistic double, p_value double, lags int, testable boolean")


def _first_stationary(df: DataFrame, max_d: int) -> DataFrame:
    """``(series_id, d, n, open)``: fewest differences of 0..max_d that make the test reject; ``open`` when none does but more may."""
    stationary = F.col("p_value") <= F.lit(STATIONARY_P)
    tests = adf_test(df, max_d).groupBy("series_id").agg(
        F.min(F.when(stationary, F.col("d"))).alias("d"), F.max("n").alias("n"), F.max_by("testable", "d").alias("testable"))
    return tests.select("series_id", "d", "n", (F.col("d").isNull() & F.col("testable")).alias("open"))


def get_d(df: DataFrame, max_d: int | None = None) -> DataFrame:
    """``(series_id, d)``: fewest differences that make the test reject a unit root.

    With ``max_d`` one pass tries 0..max_d and gives NULL when none does. Without,
    passes of BLOCK_D differences go on for the series that are still open, each
    from where the last one stopped, until every series is settled or has turned
    constant or too short, which gives NULL.
    """
    df = counted(df)
    if max_d is not None:
        return _first_stationary(df, max_d).select("series_id", "d")
    done, rows, start = [], df, 0
    while True:
        tests = checkpointed(_first_stationary(rows, BLOCK_D - 1))
        done.append(tests.select("series_id", (F.col("d") + start).alias("d")))
        start += BLOCK_D
        left = tests.where(F.col("open") & (F.col("n") >= start + LEAST_ROWS)).select("series_id")
        if left.isEmpty():
            break
        rows = held(difference(rows, BLOCK_D).join(few_series(left, rows), "series_id", "left_semi"), rows)
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found.groupBy("series_id").agg(F.min("d").cast("int").alias("d"))
