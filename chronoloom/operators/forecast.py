"""One-step forecasts that have a closed form, as running sums over windows.

Each forecast of row t uses the rows before t only: the mean of all of them, the
last value, the straight line through the last two, or a least-squares AR(1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import counted, in_chunk, prefix_before_chunk, single_chunk, small_side, with_halo, with_series_mean
from .split import holdout_split

# Orders (p, d, q) with a closed form.
CLOSED_FORM = ((0, 0, 0), (0, 1, 0), (0, 2, 0), (1, 0, 0))


def order_name(order: tuple[int, int, int]) -> str:
    return "f_%d_%d_%d" % order


def _running(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each column by its sum over all earlier rows of the series.

    In a chunk it is a window; what came before the chunk is a sum of the totals
    of earlier chunks.
    """
    inside = in_chunk().rowsBetween(Window.unboundedPreceding, -1)
    own = [F.when(F.col("own"), F.col(c)) for c in columns]
    out = df.withColumns({f"_in_{c}": F.coalesce(F.sum(v).over(inside), F.lit(0.0))
                          for c, v in zip(columns, own)})
    if single_chunk(df):
        return out.withColumns({c: F.col(f"_in_{c}") for c in columns}).drop(*[f"_in_{c}" for c in columns])
    totals = df.groupBy("series_id", "chunk").agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(c)
                                                    for c, v in zip(columns, own)])
    before = prefix_before_chunk(totals, columns)
    before = before.select("series_id", "chunk", *[F.col(c).alias(f"_before_{c}") for c in columns])
    out = out.join(small_side(before, df), ["series_id", "chunk"])
    out = out.withColumns({c: F.col(f"_in_{c}") + F.col(f"_before_{c}") for c in columns})
    return out.drop(*[f"{side}_{c}" for c in columns for side in ("_in", "_before")])


def closed_form_forecasts(df: DataFrame, orders=CLOSED_FORM) -> DataFrame:
    """Scored rows with one forecast column per order: ``series_id, seq, actual, f_p_d_q...``."""
    wanted = [o for o in CLOSED_FORM if tuple(o) in {tuple(x) for x in orders}]
    df, halo = counted(df), 2
    rows = holdout_split(with_halo(df.select("series_id", "seq", "n", "chunk", "value"), halo))
    before1, before2 = (F.lag("value", i).over(in_chunk()) for i in (1, 2))
    rows = rows.withColumns({"y1": before1, "y2": before2})
    count = F.col("seq") - 1
    forecasts = {(0, 1, 0): F.col("y1"), (0, 2, 0): 2 * F.col("y1") - F.col("y2")}
    sums = {}
    if (1, 0, 0) in wanted or (0, 0, 0) in wanted:
        # sums are taken around the mean of the training rows: same result, no cancellation
        rows = with_series_mean(rows, "pivot", F.when(~F.col("scored"), F.col("value")))
        pivot = F.coalesce("pivot", F.lit(0.0))
        y, x = F.col("value") - pivot, F.col("y1") - pivot
        sums["sum_y"] = y
        forecasts[0, 0, 0] = F.try_divide(F.col("sum_y"), count) + pivot
    if (1, 0, 0) in wanted:
        paired = F.when(F.col("seq") > 1, F.lit(1.0))
        sums |= {"sum_py": paired * y, "sum_x": paired * x, "sum_xx": paired * x * x, "sum_xy": paired * x * y}
        pairs = (count - 1).cast("double")
        det = pairs * F.col("sum_xx") - F.col("sum_x") * F.col("sum_x")
        slope = F.try_divide(pairs * F.col("sum_xy") - F.col("sum_x") * F.col("sum_py"), det)
        # all earlier values equal: the mean is the fit
        slope = F.when(pairs > 0, F.coalesce(slope, F.lit(0.0)))
        base = F.try_divide(F.col("sum_py") - slope * F.col("sum_x"), pairs)
        forecasts[1, 0, 0] = base + slope * x + pivot
    if sums:
        rows = _running(rows.withColumns(sums), list(sums))
    return rows.where(F.col("scored") & F.col("own")).select(
        "series_id", "seq", F.col("value").alias("actual"),
        *[forecasts[o].alias(order_name(o)) for o in wanted])
