"""The stages of a forecasting run: ingest, preprocess, suggest, tune, train, retrain.

Each stage composes the operators and ends in a table under a ``Layout``. The
caller passes ids and settings as arguments; nothing is kept between calls.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.arima import arima_fit
from ..operators.carry import carry_forward, without_history
from ..operators.evaluate import select_best
from ..operators.index import as_series, index_series, some_rows
from ..operators.prepare import check_schema, checked_sizes, fill_missing, truncate_value
from ..operators.scale import ScaleStep, apply_scaler, scale_fit
from ..operators.search import OrderGrid, order_search, score_candidates, suggest_orders
from ..operators.split import chrono_split
from ..session import checkpointed
from ..sources import store
from ..sources.files import read_series, write_series, write_split
from ..sources.store import Layout
from ..sources.tables import TableSource, read_table, read_table_range


def ingest(spark: SparkSession, source: TableSource, table: str, columns: Sequence[str], layout: Layout,
           session_id: str, *, series: str | None = None, window: tuple | None = None, fmt: str = "parquet",
           overwrite: bool = False, tie: Sequence[str] = (), **read_options) -> DataFrame:
    """Read two columns of a table (within ``window`` if given) and store them as raw series.

    ``tie`` columns, which order rows of equal times, are kept with them (Parquet only).
    """
    if tie and fmt == "csv":
        raise ValueError("raw CSV files hold no tie columns")
    extra = [*([series] if series else []), *tie]
    if window is None:
        df = read_table(spark, source, table, columns, extra=extra, **read_options)
    else:
        df = read_table_range(spark, source, table, columns, *window, extra=extra, **read_options)
    path = layout.path("raw", session_id)
    write_series(as_series(df, columns, series, tie), path, fmt, overwrite, tie)
    return read_series(spark, path, fmt, tie)


def preprocess(raw: DataFrame, layout: Layout, session_id: str, *, ratio: str = "0.8",
               plan: Sequence[ScaleStep] = (), scale_test: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """Order, split by time, scale the training part and store both parts.

    The test part stays in original units unless ``scale_test``. Rows keep their
    number ``seq``, which orders them in later stages also where times are equal.
    """
    check_schema(raw.select("series_id", "ts", "value"))
    split = chrono_split(index_series(raw, tie, sizes=checked_sizes(raw)), ratio)
    if plan:
        train = F.col("split") == "train"
        store.save_scaler(scale_fit(split.where(train), plan), layout, session_id)
        scaler = store.load_scaler(raw.sparkSession, layout, session_id)
        scaled = apply_scaler(split, scaler, plan)
        if not scale_test:
            scaled = apply_scaler(some_rows(split, train), scaler, plan).unionByName(split.where(~train))
        split = scaled
    path = layout.path("split", session_id)
    write_split(split, path)
    return raw.sparkSession.read.parquet(path)


def prepared(df: DataFrame, truncate: bool = False, tie: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """Checked, gap-filled and indexed series, ready for diagnostics and models, and how many values were filled.

    Rows without a time are an error. Rows of a split that ``preprocess`` stored are
    ordered by the ``seq`` they have.
    """
    check_schema(df.select("series_id", "ts", "value"))
    sizes = checked_sizes(df)
    df = fill_missing(df)
    if truncate:
        df = truncate_value(df).withColumn("value", F.col("value").cast("double"))
    if not tie and "seq" in df.columns:
        tie = ["seq"]
    return index_series(df, tie, sizes=sizes), sizes["missing"]


@contextmanager
def _kept(df: DataFrame):
    """Hold a table that several steps of a stage read; lost blocks are recomputed."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def suggest(df: DataFrame, *, truncate: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """d, p-values and q-values to try, per series; values lose their fraction first."""
    return suggest_orders(prepared(df, truncate, tie)[0])


def _search(df: DataFrame, layout: Layout, session_id: str, stage: str, grid: OrderGrid, filled: int, **options):
    run_ts = store.now()
    store.write_result(order_search(df, grid, **options), layout, session_id, stage, run_ts, filled)
    return run_ts, store.newest(store.read_results(df.sparkSession, layout), session_id, stage)


def tune(df: DataFrame, layout: Layout, session_id: str, grid: OrderGrid = OrderGrid(), *,
         tie: Sequence[str] = (), **options) -> DataFrame:
    """Score the grid and store the best order per series."""
    series, filled = prepared(df, tie=tie)
    with _kept(series):
        return _search(series, layout, session_id, "tune", grid, filled, **options)[1]


def _fit_and_save(series: DataFrame, orders: DataFrame, layout: Layout, session_id: str, run_ts) -> None:
    top = orders.agg(*[F.max(c).alias(c) for c in ("p", "d", "q")]).first()
    if top["p"] is None:
        return
    models = arima_fit(series, orders, max_p=top["p"], max_d=top["d"], max_q=top["q"])
    store.save_model(models, layout, session_id, run_ts)


def train(df: DataFrame, layout: Layout, session_id: str, grid: OrderGrid = OrderGrid(), *,
          tie: Sequence[str] = (), **options) -> DataFrame:
    """``tune`` under the name ``train``, then fit the best order on the whole series."""
    series, filled = prepared(df, tie=tie)
    with _kept(series):
        run_ts, found = _search(series, layout, session_id, "train", grid, filled, **options)
        orders = store.load_trained_order(store.read_results(df.sparkSession, layout), session_id)
        _fit_and_save(series, orders, layout, session_id, run_ts)
        return found


def retrain(spark: SparkSession, source: TableSource, table: str, columns: Sequence[str], layout: Layout,
            session_id: str, start, end, *, series: str | None = None, ratio: str = "0.8",
            plan: Sequence[ScaleStep] = (), tie: Sequence[str] = (), **options) -> DataFrame:
    """Read a date window again, prepare it, and score and refit each trained order on its training part."""
    files = f"{session_id}-retrain"  # the first run's raw and split files stay as they are
    raw = ingest(spark, source, table, columns, layout, files, series=series, window=(start, end), overwrite=True,
                 tie=tie)
    split = preprocess(raw, layout, files, ratio=ratio, plan=plan, tie=tie)
    rows = split.where(F.col("split") == "train").drop("split")
    trained = store.load_trained_order(store.read_results(spark, layout), session_id)
    current, filled = prepared(rows)
    with _kept(current):
        orders = trained.join(current.select("series_id").distinct(), "series_id", "left_semi")
        run_ts = store.now()
        best = select_best(score_candidates(current, orders, **options), current)
        store.write_result(best, layout, session_id, "retrain", run_ts, filled)
        _fit_and_save(current, orders, layout, session_id, run_ts)
    return store.newest(store.read_results(spark, layout), session_id, "retrain")


def follow(series: DataFrame, layout: Layout, session_id: str, **options) -> DataFrame:
    """One-step forecasts of the rows that the stored models have not seen, without a refit; the models are stored as they are after them.

    ``series`` (series_id, seq, value) is numbered from the start of each series and may begin anywhere before the first new row. Models
    stored without a state are run over all of it first.
    """
    spark = series.sparkSession
    models = store.load_model(spark, layout, session_id).drop("trained_on", "version")
    if "residuals" not in models.columns:
        models = without_history(models)
    else:
        fresh = F.col("residuals").isNull()
        empty = F.array().cast("array<double>")
        models = models.withColumns({"n": F.when(fresh, 0).otherwise(F.col("n")).cast("bigint"), "last": F.coalesce("last", empty),
                                     "residuals": F.coalesce("residuals", empty)})
    forecasts, after = carry_forward(checkpointed(models), series, **options)
    forecasts = checkpointed(forecasts)
    store.save_model(after, layout, session_id)
    return forecasts
