"""Filters, checks and summaries of series tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import fill_missing as fill_missing_column
from ..functions.columns import truncate_value as truncate_value_column


def filter_date_range(df: DataFrame, start, end, column: str = "ts") -> DataFrame:
    """Rows between two instants, both ends included."""
    return df.where(F.col(column).between(F.lit(start).cast(df.schema[column].dataType),
                                          F.lit(end).cast(df.schema[column].dataType)))


def filter_seq(df: DataFrame, k: int | Column, keep: str = "first") -> DataFrame:
    """The first ``k`` rows of each series (``keep="first"``) or the rows after them."""
    bound = k if isinstance(k, Column) else F.lit(k)
    return df.where(F.col("seq") <= bound if keep == "first" else F.col("seq") > bound)


def order_by_time(df: DataFrame) -> DataFrame:
    """Rows in time order for a sink (a range sort); inside the engine ``seq`` carries the order."""
    return df.orderBy("ts", *[c for c in ("series_id", "seq", "value") if c in df.columns])


def drop_helper(df: DataFrame) -> DataFrame:
    """Back to (series_id, ts, value)."""
    return df.select("series_id", "ts", "value")


def fill_missing(df: DataFrame) -> DataFrame:
    return df.withColumn("value", fill_missing_column(F.col("value")))


def truncate_value(df: DataFrame) -> DataFrame:
    return df.withColumn("value", truncate_value_column(F.col("value")))


def check_schema(df: DataFrame) -> None:
    """Plan-time rule: a time column and one numeric column, nothing else but the id."""
    rest = [f for f in df.schema.fields if f.name != "series_id"]
    if len(rest) != 2:
        raise ValueError(f"a series has one column of times and one of values, not {[f.name for f in rest]}")
    ts, value = rest
    if not isinstance(ts.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"column {ts.name} should hold dates or timestamps but holds {ts.dataType.simpleString()}")
    if not isinstance(value.dataType, T.NumericType):
        raise ValueError(f"column {value.name} should hold numbers but holds {value.dataType.simpleString()}")


def checked_sizes(df: DataFrame) -> dict[str, int]:
    """The counts that ``index_series`` wants, and ``missing`` values, from one pre-aggregated pass.

    A row without a time has no place in its series: that is an error.
    """
    per_series = df.groupBy("series_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("ts").isNull()).alias("lost"),
        F.count_if(F.col("value").isNull() | F.isnan("value")).alias("missing"))
    row = per_series.agg(F.max("n").alias("longest"), F.count("*").alias("series"), F.sum("n").alias("rows"),
                         F.sum("lost").alias("lost"), F.sum("missing").alias("missing")).first()
    sizes = {k: int(v or 0) for k, v in row.asDict().items()}
    if lost := sizes.pop("lost"):
        raise ValueError(f"{lost} of {sizes['rows']} rows have no time, or one that could not be read")
    return sizes


def validate_series(df: DataFrame) -> DataFrame:
    """Per series: rows, missing times, repeated times, missing or non-finite values.

    Rows are first counted per (series, time), so a long series is reduced in
    many tasks before its counts meet.
    """
    check_schema(df.select("series_id", "ts", "value"))
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == F.lit(float("inf")))
    per_time = df.groupBy("series_id", "ts").agg(
        F.count("*").alias("rows"), F.count_if(bad).alias("bad"))
    return per_time.groupBy("series_id").agg(
        F.sum("rows").alias("n"),
        F.sum(F.when(F.col("ts").isNull(), F.col("rows")).otherwise(F.lit(0))).alias("n_null_ts"),
        F.sum(F.when(F.col("ts").isNotNull(), F.col("rows") - 1).otherwise(F.lit(0))).alias("n_dup_ts"),
        F.sum("bad").alias("n_bad_value"),
    )


def series_count(df: DataFrame) -> DataFrame:
    return df.groupBy("series_id").agg(F.count("*").alias("n"))


def dataset_info(df: DataFrame) -> DataFrame:
    """One summary row per series."""
    return df.groupBy("series_id").agg(
        F.count("*").alias("n"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.avg("value").alias("mean_value"),
    )


def dataset_sample(df: DataFrame, rows: int = 10) -> DataFrame:
    """The earliest rows, for a look at the data (Spark plans this as a top-k, not a full sort)."""
    return df.orderBy("ts", "series_id").limit(rows)
