"""Series files: header CSV for interchange, Parquet for everything else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import parse_time
from ..operators.index import ONE_SERIES

SERIES_COLUMNS = ("series_id", "ts", "value")

# Fixed value: the layout of a raw file, matched by position.
RAW_SCHEMA = "Date date, Price double, _bad string"

# Fixed value: times are written with all their digits.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

BAD = "_bad"


def write_raw_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV with a header; an existing target is an error unless ``overwrite``."""
    (df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True)
     .option("timestampFormat", TIME_FORMAT).option("timestampNTZFormat", TIME_FORMAT).csv(path))


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw CSV by position: ``series_id, ts DATE, value, bad``.

    Text that does not parse becomes NULL and the row is marked ``bad``.
    """
    df = (spark.read.schema(RAW_SCHEMA).option("header", True).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_bad").csv(path))
    return df.select(F.lit(ONE_SERIES).alias("series_id"), F.col("Date").alias("ts"),
                     F.col("Price").alias("value"), F.col("_bad").isNotNull().alias("bad"))


def read_series_dir(spark: SparkSession, path: str) -> DataFrame:
    """All CSV part files of a folder: ``series_id, ts TIMESTAMP, value, bad``.

    Files have the time first and the value last; a ``series_id`` column (or a
    ``series_id=...`` folder) names the series. No CSV file is an error, and so is a
    file whose header differs from that of the others. Text that does not parse
    becomes NULL and the row is marked ``bad``, like one with too few or too many fields.
    """
    reader = spark.read.option("header", True).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", False)
    names = reader.csv(path).columns
    if not names:
        raise FileNotFoundError(f"no CSV file under {path}")
    rest = [c for c in names if c != "series_id"]
    if len(rest) != 2:
        raise ValueError(f"expected a time and a value column, got {rest}")
    schema = ", ".join(f"`{c}` string" for c in [*names, BAD])
    df = (reader.schema(schema).option("enforceSchema", False).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", BAD).csv(path))
    key = F.col("series_id") if "series_id" in names else F.lit(ONE_SERIES)
    ts, value = parse_time(F.col(rest[0])), F.col(rest[1]).try_cast("double")
    unread = [F.col(text).isNotNull() & read.isNull() for text, read in zip(rest, (ts, value))]
    return df.select(key.alias("series_id"), ts.alias("ts"), value.alias("value"),
                     (F.col(BAD).isNotNull() | unread[0] | unread[1]).alias("bad"))


def write_series(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = True, extra: Sequence[str] = ()) -> None:
    """A series table in the engine's own columns, and ``extra`` ones."""
    rows = df.select(*SERIES_COLUMNS, *extra)
    if fmt == "csv":
        write_raw_csv(rows, path, overwrite)
    else:
        rows.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def read_series(spark: SparkSession, path: str, fmt: str = "parquet", extra: Sequence[str] = ()) -> DataFrame:
    rows = read_series_dir(spark, path) if fmt == "csv" else spark.read.parquet(path)
    return rows.select(*SERIES_COLUMNS, *extra)


def write_split(df: DataFrame, path: str) -> None:
    """Both parts in one job, as folders ``split=train`` and ``split=test``; rows keep their number ``seq``."""
    df.select(*SERIES_COLUMNS, "seq", "split").write.mode("overwrite").partitionBy("split").parquet(path)


def write_split_csv(df: DataFrame, path: str) -> None:
    """Two CSV folders, ``train`` and ``test``, with a header; the rows are made once for both."""
    rows = df.select(*SERIES_COLUMNS, "split").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for part in ("train", "test"):
            write_raw_csv(rows.where(F.col("split") == part).drop("split"), f"{path.rstrip('/')}/{part}", overwrite=True)
    finally:
        rows.unpersist()


def read_split(spark: SparkSession, path: str, part: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == part).select(*SERIES_COLUMNS)
