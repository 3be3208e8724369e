"""Row numbers in time order, and the chunks that keep long series in many tasks.

An indexed series table has

* ``seq``    1-based position of the row in its series, in time order,
* ``n``      length of the series,
* ``chunk``  ``(seq - 1) div chunk_rows``.

Everything downstream groups by ``(series_id, chunk)``, never by ``series_id``
alone on raw rows, so no task sees more than one chunk (plus a few rows carried
over from the chunk before). A series shorter than one chunk has ``chunk = 0``
and the work is the plain per-series window.

The length of the longest series, the other counts and the chunk size are column
metadata, and plans follow them. They are believed only on a frame that
``index_series`` or an operator returned (``held``). Any other frame, such as a
union or a table that was read, is counted and cut into chunks anew (``counted``),
since metadata of one input speaks for no other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

# A window over one whole series is used only while the longest one, as counted
# beforehand, stays below this many rows.
SERIES_ROWS_PER_TASK = 4_000_000
CHUNK_ROWS = 65_536

# A joined table is broadcast only when counts prove it has no more rows than this (a few MB).
BROADCAST_ROWS = 100_000

ONE_SERIES = "all"

# Fixed value: stands for a missing series id, apart from every id that has characters or none.
NO_ID = "\x00"

_HELD = "_counts_hold"


def as_series(df: DataFrame, columns: Sequence[str], series: str | Column | None = None,
              tie: Sequence[str] = ()) -> DataFrame:
    """Keep exactly a time and a value column, named ``ts`` and ``value``.

    Without ``series`` all rows form one series. ``tie`` names the columns that
    order rows with equal times.
    """
    if len(columns) != 2:
        raise ValueError(f"expected exactly two columns (time, value), got {len(columns)}")
    ts, value = columns
    if series is None:
        key = F.lit(ONE_SERIES)
    else:
        key = F.coalesce((F.col(series) if isinstance(series, str) else series).cast("string"), F.lit(NO_ID))
    return df.select(key.alias("series_id"), F.col(ts).alias("ts"),
                     F.col(value).cast("double").alias("value"), *tie)


def series_sizes(df: DataFrame) -> dict[str, int]:
    """Rows of the longest series, number of series and of rows: one pre-aggregated count."""
    counts = df.groupBy("series_id").agg(F.count("*").alias("n"))
    row = counts.agg(F.max("n").alias("longest"), F.count("*").alias("series"), F.sum("n").alias("rows")).first()
    return {k: int(v or 0) for k, v in row.asDict().items()}


def index_series(df: DataFrame, tie: Sequence[str] = (), *, sizes: dict[str, int] | None = None,
                 rows_per_task: int = SERIES_ROWS_PER_TASK,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``seq``, ``n`` and ``chunk``; the ``tie`` columns are consumed.

    Short series: one hash exchange on ``series_id``. If any series is longer
    than ``rows_per_task`` the rows are range-partitioned instead, see
    ``_ranged_index``; both give the same numbers.
    """
    if df.schema["series_id"].nullable:
        df = df.withColumn("series_id", F.coalesce("series_id", F.lit(NO_ID)))
    sizes = series_sizes(df) if sizes is None else {k: sizes[k] for k in ("longest", "series", "rows")}
    # rows equal in all of these are interchangeable, so a recomputed task numbers them alike
    order = ["ts", *tie, "value"]
    if sizes["longest"] <= rows_per_task:
        whole = Window.partitionBy("series_id")
        out = df.withColumn("seq", F.row_number().over(whole.orderBy(*order)).cast("bigint"))
        out = out.withColumn("n", F.count("*").over(whole))
    else:
        out = _ranged_index(df, order, sizes)
    out = out.select("series_id", "ts", "value",
                     F.col("seq").alias("seq", metadata=sizes), "n")
    return held(rechunk(out, chunk_rows))


def held(df: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Mark the frame's counts as true, or as true as those of ``like``, of which it has the rows or some of them."""
    if like is None or getattr(like, _HELD, False):
        setattr(df, _HELD, True)
    return df


def some_rows(df: DataFrame, condition: Column) -> DataFrame:
    """A filter that keeps the counts, which then are upper bounds."""
    return held(df.where(condition), df)


def counted(df: DataFrame) -> DataFrame:
    """An indexed table whose counts hold: as it is if they are known to, else counted and cut into chunks from ``seq`` and ``n``."""
    if getattr(df, _HELD, False):
        return df
    lengths = df.groupBy("series_id").agg(F.max("n").alias("n"))
    row = lengths.agg(F.max("n").alias("longest"), F.count("*").alias("series"), F.sum("n").alias("rows")).first()
    sizes = {k: int(v or 0) for k, v in row.asDict().items()}
    return held(rechunk(df.withColumn("seq", F.col("seq").alias("seq", metadata=sizes)), CHUNK_ROWS))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ranged_index(df: DataFrame, order: list[str], sizes: dict[str, int]) -> DataFrame:
    """Row numbers without gathering a series in one task.

    Rows are range-partitioned on (series, time, tie), so a long series spreads
    over many partitions. The sorted rows are checkpointed, which fixes the
    partitions; ``monotonically_increasing_id`` then numbers them locally and a
    small (series, partition) table supplies the offset of each piece.
    """
    keys = ["series_id", *order]
    parts = min(shuffle_partitions(df), 1 + sizes["rows"] // 1_000)
    rows = checkpointed(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.withColumn("_part", F.shiftright("_row", 33))
    per_series = Window.partitionBy("series_id")
    before = per_series.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        rows.groupBy("series_id", "_part")
        .agg(F.count("*").alias("_rows"), F.min("_row").alias("_first"))
        .select("series_id", "_part", "_first",
                F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
                F.sum("_rows").over(per_series).alias("n"))
    )
    seq = F.col("_row") - F.col("_first") + F.col("_offset") + F.lit(1)
    pieces = _broadcast_if(sizes["series"] + parts <= BROADCAST_ROWS, pieces)
    return rows.join(pieces, ["series_id", "_part"]).withColumn("seq", seq)


def _broadcast_if(small: bool, df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small else df


def most_chunks(rows: DataFrame) -> int | None:
    """Upper bound for the (series, chunk) groups, from the counts made when the rows were indexed."""
    series, total = (_metadata(rows, "seq", k) for k in ("series", "rows"))
    return None if series is None or total is None else series + total // chunk_rows_of(rows)


def small_side(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Broadcast a table with one row per (series, chunk) of ``rows`` if there are few of those.

    Beyond the bound (or without counts) the join is left to Spark, which shuffles
    on keys that no chunk can make hot.
    """
    bound = most_chunks(rows)
    return _broadcast_if(bound is not None and bound <= BROADCAST_ROWS, table)


def _metadata(df: DataFrame, column: str, key: str) -> int | None:
    return df.schema[column].metadata.get(key)


def longest_of(df: DataFrame) -> int:
    """Length of the longest indexed series, from metadata or else counted."""
    known = _metadata(df, "seq", "longest")
    if known is None:
        known = int(df.agg(F.max("seq")).first()[0] or 0)
    return known


def chunk_rows_of(df: DataFrame) -> int:
    known = _metadata(df, "chunk", "rows")
    if known is None:
        raise ValueError("not an indexed series table: call index_series or rechunk first")
    return known


def rechunk(df: DataFrame, rows: int) -> DataFrame:
    """Set the chunk size."""
    chunk = F.floor((F.col("seq") - 1) / F.lit(rows)).cast("bigint")
    if (_metadata(df, "seq", "longest") or rows + 1) <= rows:
        chunk = F.lit(0).cast("bigint")
    return df.withColumn("chunk", chunk).withMetadata("chunk", {"rows": rows})


def single_chunk(df: DataFrame) -> bool:
    """True when no series is longer than one chunk, so there is no hot series."""
    return longest_of(df) <= chunk_rows_of(df)


def with_halo(df: DataFrame, rows: int | Column) -> DataFrame:
    """Copy the last ``rows`` rows of each chunk into the chunk(s) after it.

    ``own`` tells the original row from its copies. Lags of up to ``rows`` can
    then be taken inside a chunk.
    """
    if single_chunk(df):
        return df.withColumn("own", F.lit(True))
    size = chunk_rows_of(df)
    reach = rows if isinstance(rows, Column) else F.lit(rows)
    last = F.least(F.col("seq") - 1 + reach, F.col("n") - 1)
    copies = F.sequence(F.col("chunk"), F.floor(last / F.lit(size)).cast("bigint"))
    home = F.col("chunk").alias("_home")
    out = df.select(*[c for c in df.columns if c != "chunk"], home, F.explode(copies).alias("chunk"))
    out = out.withColumn("own", F.col("chunk") == F.col("_home")).drop("_home")
    return out.withMetadata("chunk", {"rows": size})


def in_chunk() -> Window:
    """Rows of one chunk in time order."""
    return Window.partitionBy("series_id", "chunk").orderBy("seq")


def in_group_order(df: DataFrame, *columns: str | Column) -> DataFrame:
    """``series_id`` (NULL except on the first row of each (series, chunk)) and ``columns``.

    The window also brings the rows of a group together, in time order, for a
    ``mapInArrow`` that follows; rows already clustered by series stay put.
    """
    first = F.row_number().over(in_chunk()) == 1
    return df.withColumn("_first", first).select(
        F.when(F.col("_first"), F.col("series_id")).alias("series_id"), *columns)


def add_arrays(parts: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Sum equal-length arrays of the same ``keys`` element by element."""
    spots = parts.select(*keys, F.posexplode_outer(column).alias("pos", "v"))
    sums = spots.groupBy(*keys, "pos").agg(F.sum("v").alias("v"))
    # the number of elements depends on lag counts, not on the number of rows
    pairs = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "v"))))
    return sums.groupBy(*keys).agg(F.transform(pairs, lambda s: s["v"]).alias(column))


def few_series(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Broadcast a table with one row per series if the counts say there are few series."""
    series = _metadata(rows, "seq", "series")
    return _broadcast_if(series is not None and series <= BROADCAST_ROWS, table)


def attach(rows: DataFrame, per_series: DataFrame, how: str = "inner") -> DataFrame:
    """Join a per-series table to the rows of an indexed table, whose counts have to hold.

    With long series the table is first spread over the chunks, so that a
    shuffled join is keyed on (series, chunk) and has no hot key.
    """
    if single_chunk(rows):
        return rows.join(small_side(per_series, rows), "series_id", how)
    chunks = rows.select("series_id", "chunk").distinct().join(per_series, "series_id", how)
    return rows.join(small_side(chunks, rows), ["series_id", "chunk"], how)


def with_series_mean(df: DataFrame, name: str = "mean", value: Column | None = None) -> DataFrame:
    """Add the mean over each series of ``value`` (NULLs left out); wants an ``own`` column."""
    value = F.when(F.col("own"), F.col("value") if value is None else value)
    if single_chunk(df):
        return df.withColumn(name, F.avg(value).over(Window.partitionBy("series_id", "chunk")))
    per_series = Window.partitionBy("series_id")
    chunks = (
        df.groupBy("series_id", "chunk")
        .agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
        .select("series_id", "chunk",
                F.try_divide(F.sum("_s").over(per_series), F.sum("_c").over(per_series)).alias(name))
    )
    return df.join(small_side(chunks, df), ["series_id", "chunk"])


def prefix_before_chunk(chunks: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Replace per-chunk sums by the sum over all earlier chunks of the series."""
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.select(*keys, "chunk",
                         *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in columns])
