"""Column expressions used by the operators; all of them run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats tried, in this order, when a time column arrives as text.
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd",
    "MM/dd/yyyy",
    "yyyy/MM/dd",
)

# Fixed value: share of a series used for the first fit of the rolling evaluation.
HOLDOUT_RATIO = 0.7


def parse_time(text: Column, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """First format that fits wins; text that fits none becomes NULL."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def truncate_value(value: Column) -> Column:
    """Drop the fraction, toward zero."""
    return value.cast("double").cast("bigint")


def fill_missing(value: Column) -> Column:
    """Missing numbers (NULL or NaN) count as zero."""
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def split_percent(ratio: str | float) -> int:
    """Whole percent of a ratio given as text; ``"0.29"`` gives 28 (double arithmetic)."""
    return int(float(ratio) * 100)


def split_point(n: Column, ratio: str | float) -> Column:
    """Rows that go to the training part."""
    return (n * F.lit(split_percent(ratio) / 100)).cast("bigint")


def holdout_point(n: Column, ratio: float = HOLDOUT_RATIO) -> Column:
    """Rows before the first scored one; the ratio stays a double, so n=90 gives 62."""
    return (n * F.lit(float(ratio))).cast("bigint")


def absolute_percentage(actual: Column, forecast: Column) -> Column:
    """``|actual - forecast| / |actual|``; a zero actual gives inf, or NaN when both are zero."""
    zero = F.when(forecast.isNull(), F.lit(None).cast("double")).when(
        forecast == 0.0, F.lit(float("nan"))
    ).otherwise(F.lit(float("inf")))
    return F.when(actual == 0.0, zero).otherwise(F.abs((actual - forecast) / actual))


def int_list(text: Column) -> Column:
    """``"[1, 2,3]"`` or ``"1,2,3"`` to an array of ints; blanks are skipped."""
    parts = F.split(F.regexp_replace(text, r"[\[\]()\s]", ""), ",")
    return F.transform(F.filter(parts, lambda s: s != ""), lambda s: s.cast("int"))


def order_from_text(text: Column) -> Column:
    """Parse a stored ``"(mape, (p, d, q))"`` text into typed fields."""
    number = r"([-+0-9.eE]+|nan|inf)"
    pattern = rf"^\(\s*{number}\s*,\s*\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)\s*\)$"
    field = lambda i, kind: F.regexp_extract(text, pattern, i).try_cast(kind)
    return F.struct(
        field(1, "double").alias("mape"),
        field(2, "int").alias("p"),
        field(3, "int").alias("d"),
        field(4, "int").alias("q"),
    )


def order_to_text(mape: Column, p: Column, d: Column, q: Column) -> Column:
    """The interchange text of a result, ``"(mape, (p, d, q))"``."""
    order = F.concat_ws(", ", p.cast("string"), d.cast("string"), q.cast("string"))
    return F.concat(F.lit("("), mape.cast("string"), F.lit(", ("), order, F.lit("))"))
