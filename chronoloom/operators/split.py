"""Chronological splits of an indexed series table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import HOLDOUT_RATIO, holdout_point, split_point
from .index import held


def chrono_split(df: DataFrame, ratio: str | float = "0.8") -> DataFrame:
    """Label rows ``train`` (first part by time) or ``test``; one pass, no extra exchange."""
    train = F.col("seq") <= split_point(F.col("n"), ratio)
    return held(df.withColumn("split", F.when(train, "train").otherwise("test")), df)


def holdout_split(df: DataFrame, ratio: float = HOLDOUT_RATIO) -> DataFrame:
    """Add ``k`` (rows of history before the first scored row) and ``scored``."""
    k = holdout_point(F.col("n"), ratio)
    return held(df.withColumn("k", k).withColumn("scored", F.col("seq") > k), df)
