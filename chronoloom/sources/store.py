"""Result, scaler and model tables of the stages, as Parquet under one root."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = ("tune", "train", "retrain")


@dataclass(frozen=True)
class Layout:
    """``<root>/{raw,split,scaler,results,models}``, one folder per session below each."""

    root: str

    def path(self, kind: str, session_id: str | None = None) -> str:
        base = f"{self.root.rstrip('/')}/{kind}"
        return base if session_id is None else f"{base}/{session_id}"


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def write_result(best: DataFrame, layout: Layout, session_id: str, stage: str, run_ts: dt.datetime | None = None,
                 filled: int = 0) -> None:
    """Append one row per series, ``best`` being the output of ``select_best``; ``n_filled`` says how many missing values
    the run put 0 for, in all its series together."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage: {stage}")
    rows = best.select(
        F.lit(session_id).alias("session_id"), "series_id", "mape", "p", "d", "q",
        "ref_mape", "ref_p", "ref_d", "ref_q", "n_candidates",
        F.lit(filled).cast("bigint").alias("n_filled"),
        F.lit(run_ts or now()).cast("timestamp_ntz").alias("run_ts"), F.lit(stage).alias("stage"))
    rows.write.mode("append").partitionBy("stage", "session_id").parquet(layout.path("results"))


def read_results(spark: SparkSession, layout: Layout) -> DataFrame:
    """All results; stage and session are folders, so that a reader of one session skips the others."""
    names = ("series_id string, mape double, p int, d int, q int, ref_mape double, ref_p int, ref_d int, ref_q int, n_candidates bigint, "
             "n_filled bigint, run_ts timestamp_ntz, stage string, session_id string")
    return spark.read.schema(names).parquet(layout.path("results"))


def newest(results: DataFrame, session_id: str, stage: str) -> DataFrame:
    """The latest result of a session and stage, per series."""
    fields = [c for c in results.columns if c not in ("session_id", "stage", "series_id")]
    rows = results.where((F.col("stage") == stage) & (F.col("session_id") == session_id))
    return rows.groupBy("series_id").agg(F.max_by(F.struct(*fields), "run_ts").alias("r")).select("series_id", "r.*")


def best_hyperparameters(results: DataFrame, session_id: str) -> DataFrame:
    """The latest tuning answer as doubles ``MAPE, P, D, Q``."""
    rows = newest(results, session_id, "tune")
    return rows.select("series_id", F.col("ref_mape").alias("MAPE"),
                       *[F.col(f"ref_{c}").cast("double").alias(c.upper()) for c in ("p", "d", "q")])


def load_trained_order(results: DataFrame, session_id: str) -> DataFrame:
    """``(series_id, p, d, q)`` of the latest training run."""
    rows = newest(results, session_id, "train")
    return rows.select("series_id", *[F.col(f"ref_{c}").alias(c) for c in ("p", "d", "q")])


def save_scaler(scaler: DataFrame, layout: Layout, session_id: str) -> None:
    scaler.write.mode("overwrite").parquet(layout.path("scaler", session_id))


def load_scaler(spark: SparkSession, layout: Layout, session_id: str) -> DataFrame:
    return spark.read.parquet(layout.path("scaler", session_id))


def save_model(models: DataFrame, layout: Layout, session_id: str, run_ts: dt.datetime | None = None) -> None:
    """Append fitted parameters, filed by training day; ``version`` grows with time."""
    at = run_ts or now()
    version = int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    models.withColumns({"trained_on": F.lit(at.date()), "version": F.lit(version).cast("bigint")}).write.mode(
        "append").partitionBy("trained_on").parquet(layout.path("models", session_id))


def load_model(spark: SparkSession, layout: Layout, session_id: str) -> DataFrame:
    """The latest model of each series."""
    models = spark.read.option("mergeSchema", True).parquet(layout.path("models", session_id))
    fields = [c for c in models.columns if c != "series_id"]
    return models.groupBy("series_id").agg(F.max_by(F.struct(*fields), "version").alias("m")).select("series_id", "m.*")
