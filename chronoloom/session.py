"""Session helpers: settings worth having and the reliable checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def builder(app: str = "chronoloom", **settings: str) -> SparkSession.Builder:
    """A session builder with the recommended settings applied."""
    b = SparkSession.builder.appName(app)
    for key, value in {**RECOMMENDED, **settings}.items():
        b = b.config(key, value)
    return b


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the shared checkpoint folder of the cluster.

    The folder comes from ``spark.checkpoint.dir``. Only a local-mode session
    without that setting gets a folder of its own; a cluster without it fails
    early, because a machine-local folder would be lost with the executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="chronoloom-checkpoint-")
    sc.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixed partitions that survive a lost executor."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
