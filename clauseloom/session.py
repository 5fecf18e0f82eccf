"""Session settings the engine works well with, and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast a join side only on its size as measured at run time, never on an estimate from file sizes.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    # File contents travel to extractors inside Arrow batches: bound them by size, not only by rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply ``SETTINGS`` to a session builder; master and shuffle width stay the caller's choice."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints, stages and streaming state, shared by the driver and all executors.

    The session's own setting wins. Only where it is unset, the SQL warehouse, which every session shares with its
    executors, takes the stages; no machine-local temporary folder is ever used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"
    spark.sparkContext.setCheckpointDir(folder)
    return folder
