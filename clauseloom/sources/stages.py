"""Stage tables: intermediate results written once and read back by every later step."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from clauseloom.session import checkpoint_dir

# Folders made by ``stage`` in this process.
_made: list[str] = []
# Catalog tables made by ``stage_by_key``.
_tables: list[str] = []


def save_stage(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Write a stage as Parquet and return the stored table."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Store a table that several steps read in the shared checkpoint folder, and go on from the stored copy.

    This cuts the lineage: work after a lost executor restarts from files, and the regex work is done once. Readers
    still get column pruning and filter push-down, which a checkpoint of rows would not give. The folder stays until
    ``release`` or the end of this process.
    """
    return save_stage(df, new_folder(df.sparkSession, name), partition_by)


def deal(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Rows dealt by a hash of ``key`` to ``buckets`` tasks, as ``stage_by_key`` lays them out."""
    return df.repartition(buckets or _buckets(df.sparkSession), key)


def _buckets(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def stage_by_key(df: DataFrame, name: str, key: str, buckets: int | None = None, dealt: bool = False) -> DataFrame:
    """Like ``stage``, with rows laid out in buckets of ``key``: grouping and joining by it then move no row again.

    The rows move once, before they are written, so that a task writes one file and not one for each bucket; with
    ``dealt`` the caller has used ``deal`` already, below work that is to be done after it. Without ``buckets`` there are
    as many as shuffles have partitions, at least one a core, so that the shuffled side of a join meets the buckets as
    they are; a bucket is read by one task. The session's catalog holds a table over the folder, which ``release`` drops.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    table = folder.rsplit("/", 1)[1].replace("-", "_")
    rows = df if dealt else deal(df, key, buckets)
    _tables.append(table)
    writer = rows.write.format("parquet").bucketBy(buckets or _buckets(spark), key)
    writer.option("path", folder).saveAsTable(table)
    return spark.table(table)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared checkpoint folder, which ``release`` removes; it is not created yet."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_release_at_exit)
    _made.append(folder)
    return folder


def release(spark: SparkSession) -> int:
    """Remove the stages made so far; tables read from them can no longer be used. Returns how many there were."""
    removed = 0
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS `{_tables.pop()}`")
    while _made:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        removed += folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return removed


def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            release(spark)
