"""A store of vectors by digest that runs only add to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STORED = "digest string, vector array<double>, bucket string"


def read_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, vector) of a store; empty if there is none yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest string, vector array<double>")
    return spark.read.schema(_STORED).parquet(folder).select("digest", "vector")


def add_vectors(folder: str, vectors: DataFrame) -> DataFrame:
    """Append (digest, vector) rows to a store and return the whole store; what it holds is not written again.

    Files lie in 256 folders by the first two hexadecimal digits of the digest. An append takes effect as a whole or
    not at all. The rows must be new to the store, so one run at a time may add to it.
    """
    bucketed = vectors.select("digest", "vector", F.substring("digest", 1, 2).alias("bucket"))
    # Rows of a bucket meet in a few tasks, so that an append adds about one file a bucket, not one a task and bucket.
    bucketed.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(folder)
    return read_vectors(vectors.sparkSession, folder)
