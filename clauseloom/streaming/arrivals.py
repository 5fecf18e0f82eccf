"""Structured Streaming: new files and rows as they arrive, and live processing rates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from clauseloom.functions import text as T
from clauseloom.operators import ingest
from clauseloom.operators.metrics import windowed_rate
from clauseloom.options import IngestOptions
from clauseloom.sources.files import FILE_SCHEMA, LISTED_FORMATS, Extractor, extract_texts, file_glob

BatchWork = Callable[[DataFrame, int], None]
Reader = Callable[[SparkSession, list[str]], DataFrame]


def arriving_files(
    spark: SparkSession, folder: str, formats: Sequence[str] = LISTED_FORMATS, max_files: int = 1_000
) -> DataFrame:
    """Stream of the folder's files, at most ``max_files`` per batch."""
    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", file_glob(formats))
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
        .withColumn("filename", T.file_name("path"))
    )


def arriving_rows(spark: SparkSession, folder: str, schema: StructType, max_files: int = 1_000) -> DataFrame:
    """Stream of the rows of a folder's Parquet files, oldest file first, with the ``path`` of the file."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
    return rows.withColumn("path", F.col("_metadata.file_path"))


def isolated(work: BatchWork, failures: str, retries: int = 2) -> BatchWork:
    """Run ``work`` on each batch; if it keeps failing, note the batch and its files and let the stream go on.

    The note holds each file once, so ``redrive`` can take them up again: nothing is lost with the batch's offsets.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(1 + retries):
            try:
                work(batch, batch_id)
                return
            except Exception as error:  # noqa: BLE001 - the failure is recorded below
                message = f"{type(error).__name__}: {error}"
                if attempt == retries:
                    path = F.col("path") if "path" in batch.columns else F.lit(None).cast("string")
                    noted = batch.select(
                        F.lit(batch_id).cast("long").alias("batch"), F.lit(attempt + 1).alias("attempts"),
                        F.lit(message).alias("message"), path.alias("path"),
                    )
                    noted.distinct().write.mode("overwrite").parquet(f"{failures}/batch_id={batch_id}")

    return run


def screen_batch(
    target: str, options: IngestOptions = IngestOptions(), texts: Callable[[DataFrame], DataFrame] | None = None
) -> BatchWork:
    """Screen one batch into its own folders, which it overwrites; ``texts`` makes its documents out of its rows."""

    def work(batch: DataFrame, batch_id: int) -> None:
        documents = batch if texts is None else texts(batch)
        screened_path = f"{target}/screened/batch_id={batch_id}"
        ingest.screen(documents, options).write.mode("overwrite").parquet(screened_path)
        screened = batch.sparkSession.read.parquet(screened_path)
        ingest.accepted(screened).write.mode("overwrite").parquet(f"{target}/contracts/batch_id={batch_id}")
        ingest.rejected(screened).write.mode("overwrite").parquet(f"{target}/rejects/batch_id={batch_id}")

    return work


def _drain(
    stream: DataFrame, screen: BatchWork, target: str, checkpoint: str, retries: int, then: BatchWork | None
) -> StreamingQuery:
    def work(batch: DataFrame, batch_id: int) -> None:
        screen(batch, batch_id)
        if then is not None:
            then(batch.sparkSession.read.parquet(f"{target}/contracts/batch_id={batch_id}"), batch_id)

    return (
        stream.writeStream.foreachBatch(isolated(work, f"{target}/failures", retries))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_arrivals(
    files: DataFrame,
    target: str,
    checkpoint: str,
    extractors: Mapping[str, Sequence[Extractor]] | None = None,
    options: IngestOptions = IngestOptions(),
    retries: int = 2,
    then: BatchWork | None = None,
) -> StreamingQuery:
    """Extract and screen all files that have arrived, then stop: tables ``contracts``, ``rejects``, ``failures``.

    Each batch owns one ``batch_id`` folder and overwrites it, so a batch replayed after a crash leaves no copies.
    ``then`` goes on with each batch's contracts, for example to find clauses and index them; it must overwrite by
    batch number as well.
    """

    def texts(batch: DataFrame) -> DataFrame:
        return extract_texts(batch, extractors).transform(ingest.stable_ids)

    return _drain(files, screen_batch(target, options, texts), target, checkpoint, retries, then)


def ingest_rows(
    documents: DataFrame,
    target: str,
    checkpoint: str,
    options: IngestOptions = IngestOptions(),
    retries: int = 2,
    then: BatchWork | None = None,
) -> StreamingQuery:
    """The same for documents that arrive as rows with a ``text``, see ``arriving_rows``; their columns are kept."""
    return _drain(documents, screen_batch(target, options), target, checkpoint, retries, then)


def _files_again(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).withColumn("filename", T.file_name("path"))


def rows_again(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of Parquet files, as ``arriving_rows`` gave them."""
    return spark.read.parquet(*paths).withColumn("path", F.col("_metadata.file_path"))


def redrive(
    spark: SparkSession, failures: str, work: BatchWork, retries: int = 2, read: Reader = _files_again
) -> int:
    """Run ``work`` again on the files of all batches noted in ``failures``; returns how many batches now succeed.

    A batch holds at most the files that one trigger takes, so its list of names is small. What fails again is noted
    anew; what succeeds leaves an empty note.
    """
    noted = spark.read.parquet(failures).filter(F.col("path").isNotNull())
    done = 0
    for (number,) in noted.select("batch").distinct().orderBy("batch").collect():
        folder = f"{failures}/batch_id={number}"
        paths = [r["path"] for r in spark.read.parquet(folder).select("path").distinct().collect()]
        files = read(spark, paths)
        # The note is emptied first; the guard writes it again if the batch still fails.
        empty = spark.createDataFrame([], "batch long, attempts int, message string, path string")
        empty.write.mode("overwrite").parquet(folder)
        isolated(work, failures, retries)(files, number)
        done += spark.read.parquet(folder).isEmpty()
    return done


def drop_repeats(stream: DataFrame, key: Sequence[str], stamp: str, delay: str = "1 hour") -> DataFrame:
    """Drop rows whose key was seen before, within the watermark; state older than that is forgotten."""
    return stream.withWatermark(stamp, delay).dropDuplicatesWithinWatermark(list(key))


def live_rate(
    stream: DataFrame, stamp: str, width: str = "1 minute", slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Rows per time window of a stream; rows later than the watermark are dropped."""
    timed = stream.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, delay)
    return windowed_rate(timed, stamp, width, slide)
