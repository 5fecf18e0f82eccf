"""Streams over the given tables: rows arrive in files, the stream takes them in batches to the end, and its tables are
read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.catalog import ctes as C
from clauseloom.catalog import fixture
from clauseloom.catalog.registry import query
from clauseloom.operators.layout import spread
from clauseloom.sources.stages import new_folder
from clauseloom.streaming import arrivals, repeats

# Files of an arrival are taken in about as many batches.
BATCHES = 3


def _arrive(rows: DataFrame, folder: str, part: str) -> int:
    """Write rows as newly arrived files; returns how many files a batch should take."""
    files = rows.rdd.getNumPartitions()
    rows.write.parquet(f"{folder}/{part}")
    return max(1, files // BATCHES)


def _stored(spark: SparkSession, stream: DataFrame, target: str, state: str) -> DataFrame:
    """Run a stream to the end into a Parquet table and read it."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append")
    writer.trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


@query(
    "arrived_documents",
    C.sql(
        """SELECT contract_id, coalesce(reason, 'loaded') AS outcome, CAST(length(text) AS INTEGER) AS text_length
        FROM screened""",
        "screened",
    ),
)
def _(spark, sf_dir):
    """Even documents arrive first, odd ones while the stream rests; both runs share one checkpoint."""
    raw = fixture.raw(spark, sf_dir)
    folder, target, state = (new_folder(spark, f"arrived-{x}") for x in ("in", "out", "state"))
    for odd in (0, 1):
        size = _arrive(raw.filter(F.col("doc_id") % 2 == odd), folder, f"part{odd}")
        stream = arrivals.arriving_rows(spark, f"{folder}/part*", raw.schema, size)
        arrivals.ingest_rows(stream, target, state).awaitTermination()
    loaded = spark.read.parquet(f"{target}/contracts").select(
        "contract_id", F.lit("loaded").alias("outcome"), F.length("text").alias("text_length")
    )
    rejects = spark.read.parquet(f"{target}/rejects")
    return loaded.unionByName(rejects.select("contract_id", F.col("reason").alias("outcome"), "text_length"))


@query(
    "redriven_documents",
    C.sql(
        """SELECT contract_id, 1::BIGINT AS copies, 1::BIGINT AS batches_noted, 1 AS batches_redriven
        FROM contracts""",
        "contracts",
    ),
)
def _(spark, sf_dir):
    """The first batch fails as long as the stream runs, the others go on; driven again, it brings its documents."""
    raw = fixture.raw(spark, sf_dir)
    folder, target, state = (new_folder(spark, f"redriven-{x}") for x in ("in", "out", "state"))
    size = _arrive(raw, folder, "part0")
    screen = arrivals.screen_batch(target)

    def broken(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            raise OSError("the target is away")
        screen(batch, batch_id)

    failures = f"{target}/failures"
    stream = arrivals.arriving_rows(spark, f"{folder}/part*", raw.schema, size)
    writer = stream.writeStream.foreachBatch(arrivals.isolated(broken, failures, retries=1))
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    noted = spark.read.parquet(failures).agg(F.count_distinct("batch")).first()[0]
    redriven = arrivals.redrive(spark, failures, screen, read=arrivals.rows_again)
    contracts = spark.read.parquet(f"{target}/contracts").groupBy("contract_id").agg(F.count("*").alias("copies"))
    return contracts.select(
        "contract_id", "copies", F.lit(noted).cast("long").alias("batches_noted"),
        F.lit(redriven).alias("batches_redriven"),
    )


@query(
    "arrived_contents",
    """SELECT sha256(coalesce(text, '')) AS content, 1::BIGINT AS rows,
      CAST(min(length(coalesce(text, ''))) AS INTEGER) AS text_length FROM documents GROUP BY 1""",
)
def _(spark, sf_dir):
    """All documents arrive, and later all of them once more: each content passes once, copies included."""
    documents = spread(fixture.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    folder, target, state = (new_folder(spark, f"contents-{x}") for x in ("in", "out", "state"))
    for part in ("part0", "part1"):
        size = _arrive(documents, folder, part)
        arrived = arrivals.arriving_rows(spark, f"{folder}/part*", documents.schema, size).select(
            "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("_metadata.file_modification_time").alias("at")
        )
        passed = _stored(spark, repeats.drop_repeated_content(arrived, "text", "doc_id", "at"), target, state)
    return passed.groupBy(F.sha2("text", 256).alias("content")).agg(
        F.count("*").alias("rows"), F.min(F.length("text")).alias("text_length")
    )


@query(
    "live_rate",
    """SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, rows FROM (
      SELECT date_trunc('hour', ts) AS start, count(*) AS rows FROM events WHERE ts IS NOT NULL GROUP BY 1)
    WHERE start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 8 DAY""",
)
def _(spark, sf_dir):
    """Events arrive week by week, none later than the delay; windows that the watermark has passed are read back."""
    events = fixture.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    folder, target, state = (new_folder(spark, f"rate-{x}") for x in ("in", "out", "state"))
    week = F.floor(F.unix_seconds("ts") / (7 * 86_400))
    first, last = events.agg(F.min(week), F.max(week)).first()
    size = 1
    for number in range(first or 0, (last or 0) + 1):
        size = max(size, _arrive(events.filter(week == number), folder, f"part{number}"))
    stream = arrivals.arriving_rows(spark, f"{folder}/part*", events.schema, size)
    rates = _stored(spark, arrivals.live_rate(stream, "ts", "1 hour", delay="8 days"), target, state)
    return rates.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "rows")
