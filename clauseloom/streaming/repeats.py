"""Repeated content in a stream: the first row of each content passes, for as long as the content is remembered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Stamps keep their microseconds.
AS_JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


# Leading hex digits of a digest that make its bucket: 4,096 buckets, whatever the number of contents.
_BUCKET_DIGITS = 3
# Parts of the time to remember in which what is due is cleared at once.
_CLEARINGS = 8


class FirstOfContent(StatefulProcessor):
    """Per bucket of digests: lets the first row of each through, remembers it for ``keep_ms`` of event time, drops the rest.

    The state of a digest is one number, the time from which it is forgotten. A bucket's rows are handled together, so a
    content costs a look-up and an entry and no call of its own; timers clear what is due, a few for a bucket.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms
        self.grain = max(1, keep_ms // _CLEARINGS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getMapState("until", "digest string", "until long")

    def _remembered(self, digest: str, now: int) -> bool:
        known = self.until.getValue((digest,))
        return known is not None and known[0] > now  # timers fire after a batch's rows, and later than what is due

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        known: dict[str, bool] = {}
        first = None
        for frame in rows:  # a digest may bring very many rows: one of each is held at a time
            for digest in frame["digest"].unique():
                if digest not in known:
                    known[digest] = self._remembered(digest, now)
            new = frame[~frame["digest"].map(known).astype(bool)]
            every = new if first is None else pd.concat([first, new])
            first = every.sort_values(["millis", "place"], kind="stable").drop_duplicates("digest")
        if first is None or first.empty:
            return
        due = first["millis"] + self.keep_ms
        for digest, until in zip(first["digest"], due):
            self.until.updateValue((digest,), (int(until),))
        for clearing in (-(-due // self.grain) * self.grain).unique():
            self.handle.registerTimer(int(clearing))
        yield first[["body", "at"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        for digest in [k[0] for k, until in self.until.iterator() if until[0] <= now]:
            self.until.removeKey((digest,))
        return iter(())

    def close(self) -> None:
        pass


def _first_per_arrow_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows with one digest in an Arrow batch the first: frequent contents shrink before they are shuffled."""
    for rows in batches:
        order = pc.sort_indices(
            rows, sort_keys=[("digest", "ascending"), ("millis", "ascending"), ("place", "ascending")]
        )
        digests = rows["digest"].take(order)
        new = np.ones(len(order), bool)
        if len(order) > 1:
            new[1:] = pc.not_equal(digests[1:], digests[:-1]).to_numpy(zero_copy_only=False)
        yield rows.take(order.filter(pa.array(new)))


def drop_repeated_content(
    stream: DataFrame, content: str, order: str, stamp: str, keep_hours: int = 168, delay: str = "1 hour"
) -> DataFrame:
    """Rows of a stream whose ``content`` was not seen in the ``keep_hours`` before, with all their columns.

    Of equal contents in one batch the row with the least ``stamp``, then ``order`` (a whole number), passes. A content is remembered
    from the passing row's stamp on, across batches and restarts, until the watermark (``delay`` behind the latest
    stamp) has gone ``keep_hours`` further: then the next row with it passes again, and a timer removes its state. A
    null content is a content of its own; rows without a stamp are dropped, as there is no telling when to forget
    them; rows behind the watermark are late and dropped as well.

    State is a digest and a number per remembered content and lives in RocksDB, so it may outgrow the memory.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    marked = stream.filter(F.col(stamp).isNotNull()).select(
        F.coalesce(F.sha2(F.col(content).cast("binary"), 256), F.lit("")).alias("digest"),
        F.unix_millis(F.col(stamp).cast("timestamp")).alias("millis"),
        F.coalesce(F.col(order).cast("long"), F.lit(2**63 - 1)).alias("place"),
        F.col(stamp).cast("timestamp").alias("at"),
        # As JSON a row keeps every type and null on its way through pandas.
        F.to_json(F.struct(*[F.col(c) for c in stream.columns]), AS_JSON).alias("body"),
    )
    fewer = marked.mapInArrow(_first_per_arrow_batch, marked.schema).withWatermark("at", delay)
    dealt = fewer.withColumn("bucket", F.substring("digest", 1, _BUCKET_DIGITS))
    passed = dealt.groupBy("bucket").transformWithStateInPandas(
        FirstOfContent(keep_hours * 3_600_000), "body string, at timestamp", "Append", "EventTime"
    )
    return passed.select(F.from_json("body", stream.schema, AS_JSON).alias("body")).select("body.*")
