"""Streams run over what has arrived, then stop."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from clauseloom.streaming import arrivals, repeats
from test_clauses import AGREEMENT

TEXT = {"pdf": [("plain", lambda content: content.decode())]}


def test_new_files_are_ingested_once(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()

    def drain():
        files = arrivals.arriving_files(spark, str(source), max_files=1)
        arrivals.ingest_arrivals(files, target, state, TEXT).awaitTermination(120)
        return sorted(r["filename"] for r in spark.read.parquet(f"{target}/contracts").collect())

    (source / "a.pdf").write_text(AGREEMENT)
    (source / "tiny.pdf").write_text("x")
    assert drain() == ["a.pdf"]
    (source / "b.pdf").write_text(AGREEMENT + " More.")
    assert drain() == ["a.pdf", "b.pdf"]
    assert drain() == ["a.pdf", "b.pdf"]
    assert [r["reason"] for r in spark.read.parquet(f"{target}/rejects").collect()] == ["too_short"]


def test_failing_batch_is_noted_and_the_next_one_runs(spark, tmp_path):
    calls = []

    def work(batch, batch_id):
        calls.append(batch_id)
        if batch_id == 1:
            raise RuntimeError("bad batch")

    guarded = arrivals.isolated(work, str(tmp_path / "failures"), retries=1)
    for batch_id in range(3):
        guarded(spark.range(1).selectExpr("concat('/in/', id) AS path"), batch_id)
    assert calls == [0, 1, 1, 2]
    (row,) = spark.read.parquet(str(tmp_path / "failures")).collect()
    assert (row["batch"], row["attempts"], row["message"], row["path"]) == (1, 2, "RuntimeError: bad batch", "/in/0")


def test_failed_files_can_be_driven_again(spark, tmp_path):
    source, failures, seen = tmp_path / "in", str(tmp_path / "failures"), []
    source.mkdir()
    (source / "a.pdf").write_text(AGREEMENT)
    files = spark.read.format("binaryFile").load(str(source))

    def broken(batch, batch_id):
        raise RuntimeError("down")

    arrivals.isolated(broken, failures, retries=0)(files, 7)
    assert arrivals.redrive(spark, failures, broken, retries=0) == 0
    assert arrivals.redrive(spark, failures, lambda batch, n: seen.append((n, batch.count()))) == 1
    assert seen == [(7, 1)] and arrivals.redrive(spark, failures, broken) == 0


def _stream(spark, folder, batches, schema):
    """A stream that sees one file per batch, in order."""
    folder.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder / f"part{i}"))
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False)
    return reader.json(str(folder / "part*"))


def _run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_repeats_are_dropped_within_the_watermark(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    batches = [[("a", t), ("b", t)], [("a", t + dt.timedelta(minutes=1)), ("c", t)]]
    stream = _stream(spark, tmp_path / "s", batches, "contract_id string, ts timestamp")
    _run(arrivals.drop_repeats(stream, ["contract_id"], "ts"), "repeats", "append")
    assert sorted(r["contract_id"] for r in spark.table("repeats").collect()) == ["a", "b", "c"]


def test_live_rate_equals_batch_and_drops_late_rows(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    minute = dt.timedelta(minutes=1)
    batches = [
        [(i, t + i * minute / 2) for i in range(4)],
        [(9, t + 60 * minute)],
        [(11, t + 61 * minute)],
        [(10, t)],  # comes an hour late
        [(12, t + 90 * minute)],
    ]
    stream = _stream(spark, tmp_path / "s", batches, "id int, ts timestamp")
    _run(arrivals.live_rate(stream, "ts"), "rates", "append")
    got = {r["start"]: r["rows"] for r in spark.table("rates").select(F.date_format("start", "HH:mm").alias("start"), "rows").collect()}
    assert got == {"00:00": 2, "00:01": 2, "01:00": 1, "01:01": 1}


def _contents(spark, tmp_path, batches, schema, **options):
    stream = _stream(spark, tmp_path / "s", batches, schema)
    passed = repeats.drop_repeated_content(stream, "text", "n", "at", **options)
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    query = passed.writeStream.format("parquet").option("checkpointLocation", state)
    query.trigger(availableNow=True).start(target).awaitTermination(120)
    return spark.read.parquet(target)


def test_content_passes_once_until_it_is_forgotten(spark, tmp_path):
    t, hour = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    batches = [
        [(3, "a", t + hour / 2), (2, "a", t), (1, "a", t), (4, None, t), (5, "b", t)],
        [(6, "a", t + hour), (7, None, t + hour), (8, "c", t + hour)],  # remembered
        [(9, "x", t + 20 * hour)],  # the watermark passes, timers forget what is older
        [(10, "a", t + 21 * hour), (11, "b", None), (12, "a", t + 21 * hour)],
    ]
    got = _contents(spark, tmp_path, batches, "n long, text string, at timestamp", keep_hours=5)
    assert sorted((r["n"], r["text"]) for r in got.collect()) == [(1, "a"), (4, None), (5, "b"), (8, "c"), (9, "x"), (10, "a")]


def test_passing_rows_keep_their_values(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 0, 0, 0, 123456)
    row = (2**62 + 1, "ü\n\"", at, None, float("inf"), [1, None], {"k": "v"}, 2**60 + 1)
    schema = "n long, text string, at timestamp, gone int, d double, l array<int>, m map<string,string>, `_row` long"
    source = tmp_path / "s"
    spark.createDataFrame([row, row], schema).write.parquet(str(source / "part0"))
    stream = spark.readStream.schema(schema).parquet(str(source / "part*"))
    passed = repeats.drop_repeated_content(stream, "text", "n", "at")
    _run(passed, "kept_values", "append")
    assert [tuple(r) for r in spark.table("kept_values").collect()] == [row]


def test_a_content_that_fills_the_stream_is_held_row_by_row(spark, tmp_path):
    rows = spark.range(30_000).selectExpr(
        "id AS n", "if(id % 10 < 9, 'same', concat('t', id)) AS text", "timestamp'2024-01-01' AS at"
    )
    rows.repartition(4).write.parquet(str(tmp_path / "s" / "part0"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "s" / "part*"))
    _run(repeats.drop_repeated_content(stream, "text", "n", "at"), "hot_content", "append")
    assert spark.table("hot_content").filter("text = 'same'").count() == 1
    assert spark.table("hot_content").count() == 3_001


def test_contents_are_handled_by_bucket_and_forgotten_one_by_one(spark, tmp_path):
    t, hour = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    texts = [f"text {i}" for i in range(6_000)]
    batches = [
        [(i, text, t + (i % 3) * hour) for i, text in enumerate(texts)],
        [(9_000, "late mark", t + hour * 8)],
        [(10_000 + i, text, t + hour * 8) for i, text in enumerate(texts)],  # the watermark is at 7 h: those of 0 to 2 h are due
        [(20_000 + i, text, t + hour * 8) for i, text in enumerate(texts)],
    ]
    got = _contents(spark, tmp_path, batches, "n long, text string, at timestamp", keep_hours=6)
    passed = [r["n"] for r in got.collect()]
    # Due at 7 h are those of 0 and 1 h, not those of 2 h.
    want = [*range(6_000), 9_000, *(10_000 + i for i in range(6_000) if i % 3 < 2)]
    assert sorted(passed) == want


class _Calls:
    """A state that counts how it is used, in place of the session's."""

    def __init__(self):
        self.held, self.timers = {}, set()

    def getMapState(self, *_):  # noqa: N802
        return self

    def getValue(self, key):  # noqa: N802
        return self.held.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.held[key] = value

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)


def test_a_bucket_of_many_contents_takes_one_call_and_few_timers():
    state, processor = _Calls(), repeats.FirstOfContent(8_000)
    processor.init(state)
    state.getCurrentWatermarkInMs = lambda: 0
    frame = pd.DataFrame({"digest": [f"abc{i % 500}" for i in range(1_000)], "millis": range(1_000), "place": 0, "body": "{}", "at": None})
    (passed,) = processor.handleInputRows(("abc",), iter([frame, frame]), state)
    assert len(passed) == len(state.held) == 500 and state.timers == {8_000, 9_000}
    assert list(processor.handleInputRows(("abc",), iter([frame]), state)) == []
