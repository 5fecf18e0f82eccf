"""Numbering, hot-key joins and top-k per group, also under heavy skew."""

from pyspark.sql import functions as F

from clauseloom.operators import ingest
from clauseloom.operators.layout import frequent, lookup_join, number_rows, spread, top_per_group


def test_numbers_follow_the_order(spark):
    frame = spark.range(5_000).select(
        F.concat(F.lit("f"), (F.col("id") * 7919 % 5000).cast("string")).alias("name"), "id"
    )
    rows = number_rows(frame, ["name", "id"]).collect()
    assert [r["row_no"] for r in sorted(rows, key=lambda r: (r["name"], r["id"]))] == list(range(1, 5_001))


def test_numbers_hold_when_one_name_fills_a_third(spark):
    frame = spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("name"), "id"
    )
    rows = number_rows(frame, ["name", "id"]).collect()
    assert [r["row_no"] for r in sorted(rows, key=lambda r: (r["name"], r["id"]))] == list(range(1, 3_001))


def test_numbering_an_empty_or_tiny_table(spark):
    frame = spark.range(2).select(F.lit("a").alias("name"), "id")
    assert {(r["id"], r["row_no"]) for r in number_rows(frame, ["name", "id"]).collect()} == {(0, 1), (1, 2)}
    assert number_rows(frame.filter("id > 5"), ["name", "id"]).count() == 0


def test_lookup_join_equals_plain_join(spark):
    left = spark.range(3_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    right = counts.filter("k < 40").withColumn("v", F.col("k") * 10)
    for limit in (1, 3, 1_000):
        assert frequent(counts, "n", limit).count() <= limit
        for how in ("inner", "left"):
            got = lookup_join(left, right, "k", "n", limit, how).select("id", "k", "v")
            want = left.join(right, "k", how).select("id", "k", "v")
            assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_top_per_group_prunes_before_the_shuffle(spark):
    frame = spark.range(1_000).select((F.col("id") % 2).alias("g"), "id")
    top = top_per_group(frame, ["g"], [F.desc("id")], 3)
    assert sorted((r["g"], r["rank"], r["id"]) for r in top.collect()) == [
        (0, 1, 998), (0, 2, 996), (0, 3, 994), (1, 1, 999), (1, 2, 997), (1, 3, 995),
    ]
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_spread_leaves_wide_tables_alone(spark):
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide, "id") is wide
    assert spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_contract_numbers_put_pdfs_first_and_leave_gaps(spark):
    names = [("b.docx", "/b"), ("z.PDF", "/z"), ("a.docx", "/a"), ("y.pdf", "/y")]
    frame = spark.createDataFrame(names, "filename string, path string")
    for limit in (None, 3):
        got = {r["filename"]: r["contract_id"] for r in ingest.assign_contract_ids(frame, "path", limit).collect()}
        want = {"y.pdf": "contract_001", "z.PDF": "contract_002", "a.docx": "contract_003", "b.docx": "contract_004"}
        assert got == dict(list(want.items())[:limit])


def test_long_numbers_are_not_cut(spark):
    frame = spark.range(1_200).select(F.format_string("%05d.pdf", "id").alias("filename"), "id")
    last = ingest.assign_contract_ids(frame, "id").orderBy(F.desc("id")).first()
    assert last["contract_id"] == "contract_1200"


def test_batches_and_chunks(spark):
    numbered = spark.range(1, 12).select(F.col("id").alias("row_no"))
    sizes = ingest.batches(numbered, 5).groupBy("batch_no").count().orderBy("batch_no").collect()
    assert [tuple(r) for r in sizes] == [(1, 5), (2, 5), (3, 1)]
    texts = spark.createDataFrame([("a", "x" * 25), ("b", ""), ("c", "y" * 10)], "contract_id string, text string")
    rows = ingest.chunks(texts, 10).orderBy("contract_id", "chunk_no").collect()
    assert [(r["contract_id"], r["chunk_no"], r["start"], len(r["chunk"])) for r in rows] == [
        ("a", 0, 1, 10), ("a", 1, 11, 10), ("a", 2, 21, 5), ("b", 0, 1, 0), ("c", 0, 1, 10),
    ]
    assert ingest.hash_batches(spark.range(100), "id", 4).select("batch_no").distinct().count() == 4


def test_copies_are_dropped_but_the_first(spark):
    texts = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("text"))
    kept = sorted(r["id"] for r in ingest.distinct_content(texts, "id").collect())
    assert kept == sorted([0] + [i for i in range(300) if i % 3])


def test_the_latest_batch_counts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "contract_id string, v int")
    new = spark.createDataFrame([("a", 2), ("a", 3)], "contract_id string, v int")
    assert sorted(tuple(r) for r in ingest.combine([old, new]).collect()) == [("a", 3), ("b", 1)]
    assert sorted(tuple(r) for r in ingest.combine([new, old]).collect()) == [("a", 1), ("b", 1)]


def test_copies_of_null_text_are_dropped_too(spark):
    texts = spark.createDataFrame([(4, None), (2, None), (3, ""), (1, "x"), (5, None)], "id int, text string")
    assert sorted(r["id"] for r in ingest.distinct_content(texts, "id").collect()) == [1, 2, 3]


def test_batches_with_null_keys_and_many_repeats(spark):
    schema = "k string, n int, v string"
    first = spark.createDataFrame([(None, 1, "old"), ("a", None, "x"), ("a", None, "y"), ("b", 1, "only")], schema)
    second = spark.createDataFrame([(None, 1, "new"), ("c", 2, "only")], schema)
    none = spark.createDataFrame([], schema)
    rows = sorted(map(tuple, ingest.combine([first, second, none], ["k", "n"]).collect()), key=str)
    assert rows == sorted([(None, 1, "new"), ("a", None, "y"), ("b", 1, "only"), ("c", 2, "only")], key=str)
    assert ingest.combine([none, none], ["k", "n"]).isEmpty()
    again = ingest.combine([first, first, second, first], ["k", "n"])
    assert sorted(map(tuple, again.collect()), key=str) == sorted(
        [(None, 1, "old"), ("a", None, "y"), ("b", 1, "only"), ("c", 2, "only")], key=str
    )


def test_texts_stay_where_they_are_when_batches_are_combined(spark, tmp_path):
    for n in (0, 1):
        rows = spark.range(n * 900, n * 900 + 1_000).select(F.col("id").alias("contract_id"), F.lit("t" * 500).alias("text"))
        rows.write.parquet(f"{tmp_path}/{n}")
    parts = [spark.read.parquet(f"{tmp_path}/{n}") for n in (0, 1)]
    combined = ingest.combine(parts)
    assert combined.count() == 1_900 and combined.select("contract_id").distinct().count() == 1_900
    plan = combined._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate" in line and "count(1)" in line]
    assert grouped and not any("text" in line for line in grouped)
