"""Stored sketches merged later, against exact figures."""

import pytest
from pyspark.sql import functions as F

from clauseloom.operators import sketches


@pytest.fixture(scope="module")
def stored(spark):
    # A third of the rows is one key; one group has nulls only.
    rows = spark.range(60_000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('g', id % 7)) AS g", "if(id % 3 = 0, id % 10, id) AS user", "id AS v"
    ).unionByName(spark.sql("SELECT 'none' AS g, CAST(NULL AS BIGINT) AS user, CAST(NULL AS BIGINT) AS v"))
    return rows, sketches.sketch(rows, ["g"], F.col("user"), F.col("v")).cache()


def test_merged_sketches_stay_within_their_bounds(stored):
    rows, parts = stored
    (got,) = sketches.read(sketches.merge(parts)).collect()
    exact = rows.select("user").distinct().count() - 1
    assert got["rows"] == 60_001 and abs(got["distinct"] - exact) <= 0.05 * exact
    assert abs(got["quantiles"][0] - 30_000) <= 0.03 * 60_000 and abs(got["quantiles"][1] - 54_000) <= 0.03 * 60_000


def test_merging_in_steps_gives_the_same_kind_of_result(stored):
    _, parts = stored
    halves = sketches.merge(parts.withColumn("half", F.col("g") < "g3"), ["half"])
    (got,) = sketches.read(sketches.merge(halves)).collect()
    assert got["rows"] == 60_001 and abs(got["quantiles"][0] - 30_000) <= 0.04 * 60_000


def test_nulls_are_left_out_and_no_rows_give_no_groups(stored):
    rows, parts = stored
    (none,) = sketches.read(parts.filter("g = 'none'")).collect()
    assert (none["rows"], none["distinct"], none["quantiles"]) == (1, 0, [None, None])
    assert sketches.sketch(rows.limit(0), ["g"], F.col("user"), F.col("v")).count() == 0
