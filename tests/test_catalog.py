"""Every catalogue query against DuckDB, and what must hold for the catalogue as a whole."""

import compare
import pytest

import __spark_entry__ as entry_module
from clauseloom.catalog import ORACLES, QUERIES

ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    frame = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert compare.differences(duck, frame, ORACLES[name]) == []
    else:
        assert frame.count() > 0


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


def test_entry_answers_the_flagship_question(spark):
    rows = {r["clause_type"]: r["rate"] for r in entry_module.entry(spark).collect()}
    assert set(rows) == {"termination", "confidentiality", "liability"}
    assert all(0 < rate < 1 for rate in rows.values())
    assert entry_module.queries().keys() >= QUERIES.keys()
    assert entry_module.oracle_sql().keys() >= ORACLES.keys()


def test_loaded_and_rejected_add_up(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert QUERIES["loaded_contracts"](spark, sf_dir).count() + QUERIES["rejects"](spark, sf_dir).count() == found


def test_known_clauses_are_all_detected(spark, sf_dir):
    for row in QUERIES["detection_accuracy"](spark, sf_dir).collect():
        assert (row["precision"], row["recall"]) == (1.0, 1.0)


def test_scores_fall_with_rank(spark, sf_dir):
    rows = QUERIES["sample_search"](spark, sf_dir).orderBy("query_id", "rank").collect()
    for a, b in zip(rows, rows[1:]):
        if a["query_id"] == b["query_id"]:
            assert b["rank"] == a["rank"] + 1 and -1 <= b["score"] <= a["score"] <= 1
