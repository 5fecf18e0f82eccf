"""Rows for people to read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import text as T


def hit_lines(hits: DataFrame, size: int = 100) -> DataFrame:
    """Search hits with the score rounded to three places and a snippet of the clause."""
    return hits.select(
        "query_id",
        "rank",
        "contract_id",
        "clause_type",
        F.round("score", 3).alias("score"),
        T.snippet("clause", size).alias("snippet"),
    )


def contract_lines(results: DataFrame, n: int = 2, size: int = 100) -> DataFrame:
    """The first ``n`` contracts with snippets of summary and termination clause."""
    return results.orderBy("contract_id").limit(n).select(
        "contract_id",
        T.snippet("summary", size).alias("summary"),
        T.snippet("termination_clause", size).alias("termination_clause"),
    )
