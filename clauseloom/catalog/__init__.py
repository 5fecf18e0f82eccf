"""The catalogue: every operator as a query over the given tables, with its SQL counterpart."""

from clauseloom.catalog import clause_queries, ingest_queries, job_queries, model_queries  # noqa: F401
from clauseloom.catalog import search_queries, stream_queries, text_queries  # noqa: F401
from clauseloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
