"""Sparse vectors: tf-idf postings, and text search over one row of weighted terms per item."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import text as T
from clauseloom.operators.dense import Best
from clauseloom.operators.layout import lookup_join, top_per_group
from clauseloom.operators.summary import document_frequency, inverse_frequency
from clauseloom.sources.stages import stage

# Terms of queries that are shipped to the tasks at a time, and items that a task scores at a time.
MAX_BLOCK_TERMS = 5_000
SLICE_ROWS = 1_000


def term_weights(items: DataFrame, text: str = "clause") -> DataFrame:
    """One row per term: its document frequency and inverse document frequency."""
    total = items.agg(F.count("*")).scalar()
    return document_frequency(items, text).withColumn("idf", inverse_frequency(F.col("df"), total))


def term_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n): how often each row's text has each term."""
    return rows.select(key, F.explode(T.terms(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def _unit(weighted: DataFrame, key: str) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("w") / norm).alias("weight"))


def postings(items: DataFrame, weights: DataFrame, key: str = "item_id", text: str = "clause") -> DataFrame:
    """(item_id, term, weight): tf-idf weights scaled to unit length per item. This table is the index."""
    counted = term_counts(items, key, text)
    weighted = lookup_join(counted, weights, "term", "df").withColumn("w", F.col("n") * F.col("idf"))
    return _unit(weighted, key)


def query_postings(queries: DataFrame, weights: DataFrame, total: Column) -> DataFrame:
    """(query_id, term, weight) of query texts; terms the index has never seen count as the rarest."""
    counted = term_counts(queries, "query_id", "text")
    unseen = inverse_frequency(F.lit(0.0), total)
    weighted = lookup_join(counted, weights, "term", "df", how="left").withColumn(
        "w", F.col("n") * F.coalesce("idf", unseen)
    )
    return _unit(weighted, "query_id")


def item_vectors(index: DataFrame, key: str = "item_id") -> DataFrame:
    """(item_id, terms, weights): the postings of each item in one row, the form that search reads."""
    pairs = F.collect_list(F.struct("term", "weight"))
    return index.groupBy(key).agg(pairs.alias("_p")).select(key, F.col("_p.term").alias("terms"), F.col("_p.weight").alias("weights"))


class _Block:
    """The weighted terms of a block of queries as a matrix of terms and queries."""

    def __init__(self, rows: list) -> None:
        self.query_ids = [r["query_id"] for r in rows]
        self.place: dict[str, int] = {}
        for r in rows:
            for term in r["terms"]:
                self.place.setdefault(term, len(self.place))
        self.weights = np.zeros((len(self.place), len(rows)))
        for column, r in enumerate(rows):
            for term, weight in zip(r["terms"], r["weights"]):
                self.weights[self.place[term], column] = weight

    def scores(self, terms: Sequence, weights: Sequence) -> tuple[np.ndarray, np.ndarray]:
        """Queries by items, and where they share a term at all."""
        rows, columns, values = [], [], []
        for n, (own, own_weights) in enumerate(zip(terms, weights)):
            for term, weight in zip(own, own_weights):
                at = self.place.get(term)
                if at is not None:
                    rows.append(n)
                    columns.append(at)
                    values.append(weight)
        items = np.zeros((len(terms), len(self.place)))
        items[rows, columns] = values
        return (items @ self.weights).T, ((items > 0) @ (self.weights > 0)).T > 0


def search(
    queries: DataFrame,
    items: DataFrame,
    k: int = 5,
    index: DataFrame | None = None,
    weights: DataFrame | None = None,
    max_terms: int = MAX_BLOCK_TERMS,
) -> DataFrame:
    """Top-k items per query text by tf-idf cosine: (query_id, rank, item_id, score).

    ``queries`` is (query_id, text), ``items`` is (item_id, clause). Stored ``weights`` and ``index`` tables, the latter
    as postings or as item vectors, are used if given. Items are one row each and stay where they are; queries are
    shipped in blocks of about ``max_terms`` terms, scored inside the task, and k hits per query and task go on. So no
    pair of query and item is ever shuffled, however common their terms. ``items`` is read several times: pass a
    stored table (see ``stages.stage``).
    """
    weights = term_weights(items) if weights is None else weights
    index = postings(items, weights) if index is None else index
    vectors = index if "terms" in index.columns else item_vectors(index)
    total = items.agg(F.count("*")).scalar()
    asked = stage(item_vectors(query_postings(queries, weights, total), "query_id"), "asked")
    size = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-size // max_terms))
    spark = queries.sparkSession
    types = {c: df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (vectors, "item_id"))}
    schema = f"query_id {types['query_id']}, item_id {types['item_id']}, score double"

    partials = []
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(rows)

        def scan(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own = _Block(shared.value)
            best = Best(own.query_ids, k)
            every = np.arange(len(own.query_ids))
            for frame in frames:
                for at in range(0, len(frame), SLICE_ROWS):
                    part = frame.iloc[at : at + SLICE_ROWS]
                    scores, share = own.scores(part["terms"], part["weights"])
                    some = share.any(axis=0)
                    if some.any():
                        scores = np.where(share, scores, -np.inf)[:, some]
                        best.add(every, scores, part["item_id"].to_numpy()[some])
            yield best.rows()

        partials.append(vectors.mapInPandas(scan, schema))
    if not partials:
        return spark.createDataFrame([], schema).select("query_id", F.lit(0).alias("rank"), "item_id", "score")
    order = [F.desc("score"), F.col("item_id")]
    found = reduce(DataFrame.unionByName, partials).filter(F.col("score") > float("-inf"))
    return top_per_group(found, ["query_id"], order, k).select("query_id", "rank", "item_id", "score")


def attach(hits: DataFrame, items: DataFrame) -> DataFrame:
    """Add contract, type, file and text to hits. Adaptive execution broadcasts them if they prove to be few."""
    return items.select("item_id", "contract_id", "clause_type", "filename", "clause").join(hits, "item_id")


def above(hits: DataFrame, threshold: float) -> DataFrame:
    """Hits whose score reaches the threshold."""
    return hits.filter(F.col("score") >= threshold)


def cap_results(hits: DataFrame, k: int, max_results: int) -> DataFrame:
    """At most ``max_results`` hits per query, whatever ``k`` asks for."""
    return hits.filter(F.col("rank") <= min(k, max_results))
