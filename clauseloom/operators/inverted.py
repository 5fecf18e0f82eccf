"""Text search over an inverted index: postings by falling weight, in blocks that say how much they can add.

A search opens the first block of each query term, scores what it finds there exactly, and takes the k-th best score as
the one to reach. Then it opens only those further blocks that an item of such a score, not seen yet, could be in.
Hits are those of scoring every item; terms, blocks and items without a part in the search are not read. The items of
opened blocks meet the queries in groups of bounded size, so no pair of query and item is shuffled, sorted or hashed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.operators.layout import top_per_group
from clauseloom.operators.sparse import item_vectors, postings, term_counts, term_weights
from clauseloom.operators.summary import inverse_frequency
from clauseloom.sources.stages import stage

BLOCK_POSTINGS = 128
# Postings of a bucket of the index: what a search reads at least for a term or an item.
BUCKET_POSTINGS = 1_000_000
MAX_BUCKETS = 4_096
# Items, queries and terms of queries of one group in which opened items are scored.
GROUP_ITEMS, GROUP_QUERIES, GROUP_TERMS = 5_000, 1_000, 5_000
SLICE_ROWS = 500
SCORE_DIGITS = 12
# Blocks are opened a little below the bound, so that rounding never closes one.
SLACK = 1e-9

Store = Callable[[DataFrame, str, str], DataFrame]


@dataclass(frozen=True)
class TermIndex:
    """Stored tables of an index.

    ``terms`` (term, df, idf, bucket, blocks, first, greatest): a row per term, with its greatest weight; ``blocks``
    (term, seq, greatest, items, bucket): postings by falling weight, dealt to buckets of terms; ``vectors`` (item_id,
    terms, weights, bucket): an item's postings, dealt to buckets of items; ``total``: number of items.
    """

    terms: DataFrame
    blocks: DataFrame
    vectors: DataFrame
    total: int
    buckets: int


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def build(
    items: DataFrame, weights: DataFrame | None = None, block: int = BLOCK_POSTINGS, buckets: int | None = None,
    store: Store = stage,
) -> TermIndex:
    """Index ``items`` (item_id, clause), stored with ``store``.

    Postings are dealt by ranges of (term, falling weight) and cut into blocks inside each range, so a frequent term
    passes through as many tasks as it fills, and no term is collected.
    """
    weights = stage(term_weights(items), "term-weights") if weights is None else weights
    total = items.count()
    index = stage(postings(items, weights), "postings")
    if buckets is None:
        buckets = min(MAX_BUCKETS, 1 + index.count() // BUCKET_POSTINGS)
    order = [F.col("term"), F.desc("weight"), F.col("item_id")]
    ranged = index.repartitionByRange(*order).sortWithinPartitions(*order)
    # The generated id counts from 0 inside each range, in its lower 33 bits.
    placed = ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn(
        "seq", F.shiftleft(F.shiftright("_at", 33), 33) + F.floor(F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) / block)
    )
    posting = F.struct(F.negative("weight").alias("_less"), "item_id", "weight")
    cut = placed.groupBy("term", "seq").agg(F.max("weight").alias("greatest"), F.sort_array(F.collect_list(posting)).alias("items"))
    blocks = store(
        cut.select("term", "seq", "greatest", F.col("items.item_id").alias("items"), _bucket("term", buckets).alias("bucket")),
        "index-blocks", "bucket",
    )
    sizes = blocks.groupBy("term").agg(
        F.count("*").alias("blocks"), F.min("seq").alias("first"), F.max("greatest").alias("greatest")
    )
    terms = store(weights.join(sizes, "term").withColumn("bucket", _bucket("term", buckets)), "index-terms", "bucket")
    vectors = store(item_vectors(index).withColumn("bucket", _bucket("item_id", buckets)), "postings", "bucket")
    return TermIndex(terms, blocks, vectors, total, buckets)


def _only(table: DataFrame, wanted: DataFrame, key: str, buckets: int) -> DataFrame:
    """The part of an index table in the buckets of some keys; the others' folders are not read."""
    if buckets == 1:
        return table
    found = [r[0] for r in wanted.select(_bucket(key, buckets)).distinct().collect()]  # at most MAX_BUCKETS numbers
    return table.filter(F.col("bucket").isin(found))


def _scored(candidates: DataFrame, asked: DataFrame, index: TermIndex) -> DataFrame:
    """(query_id, item_id, score) of candidates: exact, from the items' own terms."""
    weights = F.map_from_arrays("terms", "weights").alias("_asked")
    wanted = item_vectors(asked, "query_id").select("query_id", weights)
    # The buckets of many candidates are looked at before their items are read.
    pairs = stage(candidates, "candidates") if index.buckets > 1 else candidates
    vectors = _only(index.vectors, pairs, "item_id", index.buckets).select("item_id", "terms", "weights")
    parts = F.zip_with("terms", "weights", lambda t, w: F.coalesce(F.try_element_at("_asked", t), F.lit(0.0)) * w)
    score = F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)
    return pairs.join(vectors, "item_id").join(wanted, "query_id").select(
        "query_id", "item_id", (F.round(score, SCORE_DIGITS) + F.lit(0.0)).alias("score")
    )


def _group_scores(found: pa.Table, wanted: pa.Table) -> np.ndarray:
    """Items by queries of one group: inner products over the terms they share, -inf where they share none."""
    asked = wanted["terms"].combine_chunks()
    known = asked.flatten().dictionary_encode()
    codes = known.indices.to_numpy()
    by_term = np.argsort(codes, kind="stable")
    # The queries of each term, one after the other, with their weights.
    query = np.repeat(np.arange(len(asked)), pc.list_value_length(asked).to_numpy())[by_term]
    query_weight = wanted["weights"].combine_chunks().flatten().to_numpy()[by_term]
    begin = np.searchsorted(codes[by_term], np.arange(len(known.dictionary) + 1))
    scores = np.full((len(found), len(asked)), -np.inf)
    for at in range(0, len(found), SLICE_ROWS):
        part = found.slice(at, SLICE_ROWS)
        terms = part["terms"].combine_chunks()
        place = pc.index_in(terms.flatten(), value_set=known.dictionary)
        shared = pc.is_valid(place).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy())[shared]
        weight = part["weights"].combine_chunks().flatten().to_numpy()[shared]
        place = place.drop_null().to_numpy()
        # A posting of an item meets every query with its term.
        n = begin[place + 1] - begin[place]
        met = np.repeat(begin[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair = np.repeat(owner, n) * len(asked) + query[met]
        size = len(terms) * len(asked)
        sums = np.bincount(pair, np.repeat(weight, n) * query_weight[met], size)
        scores[at : at + len(terms)] = np.where(np.bincount(pair, minlength=size) > 0, sums, -np.inf).reshape(len(terms), -1)
    return np.round(scores, SCORE_DIGITS) + 0.0


def _best(items: DataFrame, asked: DataFrame, total: int, k: int) -> DataFrame:
    """(query_id, item_id, score): the k best items of each query in each group of items, the lower id first.

    ``items`` is (item_id, terms, weights). They and the queries are dealt to groups, and every group of one meets every
    group of the other: one plan for any number of queries, and only the best of a group leave its task.
    """
    wanted = stage(item_vectors(asked.filter(F.col("query_id").isNotNull()), "query_id"), "asked-vectors")
    size = wanted.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("terms")).first()
    parts = {
        "item_part": max(1, -(-total // GROUP_ITEMS)),
        "query_part": max(1, -(-size["n"] // GROUP_QUERIES), -(-(size["terms"] or 0) // GROUP_TERMS)),
    }

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(parts[other] - 1))).alias(other)
        return rows.select(key, "terms", "weights", _bucket(key, parts[own]).alias(own), every)

    types = {c: df.schema[c].dataType.simpleString() for df, c in ((wanted, "query_id"), (items, "item_id"))}

    def score(found: pa.Table, queries: pa.Table) -> pa.Table:
        found = found.take(pc.sort_indices(found["item_id"]))
        scores = _group_scores(found, queries)
        # A stable sort: equal scores stay in the order of the ids.
        first = np.argsort(-scores, axis=0, kind="stable")[:k]
        best = np.take_along_axis(scores, first, axis=0)
        rows, columns = np.nonzero(best > -np.inf)
        made = [queries["query_id"].take(pa.array(columns)), found["item_id"].take(pa.array(first[rows, columns]))]
        return pa.table([*made, pa.array(best[rows, columns], pa.float64())], ["query_id", "item_id", "score"])

    left = dealt(items, "item_id", "item_part", "query_part").groupBy(*parts)
    right = dealt(wanted, "query_id", "query_part", "item_part").groupBy(*parts)
    return left.cogroup(right).applyInArrow(
        score, f"query_id {types['query_id']}, item_id {types['item_id']}, score double"
    )


def _shares(asked: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """``asked`` with ``share``: blocks of a term that can add less than this need not be opened.

    The shares of a query's terms sum up to its score to reach, so an item in none of the blocks opened falls short of
    it. Terms with the most blocks keep all they can add, as far as that goes, and are not opened further; the others
    divide the rest by what they can add.
    """
    best = top_per_group(scored, ["query_id"], [F.desc("score"), F.col("item_id")], k)
    floors = best.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("_least")).select(
        "query_id", F.when(F.col("_n") == k, F.col("_least")).alias("_floor")
    )
    known = asked.join(floors, "query_id", "left").withColumn("_floor", F.coalesce("_floor", F.lit(0.0)))
    # Every item with a term of a single block has been seen: the others get nothing from it.
    known = known.withColumn("_adds", F.when(F.col("blocks") > 1, F.col("weight") * F.col("greatest")).otherwise(0.0))
    # Windows over the terms of one query.
    whole = Window.partitionBy("query_id")
    longest_first = whole.orderBy(F.desc("blocks"), "term").rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("_spent", F.sum("_adds").over(longest_first)).withColumn(
        "_closed", F.col("_spent") < F.col("_floor") - SLACK
    )
    closed = F.sum(F.when(F.col("_closed"), F.col("_adds")).otherwise(0.0)).over(whole)
    opened = F.sum(F.when(~F.col("_closed"), F.col("_adds")).otherwise(0.0)).over(whole)
    share = (F.col("_floor") - closed) * F.col("_adds") / F.when(opened > 0, opened)
    return known.withColumn("share", F.when(F.col("_closed"), F.lit(float("inf"))).otherwise(share)).drop(
        "_floor", "_adds", "_spent", "_closed"
    )


def look_up(queries: DataFrame, index: TermIndex, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(hits, opened): top-k items per query text by tf-idf cosine, and (query_id, term, seq) of the blocks opened.

    ``queries`` is (query_id, text). Hits are (query_id, rank, item_id, score), the lower id first on equal scores; a
    query gets fewer than k if fewer items share a term with it. The plan has the same joins for any number of queries.
    """
    spark = queries.sparkSession
    counted = term_counts(queries, "query_id", "text")
    terms = _only(index.terms, counted, "term", index.buckets).select("term", "idf", "blocks", "first", "greatest")
    # Terms that no item has count as the rarest, and go once the query's length is known.
    unseen = inverse_frequency(F.lit(0.0), F.lit(index.total))
    weighted = counted.join(terms, "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", unseen))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query_id")))
    asked = stage(
        weighted.withColumn("weight", F.col("w") / norm).filter(F.col("first").isNotNull()).drop("n", "w", "idf"), "asked"
    )
    blocks = _only(index.blocks, asked, "term", index.buckets).select("term", "seq", F.col("greatest").alias("_block"), "items")
    opened = asked.select("query_id", "term", F.col("first").alias("seq"))
    seen = opened.join(blocks, ["term", "seq"]).select("query_id", F.explode("items").alias("item_id")).distinct()
    first = stage(_scored(seen, asked, index), "first-scores")
    shares = stage(_shares(asked, first, k), "shares")
    reaches = (F.col("weight") * F.col("_block") >= F.col("share") - SLACK) & (F.col("seq") != F.col("first"))
    more = shares.join(blocks, "term").filter(reaches).select("query_id", "term", "seq")
    every = opened.unionByName(more)
    # Items, not pairs: one that is in a block opened by some query is scored with all of them.
    read = blocks.join(every.select("term", "seq").distinct(), ["term", "seq"], "left_semi")
    ids = stage(read.select(F.explode("items").alias("item_id")).distinct(), "opened-items")
    vectors = _only(index.vectors, ids, "item_id", index.buckets).select("item_id", "terms", "weights")
    found = _best(vectors.join(ids, "item_id", "left_semi"), asked, index.total, k)
    hits = top_per_group(found, ["query_id"], [F.desc("score"), F.col("item_id")], k)
    return hits.select("query_id", "rank", "item_id", "score"), every


def search(queries: DataFrame, items: DataFrame, k: int = 5, index: TermIndex | None = None) -> DataFrame:
    """Top-k items per query text: see ``look_up``. ``items`` is indexed first if no ``index`` is given."""
    return look_up(queries, build(items) if index is None else index, k)[0]
