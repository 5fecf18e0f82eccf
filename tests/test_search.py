"""Dense and sparse search against brute force."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseloom.functions.vectors import inner_product, l2_normalize
from clauseloom.operators import dense, inverted, sparse
from clauseloom.sources.stages import stage


def vectors(spark, matrix, name="item_id", ids=None):
    rows = [(i if ids is None else ids[i], [float(x) for x in v]) for i, v in enumerate(matrix)]
    kind = "bigint" if ids is None else "string"
    return spark.createDataFrame(rows, f"{name} {kind}, vector array<double>").repartition(5)


def brute(queries, items, k):
    scores = np.round(queries @ items.T, 6) + 0.0
    return {
        (q, rank, i, scores[q, i])
        for q in range(len(queries))
        for rank, i in enumerate(sorted(range(len(items)), key=lambda j: (-scores[q, j], j))[:k], start=1)
    }


@pytest.fixture(scope="module")
def matrices():
    rng = np.random.default_rng(3)
    items = rng.normal(size=(240, 8))
    items[::3] = items[0]  # a third are copies of one vector
    items /= np.linalg.norm(items, axis=1, keepdims=True)
    queries = rng.normal(size=(17, 8))
    return queries / np.linalg.norm(queries, axis=1, keepdims=True), items


@pytest.mark.parametrize("max_bytes", [1 << 20, 300])
def test_nearest_equals_brute_force(spark, matrices, max_bytes):
    queries, items = matrices
    hits = dense.nearest(vectors(spark, queries, "query_id"), vectors(spark, items), 7, max_bytes)
    assert rounded(hits) == brute(queries, items, 7)


def rounded(hits):
    return {(r["query_id"], r["rank"], r["item_id"], round(r["score"], 6) + 0.0) for r in hits.collect()}


def test_rows_without_a_vector_take_no_part(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "item_id bigint, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, None)], "query_id bigint, vector array<double>")
    assert rounded(dense.nearest(asked, index, 5)) == {(1, 1, 1, 1.0)}


def test_text_ids_and_k_beyond_the_index(spark, matrices):
    queries, items = matrices
    ids = [f"i{n:03d}" for n in range(4)]
    for max_bytes in (1 << 20, 1):
        asked = vectors(spark, queries[:2], "query_id")
        hits = dense.nearest(asked, vectors(spark, items[:4], ids=ids), 50, max_bytes).collect()
        assert len(hits) == 8 and {h["item_id"] for h in hits} == set(ids)


def test_empty_index_or_no_queries(spark, matrices):
    queries, items = matrices
    q, x = vectors(spark, queries, "query_id"), vectors(spark, items)
    assert dense.nearest(q, x.filter("item_id < 0")).count() == 0
    assert dense.nearest(q.filter("query_id < 0"), x).count() == 0
    assert dense.nearest(q, x.filter("item_id < 0"), max_bytes=100).count() == 0


def test_all_cells_give_the_exact_result_and_few_cells_a_part(spark, matrices):
    queries, items = matrices
    q, x = vectors(spark, queries, "query_id"), vectors(spark, items)
    model = dense.fit_cells(x, 6)
    celled = dense.assign_cells(x, model)
    exact = dense.nearest(q, x, 5)
    centres = np.array(model.clusterCenters())
    for max_bytes in (1 << 20, 300):
        every = dense.nearest_in_cells(q, celled, centres, 5, probes=6, max_bytes=max_bytes)
        assert rounded(every) == brute(queries, items, 5)
        some = dense.nearest_in_cells(q, celled, centres, 5, probes=2, max_bytes=max_bytes)
        shares = dense.recall(exact, some).collect()
        assert len(shares) == 17 and sum(s["recall"] for s in shares) / 17 > 0.5


def test_stored_cells_are_pruned(spark, matrices, tmp_path):
    queries, items = matrices
    x = vectors(spark, items)
    model = dense.fit_cells(x, 6)
    path = str(tmp_path / "cells")
    dense.assign_cells(x, model).write.partitionBy("cell").parquet(path)
    hits = dense.nearest_in_cells(vectors(spark, queries[:1], "query_id"), spark.read.parquet(path), np.array(model.clusterCenters()), 3, probes=1)
    assert "PartitionFilters: [isnotnull(cell" in hits._jdf.queryExecution().toString()
    assert hits.count() > 0


def test_zero_vector_stays_zero(spark):
    frame = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    got = frame.select(l2_normalize("v").alias("u")).select("u", inner_product("u", "u").alias("s")).collect()
    assert got[0]["u"] == [0.0, 0.0] and got[1]["u"] == pytest.approx([0.6, 0.8])
    assert [round(r["s"], 9) for r in got] == [0.0, 1.0]


def test_embedder_hook(spark):
    frame = spark.createDataFrame([("a", "xx"), ("b", "yyyy")], "item_id string, clause string")
    got = dense.embed(frame, lambda texts: np.array([[len(t), 1.0] for t in texts])).collect()
    assert {r["item_id"]: r["vector"] for r in got} == {"a": [2.0, 1.0], "b": [4.0, 1.0]}


def test_mean_vectors(spark):
    frame = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 5.0])], "k string, v array<double>")
    got = {r["k"]: r["vector"] for r in dense.mean_vectors(frame, "k", "v").collect()}
    assert got == {"a": [2.0, 3.0], "b": [5.0, 5.0]}


def test_only_new_texts_are_embedded(spark):
    rows = [(1, "old"), (2, "new"), (3, "new"), (4, "newer")]
    texts = spark.createDataFrame(rows, "item_id bigint, clause string")
    cache = spark.createDataFrame([("old",)], "t string").select(F.sha2("t", 256).alias("digest"))
    assert sorted(r["text"] for r in dense.uncached(texts, cache, "item_id").collect()) == ["new", "newer"]


def _tfidf(queries, docs):
    tokens = [re.findall(r"\w+", d.lower()) for d in docs]
    df = {}
    for t in tokens:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    n = len(docs)

    def unit(words):
        w = {x: words.count(x) * (math.log((1 + n) / (1 + df.get(x, 0))) + 1) for x in set(words)}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / norm for x, v in w.items()}

    weights = [unit(t) for t in tokens]
    out = set()
    for q, text in enumerate(queries):
        asked = unit(re.findall(r"\w+", text.lower()))
        scores = {}
        for i, w in enumerate(weights):
            shared = set(asked) & set(w)
            if shared:
                scores[f"d{i:02d}"] = round(sum(asked[x] * w[x] for x in shared), 6)
        for rank, item in enumerate(sorted(scores, key=lambda s: (-scores[s], s))[:4], start=1):
            out.add((q, rank, item))
    return out


@pytest.mark.parametrize("max_terms", [1_000, 2])
def test_text_search_equals_brute_force(spark, max_terms):
    docs = [f"the party {'shall' if i % 3 else 'may'} end item{i} notice {'the ' * (i % 4)}" for i in range(30)]
    queries = ["the party shall end", "item7 unseenword notice", "nothing matches"]
    items = spark.createDataFrame([(f"d{i:02d}", d) for i, d in enumerate(docs)], "item_id string, clause string")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
    hits = sparse.search(asked, items, 4, max_terms=max_terms)
    assert {(r["query_id"], r["rank"], r["item_id"]) for r in hits.collect()} == _tfidf(queries, docs)


def test_caps_and_thresholds(spark):
    hits = spark.createDataFrame([(1, r, 1.0 - r / 10) for r in range(1, 9)], "query_id int, rank int, score double")
    assert sparse.cap_results(hits, 20, 5).count() == 5
    assert sparse.cap_results(hits, 3, 5).count() == 3
    assert sparse.above(hits, 0.5).count() == 5


@pytest.fixture(scope="module")
def many_items(spark):
    docs = [f"the party {'shall' if i % 3 else 'may'} end item{i} notice {'the ' * (i % 4)} rare{i % 50}" for i in range(600)]
    rows = [(f"d{i:03d}", d) for i, d in enumerate(docs)]
    return docs, spark.createDataFrame(rows, "item_id string, clause string")


def test_index_search_equals_scoring_every_item_and_opens_few_blocks(spark, many_items):
    docs, items = many_items
    queries = ["the party shall end", "item7 unseenword notice", "nothing matches", "rare7 rare8 the the", "item3", "may rare1"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
    index = inverted.build(items, block=8, buckets=16)
    hits, opened = inverted.look_up(asked, index, 4)
    want = sparse.search(asked, items, 4)
    assert {tuple(r) for r in hits.collect()} == {tuple(r) for r in want.collect()}
    # All blocks of the query's terms, against those opened.
    mine = sparse.term_counts(asked, "query_id", "text").join(index.terms, "term")
    every = {r["query_id"]: r["n"] for r in mine.groupBy("query_id").agg(F.sum("blocks").alias("n")).collect()}
    used = {r["query_id"]: r["count"] for r in opened.groupBy("query_id").count().collect()}
    assert opened.distinct().count() == opened.count()
    assert used[4] == 1 and every[3] > 75 and used[3] < 10 and used[1] < every[1] / 4
    assert all(used[q] <= every[q] for q in used)


def test_index_search_scores_items_in_groups_and_handles_no_pairs(spark, many_items, monkeypatch):
    docs, items = many_items
    monkeypatch.setattr(inverted, "GROUP_ITEMS", 70)
    monkeypatch.setattr(inverted, "GROUP_QUERIES", 2)
    monkeypatch.setattr(inverted, "SLICE_ROWS", 9)
    queries = ["the party shall end", "item7 unseenword notice", "nothing matches", "rare7 rare8 the the", "party", "may rare1"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
    index = inverted.build(items, block=8, buckets=1)
    hits = inverted.search(asked, items, 4, index)
    assert {tuple(r) for r in hits.collect()} == {tuple(r) for r in sparse.search(asked, items, 4).collect()}
    # What is hashed and shuffled by query are the best of a group, never all pairs of a query and an item.
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[query_id" not in plan and "LeftAnti" not in plan
    assert inverted.search(asked.filter("query_id = 2"), items, 4, index).count() == 0
    assert inverted.search(asked.filter("query_id < 0"), items, 4, index).count() == 0


def test_index_reads_only_the_buckets_asked_for(spark, many_items):
    _, items = many_items
    index = inverted.build(items, block=8, buckets=16)
    wanted = spark.createDataFrame([("item3",)], "term string")
    read = inverted._only(index.blocks, wanted, "term", index.buckets)
    assert "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().toString().replace("[bucket", "[isnotnull(bucket")
    assert read.select("bucket").distinct().count() == 1 < index.blocks.select("bucket").distinct().count()
    assert read.filter("term = 'item3'").count() == 1
    # Postings fall within a term, and blocks hold no more than asked for.
    for r in index.blocks.collect():
        assert 0 < len(r["items"]) <= 8


def test_plans_do_not_grow_with_queries(spark, many_items):
    _, items = many_items
    index = inverted.build(items, buckets=1)
    plans = []
    for n in (2, 2_000):
        asked = spark.range(n).select(F.col("id").alias("query_id"), F.concat(F.lit("the party item"), "id").alias("text"))
        plans.append(inverted.search(asked, items, 2, index)._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert plans[0] == plans[1]
    many = spark.range(300).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.rand(3)).alias("vector"))
    vecs = spark.range(500).select(F.col("id").alias("item_id"), F.array(F.rand(5), F.lit(0.5)).alias("vector"))
    vecs, many = stage(vecs, "vectors"), stage(many, "queries")
    grouped = dense.nearest(many, vecs, 3, max_bytes=0)
    assert grouped._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
    assert {tuple(r) for r in grouped.collect()} == {tuple(r) for r in dense.nearest(many, vecs, 3).collect()}


def test_bounded_cells_give_the_exact_result_and_leave_cells_closed(spark):
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(12, 6)) * 5
    items = np.concatenate([h + rng.normal(size=(60, 6)) * 0.3 for h in heads] + [np.zeros((2, 6))])
    queries = np.concatenate([items[::90] + 0.01, rng.normal(size=(3, 6)), np.zeros((1, 6))])
    q, x = vectors(spark, queries, "query_id"), vectors(spark, items)
    celled = stage(dense.assign_to_centres(x, heads), "cells", "cell")
    hits, looks = dense.nearest_by_bound(q, celled, heads, 5, probes=1)
    assert rounded(hits) == brute(queries, items, 5)
    assert looks.distinct().count() == looks.count()
    # Queries beside an item need few of the twelve cells.
    assert looks.filter(F.col("query_id") < 8).count() < 8 * 6
    more, _ = dense.nearest_by_bound(q, celled, heads, 1_000, probes=1)
    assert more.groupBy("query_id").count().filter(F.col("count") == len(items)).count() == len(queries)
    none, _ = dense.nearest_by_bound(q.filter("query_id < 0"), celled, heads)
    assert none.count() == 0
