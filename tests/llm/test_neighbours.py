"""Approximate nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from clauseloom.llm import neighbours


def _brute(rows, k=5):
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    for q in np.flatnonzero(ids % 50 == 0):
        scores = unit @ unit[q]
        others = np.flatnonzero(ids != ids[q])
        best = others[np.lexsort((ids[others], -scores[others]))][:k]
        yield ids[q], ids[best].tolist(), scores[best].tolist()


@pytest.mark.parametrize("shard, block", [(60_000, 4_000), (150, 3)])
def test_recall_and_scores(spark, sf_dir, shard, block):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = neighbours.nearest(table, shard=shard, block=block).toPandas()
    right = 0
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    vectors = dict(rows)
    for query, ids, scores in _brute(rows):
        own = found[found.query_id == query].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5]
        assert own.score.tolist() == sorted(own.score, reverse=True)
        right += len(set(own.vec_id) & set(ids))
        a = np.array(vectors[query])
        for i, s in zip(own.vec_id, own.score):
            b = np.array(vectors[i])
            assert math.isclose(s, a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), rel_tol=1e-12)
    assert right >= 0.9 * len(found)


def test_shards_meet_blocks_in_many_partitions(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = neighbours.nearest(table, shard=100, block=4).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    right = 0
    for query, ids, _ in _brute([(r.vec_id, r.embedding) for r in table.collect()]):
        right += len(set(found[found.query_id == query].vec_id) & set(ids))
    assert len(found) == 50 and right >= 45


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [5.0, 0.0]), (1, [0.0, 1.0]), (50, [0.0, 0.0]), (100, None), (4, [float("nan"), 1.0]),
            (5, [None, 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0, 0.0]), (0, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.nearest(table.selectExpr("*", "1 AS width", "2 AS shard", "3 AS rank")).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [
        (0, 1, 0, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0), (0, 4, 1, 0.0)  # the other row with the query's vec_id first
    ]
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_many_equal_vectors_tie_by_id(spark):
    table = spark.range(600).selectExpr("id AS vec_id", "array(1.0f, 2.0f, 3.0f) AS embedding")
    found = neighbours.nearest(table, shard=100).collect()
    for r in found:
        expected = [i for i in range(6) if i != r.query_id][r["rank"] - 1]
        assert r.vec_id == expected and math.isclose(r.score, 1.0)
    assert len(found) == 12 * 5


def test_chi_square():
    assert neighbours.chi_square_cdf(9.342, 8) == pytest.approx(0.6857, abs=2e-3)
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def test_tree_bounds_hold():
    points = np.random.default_rng(1).standard_normal((3_000, 4))
    tree = neighbours.KdTree(points, leaf=32)
    assert sorted(tree.order) == list(range(3_000))
    query = np.ones(4)
    for node, (start, end) in enumerate(tree.span):
        gaps = ((points[tree.order[start:end]] - query) ** 2).sum(axis=1)
        assert tree.distances(query)[node] <= gaps.min() + 1e-12


def test_a_repeated_id_is_spread_over_shards(spark):
    rows = spark.range(3_000).selectExpr("IF(id < 1000, 7, id) AS vec_id", "id AS row", "array(1.0D, id) AS embedding")
    sizes = [r["count"] for r in neighbours.in_shards(rows, 10).groupBy("shard").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 450


def test_the_least_vector_of_a_repeated_query_asks(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    for given in (rows, rows[::-1]):
        table = spark.createDataFrame(given, "vec_id long, embedding array<double>").coalesce(1)
        found = neighbours.nearest(table).collect()
        assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == [2, 1, 50]


def test_tiny_and_huge_entries_have_a_direction(spark):
    rows = [(0, [1e-200, 1e-200]), (1, [3e200, 3e200]), (2, [1e-310, 0.0]), (3, [-1e300, -1e300])]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == [1, 2, 3]
    assert [round(r.score, 9) for r in sorted(found, key=lambda r: r["rank"])] == [1.0, round(0.5**0.5, 9), -1.0]
