"""Approximate nearest neighbours: stable projections in a kd-tree, verified until a chi-square test holds."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import require_columns, stage

K = 5
EVERY = 50
# Projected dimensions (even, for the closed form of the test), and the chance with which a neighbour is found.
PROJECTED, CONFIDENCE, SEED = 8, 0.97, 7
LEAF = 512
# Far more than two ways to compute a cosine in double precision differ by.
ROUNDING = 1e-9
# Vectors that one task indexes, and queries that it answers.
SHARD, BLOCK = 10_000, 2_000

_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def chi_square_cdf(x: float, degrees: int) -> float:
    """Distribution of a sum of ``degrees`` (even) squared standard normals."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, degrees) < p:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, degrees) < p else (low, middle)
    return high


def projection(dimensions: int, projected: int = PROJECTED, seed: int = SEED) -> np.ndarray:
    """A matrix of standard normals: squared lengths under it are the true ones times a chi-square variable."""
    return np.random.default_rng([seed, dimensions]).standard_normal((dimensions, projected))


class KdTree:
    """A kd-tree of points: nodes split at the median of their widest side; boxes are tight."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        pending = [(0, len(points), -1, 0)]
        while pending:
            start, end, parent, side = pending.pop()
            own = points[self.order[start:end]]
            node = len(self.span)
            low, high = own.min(axis=0), own.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.span.append((start, end))
            self.children.append(None)
            if parent >= 0:
                pair = self.children[parent] or (0, 0)
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            axis = int(np.argmax(high - low))
            if end - start > leaf and high[axis] > low[axis]:
                middle = (end - start) // 2
                self.order[start:end] = self.order[start:end][np.argpartition(own[:, axis], middle)]
                pending += [(start, start + middle, node, 0), (start + middle, end, node, 1)]
        self.lows, self.highs = np.array(self.low), np.array(self.high)

    def distances(self, point: np.ndarray) -> list[float]:
        """Squared distance of a point to the box of every node."""
        gap = np.maximum(np.maximum(self.lows - point, point - self.highs), 0.0)
        return (gap * gap).sum(axis=1).tolist()


class Shard:
    """An index over some vectors."""

    def __init__(
        self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, projected: int = PROJECTED, seed: int = SEED
    ) -> None:
        self.matrix = projection(vectors.shape[1], projected, seed)
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        points = (vectors / lengths[:, None]) @ self.matrix
        self.tree = KdTree(points)
        order = self.tree.order
        self.ids, self.rows = ids[order], rows[order]
        self.vectors, self.lengths, self.points = vectors[order], lengths[order], points[order]
        self.units = self.vectors / self.lengths[:, None]

    def nearest(self, own_row: int, query: np.ndarray, k: int, quantile: float) -> list[tuple[float, int]]:
        """(score, vec_id) of the ``k`` nearest found, best first; equal scores by smaller id.

        Tree nodes are opened in the order of their projected distance. All vectors not yet seen are projected at
        least as far as the next node; when that distance, squared, exceeds the ``quantile`` times the squared
        distance of the k-th best, a vector nearer than that is left out with a small chance only, and the search ends.
        """
        length = math.sqrt(float((query * query).sum()))
        unit = query / length
        point = unit @ self.matrix
        lower, spans, children = self.tree.distances(point), self.tree.span, self.tree.children
        best: list[tuple[float, int]] = []  # a heap, worst first
        queue, bound = [(lower[0], 0)], math.inf
        while queue:
            reached, node = heapq.heappop(queue)
            if reached > bound:
                break
            if children[node] is not None:
                for child in children[node]:
                    if lower[child] <= bound:
                        heapq.heappush(queue, (lower[child], child))
                continue
            start, end = spans[node]
            gap = self.points[start:end] - point
            within = np.einsum("ij,ij->i", gap, gap) <= bound
            if len(best) == k:
                # A product of matrices is quick, but its last digits depend on a vector's place: what it leaves below
                # the k-th best by more than rounding can explain is not scored.
                within &= self.units[start:end] @ unit >= best[0][0] - ROUNDING
            near = np.flatnonzero(within) + start
            if not len(near):
                continue
            scores = (self.vectors[near] * query).sum(axis=1) / (self.lengths[near] * length)
            ids = self.ids[near]
            useful = self.rows[near] != own_row
            if len(best) == k:
                useful &= scores >= best[0][0]
            for score, vec_id in zip(scores[useful].tolist(), (-ids[useful]).tolist()):
                if len(best) < k:
                    heapq.heappush(best, (score, vec_id))
                elif (score, vec_id) > best[0]:
                    heapq.heapreplace(best, (score, vec_id))
            if len(best) == k:
                # On unit vectors the squared distance is 2 - 2 cos; the last term keeps equal vectors in.
                bound = quantile * max(0.0, 2.0 - 2.0 * best[0][0]) + 1e-9
        return [(score, -vec_id) for score, vec_id in sorted(best, reverse=True)]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.chunked_array(column.chunks, column.type).combine_chunks().flatten()
    rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # By a power of two, so exactly: squares of very small or large entries then stay within range, and cosines the same.
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0.0))[1][:, None])


def _search(k: int, projected: int, confidence: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if vectors.num_rows and queries.num_rows:
            shard = Shard(vectors["vec_id"].to_numpy(), vectors["row"].to_numpy(), _matrix(vectors["embedding"]), projected)
            quantile = chi_square_quantile(confidence, projected)
            asked = zip(queries["query_id"].to_pylist(), queries["row"].to_pylist(), _matrix(queries["embedding"]))
            for query_id, row, query in asked:
                out += [(query_id, i, s) for s, i in shard.nearest(row, query, k, quantile)]
        columns = zip(*out) if out else ([], [], [])
        return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding as doubles) with an id and a vector that has a direction: finite, without nulls, not zero."""
    require_columns(embeddings, "vec_id", "embedding")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & some)


def in_shards(rows: DataFrame, shards: int) -> DataFrame:
    """The stored rows with the ``shard`` each is dealt to; the salt keeps a repeated vec_id from filling one."""
    salt = F.col("row") % 1_024
    # Both sides need keys of one type: a cogroup hashes them as they are.
    return rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", salt), F.lit(shards)).cast("int"))


def nearest(
    embeddings: DataFrame, k: int = K, every: int = EVERY, projected: int = PROJECTED, confidence: float = CONFIDENCE,
    shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every vec_id divisible by ``every`` its ``k`` nearest rows by cosine.

    Nearest first, ties to the smaller vec_id, fewer than ``k`` if there are fewer. A query's own row is no candidate;
    other rows, also those that share its vec_id, are candidates each. Of repeated query rows the one with
    the least vector asks. Rows without vec_id, and null,
    zero or non-finite vectors, take no part; vectors of different length are not compared. Other columns are ignored.

    Vectors are dealt by a hash of the id and a salt into shards of about ``shard``, queries into blocks of about ``block``, and
    each shard meets each block in one task of bounded size, whatever the number of rows: equal vectors spread over
    all shards. Only the k best per query and shard go on.
    """
    rows = stage(usable(embeddings).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asks = F.min(F.struct("embedding", "row")).alias("_least")
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(asks).select("vec_id", "_least.*")
    counts = rows.agg(F.count("*"), F.sum((F.col("vec_id") % every == 0).cast("long"))).first()
    shards, blocks = max(1, -(-counts[0] // shard)), max(1, -(-(counts[1] or 0) // block))

    def dealt(frame: DataFrame, own: str, other: str, n_other: int) -> DataFrame:
        """Each row in one part of its own kind, and a copy for every part of the other kind."""
        copies = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
        return frame.select("vec_id", "row", "embedding", F.size("embedding").alias("width"), own, copies)

    keys = ("width", "shard", "block")
    left = dealt(in_shards(rows, shards), "shard", "block", blocks)
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    right = dealt(asked, "block", "shard", shards).withColumnRenamed("vec_id", "query_id")
    found = left.groupBy(*keys).cogroup(right.select("query_id", "row", "embedding", *keys).groupBy(*keys)).applyInArrow(
        _search(k, projected, confidence), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
