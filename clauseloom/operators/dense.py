"""Dense vectors: embedding hook, exact top-k search, coarse cells, and the embedding cache.

Exact search looks at every vector once per query, so what matters is what gets moved. Queries of bounded size are
shipped to the vectors, which are neither copied nor shuffled; each task keeps its k best per query. More queries than
that meet the vectors in groups, in one plan whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.vectors import inner_product, l2_norm, l2_normalize
from clauseloom.operators.layout import top_per_group
from clauseloom.sources.stages import stage

# Bytes of query vectors that are broadcast; more of them are dealt to groups instead.
MAX_BLOCK_BYTES = 32 << 20
# Vectors and queries of one group where both are too many to ship one side.
GROUP_ITEMS, GROUP_QUERIES = 10_000, 4_000
SCORE_DIGITS = 12
_SLICE_ROWS = 2_000

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


def embed(rows: DataFrame, embedder: Embedder, key: str = "item_id", text: str = "clause") -> DataFrame:
    """Vectors of a text column by a caller-supplied embedder, called on Arrow batches inside Spark tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                vectors = [[float(x) for x in v] for v in embedder(frame[text].tolist())]
                yield pd.DataFrame({key: frame[key], "vector": vectors})

    key_type = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(run, f"{key} {key_type}, vector array<double>")


def unit_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """The index table: (item_id, vector) of unit length; rows without a vector are left out."""
    return (
        vectors.select(F.col(key).alias("item_id"), F.col(vector).cast("array<double>").alias("vector"))
        .filter(F.col("vector").isNotNull())
        .withColumn("_norm", l2_norm("vector"))
        .select("item_id", l2_normalize("vector", F.col("_norm")).alias("vector"))
    )


def mean_vectors(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """Element-wise mean vector per group: (``by``, vector). Aggregated per position, so no group is collected."""
    means = (
        vectors.select(by, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
        .groupBy(by, "pos")
        .agg(F.avg("x").alias("x"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(by).agg(F.transform(ordered, lambda e: e["x"]).alias("vector"))


def _hits(rows: list[tuple]) -> pd.DataFrame:
    # Object columns: Arrow then converts to the declared types, also when there are no rows.
    return pd.DataFrame(rows, columns=["query_id", "item_id", "score"], dtype=object)


def nearest_centres(matrix: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first: |q - c|^2 is |c|^2 - 2 q.c up to the row's own length."""
    distance = (centres * centres).sum(axis=1)[None, :] - 2.0 * (matrix @ centres.T)
    return np.argsort(distance, axis=1, kind="stable")[:, :n]


class Best:
    """The k best items so far of each query of a block; equal scores go to the lower id."""

    def __init__(self, query_ids: list, k: int) -> None:
        self.query_ids, self.k = query_ids, k
        self.best: list[list[tuple[float, object]]] = [[] for _ in query_ids]

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of some queries (by place) with some items."""
        cut = max(len(ids) - self.k, 0)
        # Rounding off the noise of summation makes equal vectors tie, whatever the order of additions.
        scores = np.round(scores, SCORE_DIGITS) + 0.0
        floor = np.partition(scores, cut, axis=1)[:, cut]
        worst = np.array([-self.best[q][-1][0] if len(self.best[q]) == self.k else -np.inf for q in queries])
        rows, columns = np.nonzero(scores >= np.maximum(floor, worst)[:, None])
        for row in np.unique(rows):
            q, new = queries[row], columns[rows == row]
            self.best[q] = sorted(self.best[q] + [(-float(scores[row, i]), ids[i]) for i in new])[: self.k]

    def rows(self) -> pd.DataFrame:
        return _hits([(qid, i, -negative) for qid, hits in zip(self.query_ids, self.best) for negative, i in hits])


def _search(
    queries: DataFrame, index: DataFrame, k: int, centres: np.ndarray | None, probes: int, max_bytes: int
) -> DataFrame:
    q = _asked(queries)
    spark = queries.sparkSession
    stored = stage(q, "queries")
    size = stored.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    if not size["n"]:
        return _none(q, index)
    if size["n"] * size["width"] * 8 > max_bytes:
        # More than may be broadcast: queries and vectors meet in groups.
        everything = index.select("item_id", "vector").withColumn("cell", F.lit(0))
        asked, items = stored.withColumn("cell", F.lit(0)), everything
        if centres is not None:
            asked, items = _probes(stored, centres, probes), index
        return _best(_meet(asked, items, k), k)
    columns = ["item_id", "vector"] + (["cell"] if centres is not None else [])
    items = index.select(*columns).filter(F.col("vector").isNotNull())
    rows = stored.collect()  # at most max_bytes
    query_ids, matrix = [r["query_id"] for r in rows], np.array([r["vector"] for r in rows], dtype=float)
    # A list of queries per cell: a cell's vectors meet those that probe it and no others.
    probed = None if centres is None else nearest_centres(matrix, centres, probes)
    asked = None if probed is None else {int(c): np.flatnonzero((probed == c).any(axis=1)) for c in np.unique(probed)}
    shared = spark.sparkContext.broadcast((query_ids, matrix, asked))
    # A table stored by cell is then read only where some query looks.
    part = items if asked is None else items.filter(F.col("cell").isin(*asked))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, block, by_cell = shared.value
        best = Best(ids, k)
        every = np.arange(len(ids))
        for frame in frames:
            groups = [(None, frame)] if by_cell is None else frame.groupby("cell")
            for cell, group in groups:
                chosen = every if by_cell is None else by_cell[int(cell)]
                _score(best, chosen, block[chosen], group)
        yield best.rows()

    return _best(part.mapInPandas(scan, _schema(q, items)), k)


def _asked(queries: DataFrame) -> DataFrame:
    vectors = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    return vectors.filter(F.col("vector").isNotNull())


def _schema(queries: DataFrame, items: DataFrame) -> str:
    types = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (items, "item_id"))}
    return f"query_id {types['query_id']}, item_id {types['item_id']}, score double"


def _none(queries: DataFrame, items: DataFrame) -> DataFrame:
    empty = queries.sparkSession.createDataFrame([], _schema(queries, items))
    return empty.select("query_id", F.lit(0).alias("rank"), "item_id", "score")


def _score(best: Best, chosen: np.ndarray, block: np.ndarray, items: pd.DataFrame) -> None:
    """Inner products of a block of queries with the vectors of a frame, in slices."""
    for at in range(0, len(items), _SLICE_ROWS):
        rows = items.iloc[at : at + _SLICE_ROWS]
        vectors = np.stack(rows["vector"].to_numpy())
        if vectors.shape[1] != block.shape[1]:
            raise ValueError(f"vectors of {vectors.shape[1]} dimensions, queries of {block.shape[1]}")
        best.add(chosen, block @ vectors.T, rows["item_id"].to_numpy())


def _best(found: DataFrame, k: int) -> DataFrame:
    order: list[Column] = [F.desc("score"), F.col("item_id")]
    return top_per_group(found, ["query_id"], order, k).select("query_id", "rank", "item_id", "score")


def _meet(asked: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, item_id, score) of each query in each group of queries and items of one cell.

    ``asked`` is (query_id, vector, cell), a row per cell that a query looks into; ``items`` is (item_id, vector,
    cell). A cell's items are dealt to parts of about ``GROUP_ITEMS`` and its queries to parts of about
    ``GROUP_QUERIES``, and every part meets every other: one plan for any number of queries, nothing on the driver, and
    no group grows with its cell.
    """
    asked, items = stage(asked, "asked"), items.select("item_id", "vector", "cell").filter(F.col("vector").isNotNull())
    item_parts = items.groupBy("cell").agg(F.ceil(F.count("*") / GROUP_ITEMS).cast("int").alias("item_parts"))
    query_parts = asked.groupBy("cell").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("query_parts"))
    # A row per cell that some query looks into.
    parts = stage(item_parts.join(query_parts, "cell"), "cell-parts")

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        spread = df.join(parts, "cell").withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int"))
        return spread.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))

    keys = ["cell", "item_part", "query_part"]
    left = dealt(items, "item_id", "item_part", "query_part").select(*keys, "item_id", "vector")
    right = dealt(asked, "query_id", "query_part", "item_part").select(*keys, "query_id", "vector")

    def score(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        best = Best(wanted["query_id"].tolist(), k)
        if len(found) and len(wanted):
            _score(best, np.arange(len(wanted)), np.stack(wanted["vector"].to_numpy()), found)
        return best.rows()

    groups = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    return groups.applyInPandas(score, _schema(asked, items))


def _probes(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(query_id, vector, cell): a row for each of the ``probes`` cells with the nearest centres."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                near = nearest_centres(np.stack(frame["vector"].to_numpy()), centres, probes)
                yield frame.assign(cell=near.tolist())

    key = queries.schema["query_id"].dataType.simpleString()
    listed = queries.mapInPandas(run, f"query_id {key}, vector array<double>, cell array<int>")
    return listed.select("query_id", "vector", F.explode("cell").alias("cell"))


def nearest(queries: DataFrame, index: DataFrame, k: int = 5, max_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """Exact top-k by inner product: (query_id, rank, item_id, score), the lower id first on equal scores.

    ``queries`` is (query_id, vector), ``index`` is (item_id, vector); rows without a vector take no part. An index
    with fewer than ``k`` rows gives fewer hits; an empty one gives none.
    """
    return _search(queries, index, k, None, 0, max_bytes)


def fit_cells(index: DataFrame, cells: int, seed: int = 7) -> KMeansModel:
    """Cluster the index into coarse cells."""
    points = index.select(array_to_vector("vector").alias("point"))
    return KMeans(k=cells, seed=seed, featuresCol="point", predictionCol="cell", maxIter=20).fit(points)


def assign_cells(index: DataFrame, model: KMeansModel) -> DataFrame:
    """Add the ``cell`` of each vector. Write the table with ``partitionBy("cell")`` to prune reads later."""
    return model.transform(index.withColumn("point", array_to_vector("vector"))).drop("point")


def assign_to_centres(index: DataFrame, centres: np.ndarray) -> DataFrame:
    """Add the ``cell`` of each vector: the place of its nearest centre, the first of equally near ones."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    lengths = [float((c * c).sum()) for c in centres]
    distances = F.transform(
        table, lambda c, i: F.get(F.array(*[F.lit(n) for n in lengths]), i) - 2 * inner_product("vector", c)
    )
    with_distances = index.withColumn("_distances", distances)
    return with_distances.withColumn(
        "cell", (F.array_position("_distances", F.array_min("_distances")) - 1).cast("int")
    ).drop("_distances")


def nearest_in_cells(
    queries: DataFrame, celled: DataFrame, centres: np.ndarray, k: int = 5, probes: int = 2,
    max_bytes: int = MAX_BLOCK_BYTES,
) -> DataFrame:
    """Approximate top-k: only vectors in the ``probes`` cells nearest to each query are scored.

    ``centres`` holds the centre of cell 0, 1, … . Vectors are not shuffled by cell, so a cell that holds a third of
    them is scanned by many tasks like any other; inside a task each cell is multiplied with its own queries only.
    """
    return _search(queries, celled, k, np.asarray(centres, dtype=float), probes, max_bytes)


def cell_caps(celled: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cell, least_cosine, least_norm, greatest_norm, members): how far a cell's vectors lie from its centre's direction.

    One row per cell. Store it beside the cells: it is all that a search needs to know which of them to read.
    """
    directions = [c / n if (n := float(np.linalg.norm(c))) else c for c in np.asarray(centres, dtype=float)]
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in directions])
    norm = l2_norm("vector")
    cosine = inner_product("vector", F.get(table, F.col("cell"))) / F.when(norm > 0, norm)
    placed = celled.filter(F.col("vector").isNotNull()).select("cell", norm.alias("_norm"), cosine.alias("_cosine"))
    return placed.groupBy("cell").agg(
        F.least(F.lit(1.0), F.coalesce(F.min("_cosine"), F.lit(1.0))).alias("least_cosine"), F.min("_norm").alias("least_norm"),
        F.max("_norm").alias("greatest_norm"), F.count("*").alias("members"),
    )


class Caps:
    """Upper bounds of inner products with the vectors of each cell.

    A vector at an angle of at most a from the cell's direction is at an angle of at least b - a from a query that is at
    an angle of b; its length lies between the cell's least and greatest.
    """

    def __init__(self, rows: list, centres: np.ndarray) -> None:
        self.cells = np.array([r["cell"] for r in rows], dtype=int)
        chosen = np.asarray(centres, dtype=float)[self.cells]
        lengths = np.linalg.norm(chosen, axis=1, keepdims=True)
        self.directions = np.divide(chosen, lengths, out=np.zeros_like(chosen), where=lengths > 0)
        # A centre of no length has no direction: its cell is bounded by lengths alone.
        self.angles = np.where(lengths[:, 0] > 0, np.arccos(np.clip([r["least_cosine"] for r in rows], -1, 1)), np.pi)
        self.least = np.array([r["least_norm"] for r in rows])
        self.greatest = np.array([r["greatest_norm"] for r in rows])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Queries by cells."""
        lengths = np.linalg.norm(queries, axis=1, keepdims=True)
        cosines = np.divide(queries @ self.directions.T, lengths, out=np.zeros((len(queries), len(self.cells))), where=lengths > 0)
        nearest = np.cos(np.maximum(np.arccos(np.clip(cosines, -1, 1)) - self.angles, 0.0))
        # Rounding must not close a cell: allow for it.
        return lengths * np.where(nearest > 0, nearest * self.greatest, nearest * self.least) + 1e-9


def _looks(queries: DataFrame, caps: Caps, probes: int, rest: bool) -> DataFrame:
    """(query_id, vector, cell): the ``probes`` cells of greatest bound; or the ``rest`` that can still hold a hit.

    With ``rest`` the queries carry ``floor``, the score that a hit has to reach.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            bounds = caps.bounds(np.stack(frame["vector"].to_numpy()))
            order = np.argsort(-bounds, axis=1, kind="stable")
            cells = [
                caps.cells[o[probes:][b[o[probes:]] >= f] if rest else o[:probes]].tolist()
                for o, b, f in zip(order, bounds, frame["floor"] if rest else bounds[:, 0])
            ]
            yield frame[["query_id", "vector"]].assign(cell=cells)

    key = queries.schema["query_id"].dataType.simpleString()
    listed = queries.mapInPandas(run, f"query_id {key}, vector array<double>, cell array<int>")
    return listed.select("query_id", "vector", F.explode("cell").alias("cell"))


def _in_cells(looks: DataFrame, celled: DataFrame, k: int) -> DataFrame:
    """Hits in the cells looked into; a table stored by cell is read there only."""
    looks = stage(looks, "looks")
    cells = [r["cell"] for r in looks.select("cell").distinct().collect()]  # at most one row per cell
    return _meet(looks, celled.filter(F.col("cell").isin(cells)), k)


def nearest_by_bound(
    queries: DataFrame, celled: DataFrame, centres: np.ndarray, k: int = 5, probes: int = 2, caps: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(hits, looks): exact top-k from cells, and the cells (query_id, cell) that were opened for each query.

    Each query first looks into the ``probes`` cells with the greatest upper bounds. Its k-th best score there is the
    score to reach, and of the other cells only those are opened whose bound (see ``Caps``) reaches it; so the hits are
    those of an exact search, ties to the lower id included. ``celled`` is (item_id, vector, cell), best written with
    ``partitionBy("cell")``; ``caps`` is its stored ``cell_caps``. ``centres`` and caps are a row per cell.
    """
    centres = np.asarray(centres, dtype=float)
    rows = (cell_caps(celled, centres) if caps is None else caps).collect()
    asked = stage(_asked(queries), "queries")
    if not rows or asked.isEmpty():
        return _none(asked, celled), asked.select("query_id", F.lit(0).alias("cell")).limit(0)
    bounds = Caps(rows, centres)
    first = stage(_looks(asked, bounds, probes, rest=False), "looks")
    found = stage(_best(_in_cells(first, celled, k), k), "first-hits")
    floors = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).select(
        "query_id", F.when(F.col("n") == k, F.col("least")).alias("floor")
    )
    known = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    second = stage(_looks(known, bounds, probes, rest=True), "looks")
    hits = found.drop("rank").unionByName(_in_cells(second, celled, k))
    return _best(hits, k), first.select("query_id", "cell").unionByName(second.select("query_id", "cell"))


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Per query: exact hits and how many of them the approximate search found."""
    found = approximate.select("query_id", "item_id", F.lit(1).alias("f"))
    return (
        exact.join(found, ["query_id", "item_id"], "left")
        .groupBy("query_id")
        .agg(F.count("*").alias("hits"), F.count("f").alias("found"))
        .withColumn("recall", F.round(F.col("found") / F.col("hits"), 6))
    )


def uncached(texts: DataFrame, cache: DataFrame, key: str, text: str = "clause") -> DataFrame:
    """Distinct texts, by digest, that the cache (``digest``, …) does not hold: the ones still to embed.

    Digests are folded to the lowest ``key`` and compared first; only the texts of the keys that remain are fetched.
    A cache far larger than the texts is read but not shuffled: its digests pass a semi-join with those asked for.
    """
    folded = texts.select(F.sha2(text, 256).alias("digest"), key).groupBy("digest").agg(F.min(key).alias(key))
    held = cache.select("digest").join(folded.select("digest"), "digest", "left_semi")
    new = folded.join(held, "digest", "left_anti")
    return texts.select(key, F.col(text).alias("text")).join(new, key).select("digest", "text")
