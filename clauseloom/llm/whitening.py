"""Whitening of embeddings by a weighted covariance: equal vectors are one row with a weight, whitened once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import batch, require_columns, stage

COMPONENTS = 16
# Entries become whole numbers: steps to the unit, and what keeps them positive.
SCALE, SHIFT = 64, 1_000_000
# Vectors that one matrix product takes.
SLICE_ROWS = 8_192
OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

_LARGEST = (1 << 63) - 1


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(at, SLICE_ROWS)


def _sums(table: DataFrame, column: str, weight: str, kind: str) -> list:
    """Weighted sums of each position, one partial row per position and task, added up by Spark."""
    schema = pa.schema([("pos", pa.int32()), ("total", pa.int64() if kind == "long" else pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in _slices(batches):
            part = b[weight].to_numpy() @ _matrix(b[column])
            total = part if total is None else total + part
        if total is not None:
            yield batch(schema, {"pos": np.arange(len(total)), "total": total})

    parts = table.select(weight, column).mapInArrow(run, f"pos int, total {kind}")
    # One row per dimension.
    rows = parts.groupBy("pos").agg(F.sum("total").alias("total")).collect()
    return [r["total"] for r in sorted(rows, key=lambda r: r["pos"])]


def _covariance(
    table: DataFrame, column: str, weight: str, n: int, centred: Callable[[np.ndarray], np.ndarray], width: int
) -> np.ndarray:
    """Sum of weight * row * row' over centred rows, by n: a product of matrices per slice, partials added by Spark."""
    schema = pa.schema([("i", pa.int32()), ("products", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in _slices(batches):
            rows = centred(_matrix(b[column]))
            total += rows.T @ (b[weight].to_numpy()[:, None] * rows)
        yield batch(schema, {"i": np.arange(width), "products": total.tolist()})

    parts = table.select(weight, column).mapInArrow(run, "i int, products array<double>")
    # One number per pair of dimensions.
    rows = parts.select("i", F.posexplode("products").alias("j", "p")).groupBy("i", "j").agg(F.sum("p").alias("p")).collect()
    out = np.zeros((width, width))
    for r in rows:
        out[r["i"], r["j"]] = r["p"] / n
    return (out + out.T) / 2


def grid_vectors(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors as whole numbers; null ones and ones with null or non-finite entries are left out."""
    require_columns(embeddings, "vec_id", vector)
    given = F.col(vector).cast("array<double>")

    def finite(c: F.Column) -> F.Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    # Nulls are blanked before the arithmetic: the filter alone does not say what is evaluated first.
    whole = F.transform(given, lambda c: F.when(finite(c), F.floor(F.lit(SCALE) * c) + SHIFT))
    return (
        embeddings.filter(F.col(vector).isNotNull() & F.forall(given, lambda c: finite(c)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("x"))
        .filter(F.size("x") > 0)
    )


def whiten(
    embeddings: DataFrame, components: int = COMPONENTS, by_count: bool = False, vector: str = "embedding"
) -> DataFrame:
    """Whitened components, one row per vector and component: see ``OUTPUT``.

    A vector c becomes whole numbers x = floor(64 c) + 1000000. The fit list holds each distinct x once or, with
    ``by_count``, as often as rows have it; ``n`` is its length. ``deviation`` is the exact sum of (n x - S)^2 over
    dimensions, S the sum of the fit list (more than 2^63 - 1 is an error, not another number). Components are the
    eigenvectors of the fit list's covariance by falling eigenvalue e, at most ``components`` and the dimension;
    ``whitened`` is the projection of x - S/n over sqrt(e), ``explained`` e over the trace, ``identity_error`` the
    largest entry by which the covariance of what was whitened differs from the identity.

    Vectors that are null, empty, or hold null, NaN or infinite entries give no rows. A component without variance
    (all vectors equal, fewer vectors than dimensions) cannot be scaled: its ``whitened`` is null and it takes no part
    in ``identity_error``, which is null if none is left. Rows that repeat a vec_id, or have none, are rows of
    their own. Vectors of different dimensions are an error. Other columns are ignored, an empty table gives no rows.

    Equal vectors are folded before anything is shuffled; sums, products and projections are taken over distinct
    vectors, and only the sums (one per dimension) and products (one per pair of dimensions) reach the driver.
    """
    if components < 1:
        raise ValueError("components must be at least 1")
    spark = embeddings.sparkSession
    rows = grid_vectors(embeddings, vector)
    weight = F.count("*") if by_count else F.lit(1).cast("long")
    distinct = stage(
        rows.groupBy("x").agg(weight.alias("weight")).withColumn("entry", F.monotonically_increasing_id()), "distinct-vectors"
    )
    size = distinct.agg(F.sum("weight").alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if not size["n"]:
        return spark.createDataFrame([], OUTPUT)
    if size["low"] != size["high"]:
        raise ValueError(f"vectors of {size['low']} and of {size['high']} dimensions")
    n, width = int(size["n"]), int(size["high"])
    sums = np.array(_sums(distinct, "x", "weight", "long"), np.int64)

    def deviations(x: np.ndarray) -> np.ndarray:
        """n x - S, exact: within 64 bits as long as n times an entry is."""
        if n > _LARGEST // (2 * max(1, int(x.max(initial=1)), -int(x.min(initial=0)))):
            raise OverflowError("n times an entry is beyond 64 bits")
        return n * x - sums

    covariance = _covariance(distinct, "x", "weight", n, lambda x: deviations(x) / n, width)
    values, vectors = np.linalg.eigh(covariance)
    kept = min(components, width)
    values, vectors = values[::-1][:kept], vectors[:, ::-1][:, :kept]
    trace = float(np.trace(covariance))
    # What is left of an eigenvalue of zero after rounding.
    live = values > max(trace, 0.0) * width * np.finfo(float).eps
    scaled = vectors[:, live] / np.sqrt(values[live])
    schema = pa.schema([("entry", pa.int64()), ("weight", pa.int64()), ("deviation", pa.int64()), ("live", pa.list_(pa.float64()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            apart = deviations(_matrix(b["x"]))
            top = int(np.abs(apart).max(initial=0))
            # Squares that might leave 64 bits are added as Python's integers.
            exact = apart if top * top * width <= _LARGEST else apart.astype(object)
            squares = (exact * exact).sum(axis=1)
            yield batch(
                schema,
                {"entry": b["entry"], "weight": b["weight"], "deviation": squares.tolist(), "live": ((apart / n) @ scaled).tolist()},
            )

    done = stage(
        distinct.select("entry", "weight", "x").mapInArrow(project, "entry long, weight long, deviation long, live array<double>"),
        "whitened",
    )
    width_live = int(live.sum())
    error = None
    if width_live:
        means = np.array(_sums(done, "live", "weight", "double")) / n
        again = _covariance(done, "live", "weight", n, lambda rows: rows - means, width_live)
        error = float(np.abs(again - np.eye(width_live)).max())
    explained = [float(v / trace) if trace > 0 else 0.0 for v in np.maximum(values, 0.0)]
    place = np.cumsum(live) - 1
    columns = F.array(*[
        F.struct(
            F.lit(i + 1).alias("component"),
            (F.get("live", F.lit(int(place[i]))) if live[i] else F.lit(None).cast("double")).alias("whitened"),
            F.lit(explained[i]).alias("explained"),
        )
        for i in range(kept)
    ])
    table = distinct.select("x", "entry").join(done.select("entry", "deviation", "live"), "entry")
    # The short hash goes first: whole vectors are compared only where it agrees.
    joined = rows.withColumn("_key", F.xxhash64("x")).join(table.withColumn("_key", F.xxhash64("x")), ["_key", "x"])
    return joined.select("vec_id", "deviation", F.inline(columns)).select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
