"""Whitening against a plain version in NumPy and exact integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseloom.llm import whitening


def _check(df, rows, by_count=False, components=16):
    """The result of whole rows against NumPy: exact integers, projections up to the sign of a component."""
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    grid = [(i, tuple(int(np.floor(64 * float(x))) + 1_000_000 for x in v)) for i, v in good]
    fit = [x for _, x in grid] if by_count else sorted({x for _, x in grid})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = df.collect()
    width = min(components, len(sums))
    assert len(found) == len(grid) * width
    assert {r.n for r in found} == {n}
    deviation = {}
    for i, x in grid:
        deviation.setdefault(i, set()).add(sum((n * a - s) ** 2 for a, s in zip(x, sums)))
    assert all(r.deviation in deviation[r.vec_id] for r in found)
    by_row = {}
    for r in found:
        by_row.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    signs = {}
    for i, x in grid:
        own = np.array([(n * a - s) / n for a, s in zip(x, sums)])
        mine = by_row[i, sum((n * a - s) ** 2 for a, s in zip(x, sums))]
        for c in range(width):
            r = mine[c + 1]
            assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-4)
            want = own @ vectors[:, c] / np.sqrt(values[c])
            if abs(want) > 1e-6:
                signs.setdefault(c, set()).add(np.sign(want) == np.sign(r.whitened))
            assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-6)
            assert r.identity_error < 1e-4
    assert all(len(s) == 1 for s in signs.values())


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    rows = [(n, [float(x) for x in rng.normal(0, [1, 2, 3, 4, 5])]) for n in range(200)]
    rows += [(300 + n, rows[0][1]) for n in range(150)]  # one vector holds a large share
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0]), (402, [float("nan")] * 5), (403, [float("-inf")] + [0.0] * 4)]
    rows += [(None, [0.5] * 5), (7, [-3.0, 0.0, 9.0, 1.0, 2.0])]
    return rows


def _frame(spark, rows):
    clash = {c: F.lit("x") for c in ("x", "n", "entry", "weight", "component", "deviation", "live", "_key")}
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(clash)


@pytest.mark.parametrize("by_count", [False, True])
def test_whitening_equals_plain_version(spark, vectors, by_count):
    _check(whitening.whiten(_frame(spark, vectors), by_count=by_count), vectors, by_count)


def test_given_table(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    _check(whitening.whiten(given), [tuple(r) for r in given.collect()])


def test_components_without_variance(spark):
    rows = [(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [4.0, 5.0])]
    found = whitening.whiten(_frame(spark, rows)).collect()
    assert sorted((r.vec_id, r.component) for r in found if r.whitened is None) == [(1, 2), (2, 2), (3, 2)]
    assert all(r.identity_error < 1e-9 for r in found)
    same = whitening.whiten(_frame(spark, [(1, [1.0, 5.0]), (2, [1.0, 5.0])])).collect()
    assert [(r.whitened, r.identity_error, r.deviation, r.n) for r in same] == [(None, None, 0, 1)] * 4


def test_empty_tables_and_bad_shapes(spark):
    assert whitening.whiten(_frame(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(_frame(spark, [(1, None)]).limit(0)).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    ]
    with pytest.raises(ValueError, match="dimensions"):
        whitening.whiten(_frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
