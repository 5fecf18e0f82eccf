"""Sketches that are stored per group and merged later: distinct counts and quantiles without reading the rows again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2^12 registers: a standard error of about 1.6 %.
REGISTERS_LOG2 = 12
# A rank error of about 1.4 % at k = 200.
QUANTILE_K = 200


def sketch(rows: DataFrame, by: Sequence[str], distinct: Column, value: Column) -> DataFrame:
    """(by…, rows, distinct, quantiles): a HyperLogLog sketch of ``distinct`` and a KLL sketch of a whole-number ``value``.

    Both are aggregated before the shuffle and have a bounded size, so a group that holds most rows is no matter. Nulls
    are left out of both. Store the result, for example with ``sources.stages.save_stage``, one partition per batch.
    """
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.hll_sketch_agg(distinct, F.lit(REGISTERS_LOG2)).alias("distinct"),
        F.kll_sketch_agg_bigint(value.cast("long"), F.lit(QUANTILE_K)).alias("quantiles"),
    )


def merge(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of coarser groups, or with no ``by`` of all; merging again what was merged is fine."""
    return sketches.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_bigint("quantiles").alias("quantiles"),
    )


def read(sketches: DataFrame, ranks: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """Rows, estimated distinct count and an array of the quantiles at ``ranks`` beside the groups.

    Quantiles of a group without a value are null.
    """
    others = [c for c in sketches.columns if c not in ("rows", "distinct", "quantiles")]
    filled = F.when(F.kll_sketch_get_n_bigint("quantiles") > 0, F.col("quantiles"))
    at = [F.kll_sketch_get_quantile_bigint(filled, F.lit(float(r))) for r in ranks]
    return sketches.select(
        *others, "rows", F.hll_sketch_estimate("distinct").alias("distinct"), F.array(*at).alias("quantiles")
    )
