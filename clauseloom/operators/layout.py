"""How rows are laid out over tasks: spreading small scans, numbering rows, joining on hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.sources.stages import stage


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a scan that has fewer partitions than the cluster has cores.

    Regex work per row is what costs here, so a file with one row group would keep a single core busy. A table that
    already fills the cluster is returned as it is: no shuffle of the text is added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def row_barrier(df: DataFrame, *columns: str) -> DataFrame:
    """Keep later filters on ``columns`` above the projection that computes them.

    Without it the optimizer copies an expensive expression into the filter and evaluates it twice per row.
    """
    packed = F.array(F.struct(*[F.col(c) for c in columns]))
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.inline(packed)).select(*df.columns)


def number_rows(df: DataFrame, order_by: Sequence[str], name: str = "row_no") -> DataFrame:
    """Number all rows 1, 2, 3, … in the order of ``order_by`` without sorting them in one task.

    Rows are dealt by ranges of the key, as many as shuffles have partitions, sorted inside each and stored with their
    place there; a row's number is its place plus the sizes of the ranges before it. ``order_by`` should end in a unique
    column: it makes the numbers repeatable and keeps a frequent leading value from filling one range.
    """
    sorted_ranges = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    # The generated id counts from 0 inside each partition, in its lower 33 bits.
    placed = stage(
        sorted_ranges.withColumn("_at", F.monotonically_increasing_id()).select(
            "*", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")
        ).drop("_at"),
        "numbered",
    )
    # One row per range, at most one per shuffle partition.
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_before") + F.col("_place") + 1)
        .drop("_range", "_place", "_before")
    )


def frequent(counts: DataFrame, by: str, limit: int) -> DataFrame:
    """Rows of a per-key table whose count ``by`` is at least 1/``limit`` of the sum of all counts.

    There can be at most ``limit`` of them, so the result may be broadcast, and a key left out holds less than that
    share of all rows. A filter finds them: no sort, no single task.
    """
    return counts.filter(F.col(by) * limit >= counts.agg(F.sum(by)).scalar())


def lookup_join(left: DataFrame, right: DataFrame, on: str, by: str, limit: int = 100_000, how: str = "inner") -> DataFrame:
    """Add the columns of ``right``, which holds each key once with its count ``by``, to the rows of ``left``.

    The frequent keys, at most ``limit``, are broadcast: their rows, which are most rows when keys are words, stay
    where they are and no hot key is ever shuffled. Only rows with rare keys are shuffled to the rest of ``right``.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    # Stored, so that the work behind ``left`` is done once for both kinds of keys.
    looked_up = stage(left.join(F.broadcast(frequent(right, by, limit).withColumn("_found", F.lit(True))), on, "left"), "lookup")
    columns = [on, *[c for c in left.columns if c != on], *[c for c in right.columns if c != on]]
    near = looked_up.filter(F.col("_found")).select(*columns)
    rest = looked_up.filter(F.col("_found").isNull()).select(*left.columns)
    return near.unionByName(rest.join(right, on, how).select(*columns))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group.

    Spark ranks inside each map partition first and ships at most ``k`` rows per group and partition, so one large
    group does not pass through one task.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
