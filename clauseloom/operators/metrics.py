"""Reports: load funnel, detection, success, quality, tokens, rates and distributions.

Reports aggregate the wide table directly: one partial sum per clause column and map task, then a tiny final step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from clauseloom.functions import text as T
from clauseloom.taxonomy import CLAUSE_TYPES


def load_funnel(screened: DataFrame) -> DataFrame:
    """Documents per outcome: ``loaded`` or the reason for rejection."""
    return screened.groupBy(F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(
        F.count("*").alias("documents")
    )


def observed_funnel(screened: DataFrame, reasons: Sequence[str]) -> tuple[DataFrame, Observation]:
    """The table itself, and counts of ``loaded`` and of each reason that are there once it has been written.

    They are taken while the rows pass. Observe right before the write: its tasks count once each, however often
    executors are lost.
    """
    counts = Observation()
    columns = [F.count_if(F.col("reason").isNull()).alias("loaded")]
    columns += [F.count_if(F.col("reason").eqNullSafe(F.lit(r))).alias(r) for r in reasons]
    return screened.observe(counts, *columns), counts


def found_counts(wide: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group and clause type: contracts seen and contracts with the clause. One row per contract goes in."""
    counts = wide.groupBy(*by).agg(
        F.count("*").alias("contracts"), *[F.count(c.column).alias(c.name) for c in CLAUSE_TYPES]
    )
    return counts.unpivot([*by, "contracts"], [c.name for c in CLAUSE_TYPES], "clause_type", "found")


def detection_rate(wide: DataFrame) -> DataFrame:
    """Share of contracts that contain each clause type."""
    return found_counts(wide).withColumn("rate", F.round(F.col("found") / F.col("contracts"), 6))


def detection_report(wide: DataFrame, by: str = "source", kind: str = "rollup") -> DataFrame:
    """Detection by group and clause type with subtotals; ``level`` is the grouping id (0 = no column summed over)."""
    counts = found_counts(wide, [by])
    grouped = counts.rollup(by, "clause_type") if kind == "rollup" else counts.cube(by, "clause_type")
    return grouped.agg(
        F.grouping_id().alias("level"),
        F.sum("contracts").alias("checked"),
        F.sum("found").alias("found"),
        F.round(F.sum("found") / F.sum("contracts"), 6).alias("rate"),
    )


def detection_subtotals(wide: DataFrame, by: str = "source") -> DataFrame:
    """Only the two sets of subtotals: per group, and per clause type."""
    counts = found_counts(wide, [by])
    grouped = counts.groupingSets([[F.col(by)], [F.col("clause_type")]], F.col(by), F.col("clause_type"))
    return grouped.agg(F.sum("contracts").alias("checked"), F.sum("found").alias("found"))


def detection_accuracy(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Precision and recall per clause type from two tables of (contract_id, clause_type)."""
    keys = ["contract_id", "clause_type"]
    both = truth.select(*keys, F.lit(1).alias("t")).join(
        predicted.select(*keys, F.lit(1).alias("p")), keys, "full_outer"
    )
    hit = F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull())
    return both.groupBy("clause_type").agg(
        hit.alias("true_positive"),
        F.count_if(F.col("t").isNull()).alias("false_positive"),
        F.count_if(F.col("p").isNull()).alias("false_negative"),
        F.round(F.try_divide(hit, F.count("p")), 6).alias("precision"),
        F.round(F.try_divide(hit, F.count("t")), 6).alias("recall"),
    )


def success_rate(results: DataFrame) -> DataFrame:
    """Contracts of which no task failed, over all contracts."""
    per_contract = results.groupBy("contract_id").agg(F.bool_and(F.col("status") != "error").alias("ok"))
    return per_contract.agg(
        F.count("*").alias("contracts"),
        F.count_if("ok").alias("succeeded"),
        F.round(F.count_if("ok") / F.count("*"), 6).alias("rate"),
    )


def summary_quality(checked: DataFrame) -> DataFrame:
    """Rollup of ``summary.length_check``: share in range and mean word count."""
    return checked.agg(
        F.count("*").alias("summaries"),
        F.round(F.avg(F.col("in_range").cast("double")), 6).alias("in_range_share"),
        F.round(F.avg("words"), 6).alias("mean_words"),
    )


def token_efficiency(prompt_rows: DataFrame) -> DataFrame:
    """Mean estimated prompt tokens per task and per contract (``task`` = ``all``)."""
    per_task = prompt_rows.groupBy("task").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    # Every contract has each task once, so the number of contracts is the largest task count.
    whole = per_task.agg(
        F.lit("all").alias("task"),
        F.sum("tokens").alias("tokens"),
        F.max("n").alias("contracts"),
    )
    rows = per_task.select("task", "tokens", F.col("n").alias("contracts")).unionByName(whole)
    return rows.withColumn("mean_tokens", F.round(F.col("tokens") / F.col("contracts"), 6))


def processing_rate(rows: DataFrame, stamp: str = "processed_at") -> DataFrame:
    """Rows, seconds between first and last, rows per minute and mean seconds per row."""
    micros = F.unix_micros(F.col(stamp).cast("timestamp"))
    spanned = rows.agg(F.count("*").alias("rows"), ((F.max(micros) - F.min(micros)) / 1e6).alias("seconds"))
    return spanned.select(
        "rows",
        F.round("seconds", 6).alias("seconds"),
        F.round(F.try_divide(F.col("rows") * 60.0, F.col("seconds")), 6).alias("per_minute"),
        F.round(F.try_divide(F.col("seconds"), F.col("rows")), 6).alias("seconds_per_row"),
    )


def windowed_rate(rows: DataFrame, stamp: str, width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Rows per tumbling (or, with ``slide``, sliding) time window; works on batch and streaming tables."""
    span = F.window(stamp, width, slide) if slide else F.window(stamp, width)
    return rows.groupBy(span.alias("span")).agg(F.count("*").alias("rows")).select(
        F.col("span.start").alias("start"), F.col("span.end").alias("end"), "rows"
    )


def index_counts(clauses: DataFrame) -> DataFrame:
    """Clauses per type and overall (``clause_type`` = ``all``)."""
    return clauses.rollup("clause_type").agg(F.count("*").alias("clauses")).select(
        F.coalesce("clause_type", F.lit("all")).alias("clause_type"), "clauses"
    )


def contracts_per_type(clauses: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct contracts per clause type, exactly or by a sketch (within about 5 %)."""
    count = F.approx_count_distinct("contract_id") if approximate else F.count_distinct("contract_id")
    return clauses.groupBy("clause_type").agg(count.alias("contracts"))


def length_distribution(contracts: DataFrame) -> DataFrame:
    """Spread of text lengths and word counts.

    Values are counted first, so the exact percentiles see one row per distinct value, not one per contract.
    """
    measures = F.array(
        F.struct(F.lit("text_length").alias("measure"), T.text_length("text").cast("long").alias("value")),
        F.struct(F.lit("word_count").alias("measure"), T.word_count("text").cast("long").alias("value")),
    )
    counted = (
        contracts.select(F.inline(measures)).groupBy("measure", "value").agg(F.count("*").alias("n"))
    )

    def percentile(p: float) -> Column:
        return F.round(F.percentile("value", p, F.col("n")), 6)

    return counted.groupBy("measure").agg(
        F.sum("n").alias("contracts"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 6).alias("mean"),
        percentile(0.5).alias("median"),
        percentile(0.9).alias("p90"),
    )


def extension_counts(files: DataFrame) -> DataFrame:
    """Files per lower-cased suffix, from a listing; file contents are not read."""
    return files.groupBy(T.file_extension("filename").alias("extension")).agg(F.count("*").alias("files"))
