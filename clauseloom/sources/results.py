"""Result tables: assembling them, writing them as CSV and JSON, and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import records as R
from clauseloom.functions import text as T

CSV_COLUMNS = (
    "contract_id",
    "filename",
    "summary",
    "termination_clause",
    "confidentiality_clause",
    "liability_clause",
    "text_length",
    "word_count",
)
CSV_SCHEMA = ", ".join(f"{c} {'int' if c in ('text_length', 'word_count') else 'string'}" for c in CSV_COLUMNS)
JSON_SCHEMA = f"{CSV_SCHEMA}, full_text string, metadata struct<{R.METADATA_SCHEMA.replace(' ', ':').replace(',:', ',')}>"


def result_rows(contracts: DataFrame, wide: DataFrame) -> DataFrame:
    """The final table: one row per contract with clauses, summary, sizes, preview and metadata.

    ``wide`` holds contract_id, summary and the clause columns; a contract without a row there keeps nulls.
    """
    measured = contracts.select(
        "contract_id",
        "filename",
        T.preview("text").alias("full_text"),
        R.extraction_metadata("text").alias("metadata"),
    )
    joined = measured.join(wide.select(*[c for c in CSV_COLUMNS if c in wide.columns]), "contract_id", "left")
    return joined.withColumns(
        {"text_length": F.col("metadata.text_length"), "word_count": F.col("metadata.word_count")}
    ).select(*CSV_COLUMNS, "full_text", "metadata")


def write_csv(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the eight plain columns as CSV with a header; quotes inside a value are doubled."""
    (
        results.select(*CSV_COLUMNS)
        .write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def write_json(
    results: DataFrame, path: str, full_text: bool = True, metadata: bool = True, mode: str = "overwrite"
) -> None:
    """Write JSON lines with every field present, optionally without preview or metadata."""
    columns = [*CSV_COLUMNS, *(["full_text"] if full_text else []), *(["metadata"] if metadata else [])]
    results.select(*columns).write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read a result CSV back. Empty and missing values both come back null."""
    reader = spark.read.schema(CSV_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"')
    return reader.csv(path)


def read_json(spark: SparkSession, path: str, array_file: bool = False) -> DataFrame:
    """Read result JSON back: JSON lines, or files that each hold one array."""
    return spark.read.schema(JSON_SCHEMA).option("multiLine", array_file).json(path)
