"""The contract table used by the catalogue: the given documents, each with some clauses added by a fixed rule.

The given prose holds no legal keyword, so sample clauses are appended by document number: then the truth is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.operators.clauses import clause_rows, find_clauses, indexable
from clauseloom.operators.ingest import load_contracts, screen
from clauseloom.operators.layout import spread
from clauseloom.sources.stages import stage, stage_by_key
from clauseloom.taxonomy import CLAUSE_TYPES, SAMPLE_QUERIES

# Every how many documents a clause type is appended.
EVERY = {"termination": 2, "confidentiality": 3, "liability": 5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, contract_id, filename, source, text): raw documents with page headers and clauses added."""
    doc = F.col("doc_id")
    added = [
        F.when(doc % EVERY[c.name] == 0, F.lit(". " + c.exemplar)).otherwise("") for c in CLAUSE_TYPES
    ]
    header = F.when(doc % 7 == 0, F.concat(F.lit("Page "), doc.cast("string"), F.lit(" "))).otherwise("")
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return spread(documents, "doc_id").select(
        "doc_id",
        F.format_string("contract_%03d", doc).alias("contract_id"),
        listing_name().alias("filename"),
        "source",
        F.concat(header, F.col("text"), *added).alias("text"),
    )


def listing_name() -> F.Column:
    """File name of a document: even numbers are PDFs, odd ones DOCX."""
    return F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".pdf").otherwise(".docx"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, filename, source): the file listing, without texts."""
    return table(spark, sf_dir, "documents").select("doc_id", listing_name().alias("filename"), "source")


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen(raw(spark, sf_dir))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_contracts(raw(spark, sf_dir))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts with one column per clause type."""
    return find_clauses(contracts(spark, sf_dir))


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contract and clause type, found or absent."""
    return clause_rows(wide(spark, sf_dir))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses found, with an ``item_id``, as indexed for search."""
    found = indexable(clauses(spark, sf_dir))
    return found.withColumn("item_id", F.concat_ws(":", "contract_id", "clause_type"))


def stored_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts as a stage table, for work that reads them more than once."""
    return stage(contracts(spark, sf_dir), "contracts")


def contracts_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts as a stage table laid out by contract, for work that joins their texts by it."""
    return stage_by_key(contracts(spark, sf_dir), "contracts", "contract_id")


def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses found as a stage table."""
    return stage(items(spark, sf_dir), "items")


def responses(contracts_table: DataFrame) -> DataFrame:
    """A model's answers: clauses, and the whole text as summary; some contracts failed, at various attempts."""
    found = find_clauses(contracts_table)
    rows = [F.struct(F.lit(c.name).alias("task"), F.col(c.column).alias("value")) for c in CLAUSE_TYPES]
    rows.append(F.struct(F.lit("summary").alias("task"), F.col("text").alias("value")))
    failed = F.col("doc_id") % 11 == 0
    return found.select("doc_id", "contract_id", F.inline(F.array(*rows))).select(
        "contract_id",
        "task",
        (F.col("doc_id") % 3 + 1).cast("int").alias("attempt"),
        F.when(failed, "error").when(F.col("value").isNull(), "absent").otherwise("found").alias("status"),
        F.when(~failed, F.col("value")).alias("value"),
    )


def truth(contracts_table: DataFrame) -> DataFrame:
    """(contract_id, clause_type) as appended, for accepted documents."""
    kinds = F.array_compact(
        F.array(*[F.when(F.col("doc_id") % EVERY[c.name] == 0, c.name) for c in CLAUSE_TYPES])
    )
    return contracts_table.select("contract_id", F.explode(kinds).alias("clause_type"))


def sample_queries(spark: SparkSession) -> DataFrame:
    """(query_id, text): eight fixed search texts."""
    return spark.createDataFrame(list(enumerate(SAMPLE_QUERIES, start=1)), "query_id int, text string")
