"""From raw documents to contracts: screening, ids, chunks, batches and duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import text as T
from clauseloom.operators.layout import number_rows, row_barrier
from clauseloom.options import IngestOptions

# Why ``screen`` rejects a document.
REASONS = ("no_text", "too_short")


def screen(documents: DataFrame, options: IngestOptions = IngestOptions()) -> DataFrame:
    """Normalise ``text`` and give each document a ``reason`` for rejection, null if it is accepted.

    Reasons: ``no_text`` (nothing but white space, or extraction failed) and ``too_short`` (fewer than
    ``min_text_length`` characters after normalisation).
    """
    raw = F.col("text")
    screened = (
        documents.withColumn("_blank", ~F.coalesce(raw, F.lit("")).rlike(f"[^{T.WHITESPACE}]"))
        .withColumn("text", _cleaned(F.coalesce(raw, F.lit("")), options))
        .transform(row_barrier, "_blank", "text")
        .withColumn(
            "reason",
            F.when(F.col("_blank"), "no_text").when(F.length("text") < options.min_text_length, "too_short"),
        )
    )
    return screened.drop("_blank")


def _cleaned(text: Column, options: IngestOptions) -> Column:
    return T.normalize_text(text, options.remove_page_numbers) if options.normalize_text else text


def accepted(screened: DataFrame) -> DataFrame:
    """The contracts: screened documents without a reason for rejection."""
    return screened.filter(F.col("reason").isNull()).drop("reason")


def rejected(screened: DataFrame) -> DataFrame:
    """The reject table: skipped documents with reason and length, without their text."""
    kept = [c for c in screened.columns if c not in ("text", "reason")]
    return screened.filter(F.col("reason").isNotNull()).select(
        *kept, "reason", T.text_length("text").alias("text_length")
    )


def load_contracts(documents: DataFrame, options: IngestOptions = IngestOptions()) -> DataFrame:
    """Screen documents and keep the accepted ones."""
    return accepted(screen(documents, options))


def format_rank(filename: Column | str) -> Column:
    """Listing order of file formats: PDF, then DOCX, then the rest."""
    return (
        F.when(T.file_extension(filename) == "pdf", 0).when(T.file_extension(filename) == "docx", 1).otherwise(2)
    )


def supported(documents: DataFrame, formats: Sequence[str] = IngestOptions.supported_formats) -> DataFrame:
    """Documents whose file name has a supported suffix."""
    return documents.filter(T.file_extension("filename").isin(*formats))


def first_documents(documents: DataFrame, n: int, unique: str) -> DataFrame:
    """The first ``n`` documents of the listing (format, file name, ``unique``), taken before any screening.

    Only the listing is ordered; texts stay where they are until the chosen ones are known.
    """
    numbered = number_listing(documents.select("filename", unique), unique).filter(F.col("row_no") <= n)
    return documents.join(numbered.select(unique), unique, "left_semi")


def number_listing(documents: DataFrame, unique: str) -> DataFrame:
    """Add ``row_no``: the position of each document in the listing (format, file name, ``unique``)."""
    ranked = documents.withColumn("_rank", format_rank("filename"))
    return number_rows(ranked, ["_rank", "filename", unique]).drop("_rank")


def assign_contract_ids(documents: DataFrame, unique: str, max_contracts: int | None = None) -> DataFrame:
    """Add ``contract_id`` = ``contract_001``, ``contract_002``, … in listing order, before any screening.

    Later rejects leave gaps in the sequence. With ``max_contracts`` only the head of the listing is kept.
    """
    numbered = number_listing(documents, unique)
    if max_contracts is not None:
        numbered = numbered.filter(F.col("row_no") <= max_contracts)
    return numbered.withColumn("contract_id", F.format_string("contract_%03d", "row_no")).drop("row_no")


def stable_ids(documents: DataFrame, path: str = "path") -> DataFrame:
    """Add a ``contract_id`` that depends on the path alone: no order, no shuffle. The default at scale."""
    return documents.withColumn("contract_id", F.sha2(F.col(path), 256))


def batches(numbered: DataFrame, size: int = 5) -> DataFrame:
    """Add ``batch_no`` (from 1) of ``size`` consecutive rows, given ``row_no``."""
    return numbered.withColumn("batch_no", (F.floor((F.col("row_no") - 1) / size) + 1).cast("long"))


def hash_batches(documents: DataFrame, key: str, n: int) -> DataFrame:
    """Add ``batch_no`` from a hash of the key: about equal batches without numbering the rows."""
    return documents.withColumn("batch_no", F.pmod(F.xxhash64(key), F.lit(n)).cast("long"))


def chunks(contracts: DataFrame, size: int = 4_000, id_column: str = "contract_id") -> DataFrame:
    """Cut each text into pieces of ``size`` characters: ``chunk_no`` from 0, 1-based ``start``, ``chunk``."""
    last = F.greatest(F.ceil(F.length("text") / size).cast("int") - 1, F.lit(0))
    return contracts.select(
        id_column, "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no")
    ).select(
        id_column,
        "chunk_no",
        (F.col("chunk_no") * size + 1).alias("start"),
        F.substring("text", F.col("chunk_no") * size + 1, F.lit(size)).alias("chunk"),
    )


def combine(parts: Sequence[DataFrame], key: Sequence[str] = ("contract_id",)) -> DataFrame:
    """Union of batch outputs, one row per key: of a batch that was run twice the later output counts.

    The latest part wins, and within one part the greatest row, so the result does not depend on task order. Only keys
    and part numbers are grouped; rows move only if their key comes more than once, so parts should be stored tables,
    which are read twice for their keys and once or twice for their rows. A null is a key like any other.
    """
    numbered = [p.withColumn("_part", F.lit(n)) for n, p in enumerate(parts)]
    together = reduce(lambda a, b: a.unionByName(b), numbered)
    columns = [c for c in together.columns if c != "_part"]
    counted = together.groupBy(*key, "_part").agg(F.count("*").alias("_rows"))
    # Of a key, as many entries as there are parts.
    seen = counted.groupBy(*key).agg(F.collect_list(F.struct("_part", "_rows")).alias("_seen"))
    entries = seen.select(*key, F.array_max("_seen")["_part"].alias("_last"), F.inline("_seen"))
    odd = entries.filter("_part < _last OR _rows > 1").select(
        *[F.col(c).alias(f"_odd_{n}") for n, c in enumerate(key)], F.col("_part").alias("_odd_part"), "_last"
    )
    same = F.col("_part") == F.col("_odd_part")
    for n, c in enumerate(key):
        same &= F.col(c).eqNullSafe(F.col(f"_odd_{n}"))
    plain = together.join(odd, same, "left_anti").select(*columns)
    repeated = together.join(odd.filter("_odd_part = _last"), same, "left_semi")
    greatest = repeated.groupBy(*key).agg(F.max(F.struct(*columns)).alias("_greatest")).select("_greatest.*")
    return plain.unionByName(greatest)


def distinct_content(documents: DataFrame, unique: str) -> DataFrame:
    """Of documents with exactly the same text keep the one with the lowest ``unique`` value.

    Copies are found on (digest, length) with map-side aggregation. Only the losers, whose digest occurs more than
    once, are listed and taken away; documents without a copy, and all texts, stay where they are unless there are too
    many losers to broadcast.
    """
    # A null text is a text like any other here: it has a digest of its own, so that its copies meet in the join.
    digest, length = F.coalesce(F.sha2("text", 256), F.lit("")), F.coalesce(F.length("text"), F.lit(-1))
    marked = documents.select(digest.alias("_digest"), length.alias("_length"), unique)
    copied = (
        marked.groupBy("_digest", "_length")
        .agg(F.min(unique).alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
    )
    losers = marked.join(copied, ["_digest", "_length"]).filter(F.col(unique) != F.col("_first")).select(unique)
    return documents.join(losers, unique, "left_anti")
