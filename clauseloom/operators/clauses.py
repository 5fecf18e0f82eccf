"""Finding clauses by keyword, inside each row.

The sentences of a contract stay in an array column, so finding, counting and joining them needs no shuffle: the
whole step is one narrow projection over the scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import text as T
from clauseloom.taxonomy import (
    ABSENT_TEXT,
    CLAUSE_COLUMNS,
    CLAUSE_NAMES,
    CLAUSE_TYPES,
    ClauseType,
    clause_type,
    error_text,
)

# Short keywords are whole words; longer ones also match their inflected forms ("terminate" in "terminated").
_WHOLE_WORD_BELOW = 5


def keyword_pattern(keywords: Sequence[str]) -> str:
    """Pattern for any of the keywords in lower-cased text, starting at a word boundary."""
    parts = [
        re.escape(k).replace(r"\-", "-").replace(r"\ ", " ")
        + (f"($|[^{T.WORD}])" if len(k) < _WHOLE_WORD_BELOW else "")
        for k in keywords
    ]
    return f"(^|[^{T.WORD}])({'|'.join(parts)})"


def _contains_any(lowered: Column, keywords: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(k) for k in keywords])


def mentions(text: Column | str, keywords: Sequence[str]) -> Column:
    """Whether the text holds one of the keywords. The plain substring test settles most texts before the regex."""
    return mentions_lowered(F.lower(F.col(text) if isinstance(text, str) else text), keywords)


def mentions_lowered(lowered: Column, keywords: Sequence[str]) -> Column:
    """``mentions`` for a text that is in lower case already."""
    return _contains_any(lowered, keywords) & lowered.rlike(keyword_pattern(keywords))


def with_sentences(contracts: DataFrame) -> DataFrame:
    """Add the arrays ``sentences`` and ``lowered``, and ``may_<type>``: whether a keyword occurs as a substring.

    A text without any keyword is not split; the flags spare the regex work of the types that cannot occur.
    """
    lowered = contracts.withColumn("lowered", F.lower("text"))
    flags = {f"may_{c.name}": _contains_any(F.col("lowered"), c.keywords) for c in CLAUSE_TYPES}
    relevant = reduce(lambda a, b: a | b, [F.col(f) for f in flags])
    flagged = lowered.withColumns(flags)
    split = F.when(relevant, T.sentences("text")).otherwise(F.array().cast("array<string>"))
    return flagged.withColumn("sentences", split).withColumn(
        "lowered", F.transform("sentences", lambda s: F.lower(s))
    )


SENTENCE_COLUMNS = ("sentences", "lowered", *(f"may_{c.name}" for c in CLAUSE_TYPES))


def _hits(clause: ClauseType) -> Column:
    """The sentences that mention the clause type as (pos, sentence), trimmed, in document order."""
    numbered = F.transform("sentences", lambda s, i: F.struct(i.alias("pos"), F.trim(s).alias("sentence")))
    found = F.filter(numbered, lambda x: mentions_lowered(F.get("lowered", x["pos"]), clause.keywords))
    return F.when(F.col(f"may_{clause.name}"), found).otherwise(F.array().cast("array<struct<pos:int,sentence:string>>"))


def with_hits(contracts: DataFrame) -> DataFrame:
    """Add ``<type>_hits``, the array of hit sentences with their positions, for each clause type."""
    split = with_sentences(contracts)
    return split.withColumns({f"{c.name}_hits": _hits(c) for c in CLAUSE_TYPES}).drop(*SENTENCE_COLUMNS)


def find_clauses(contracts: DataFrame) -> DataFrame:
    """Add one column per clause type: its sentences in document order and original wording, null if absent."""
    found = with_hits(contracts)
    joined = {
        c.column: F.when(F.size(f"{c.name}_hits") > 0, F.array_join(F.col(f"{c.name}_hits")["sentence"], " "))
        for c in CLAUSE_TYPES
    }
    return found.withColumns(joined).drop(*[f"{c.name}_hits" for c in CLAUSE_TYPES])


def sentence_rows(contracts: DataFrame, id_column: str = "contract_id") -> DataFrame:
    """One row per sentence: ``pos`` from 0 and the trimmed ``sentence``."""
    return contracts.select(id_column, F.posexplode(T.sentences("text")).alias("pos", "sentence")).withColumn(
        "sentence", F.trim("sentence")
    )


def hit_rows(contracts: DataFrame, id_column: str = "contract_id") -> DataFrame:
    """One row per (contract, clause type, sentence) hit."""
    # Only the hits leave the row: sentences without one are never exploded.
    per_type = [
        F.struct(F.lit(c.name).alias("clause_type"), F.col(f"{c.name}_hits").alias("hits")) for c in CLAUSE_TYPES
    ]
    return (
        with_hits(contracts)
        .select(id_column, F.inline(F.array(*per_type)))
        .select(id_column, "clause_type", F.inline("hits"))
    )


def keyword_counts(contracts: DataFrame, id_column: str = "contract_id") -> DataFrame:
    """Per contract and clause type: number of hit sentences and the keywords present, in taxonomy order."""
    per_type = [
        F.struct(
            F.lit(c.name).alias("clause_type"),
            F.size(f"{c.name}_hits").alias("hit_sentences"),
            F.concat_ws(", ", *[F.when(mentions("text", [k]), F.lit(k)) for k in c.keywords]).alias("keywords"),
        )
        for c in CLAUSE_TYPES
    ]
    return (
        with_hits(contracts)
        .select(id_column, F.inline(F.array(*per_type)))
        .filter(F.col("hit_sentences") > 0)
    )


def presence_matrix(contracts: DataFrame, id_column: str = "contract_id") -> DataFrame:
    """Per contract, one 0/1 column per clause type."""
    return contracts.select(
        id_column, *[mentions("text", c.keywords).cast("int").alias(f"has_{c.name}") for c in CLAUSE_TYPES]
    )


def clause_rows(wide: DataFrame, ids: Sequence[str] = ("contract_id", "filename")) -> DataFrame:
    """Wide to long: one row per contract and clause type with ``status`` found or absent."""
    long = wide.select(*ids, *CLAUSE_COLUMNS).unpivot(list(ids), list(CLAUSE_COLUMNS), "clause_type", "clause")
    return long.withColumn("clause_type", F.regexp_replace("clause_type", "_clause$", "")).withColumn(
        "status", F.when(F.col("clause").isNotNull(), "found").otherwise("absent")
    )


def sentinel(task: Column | str, status: Column | str, value: Column | str) -> Column:
    """The value to show: the text itself, or the agreed phrase for an absent or failed task."""
    t = F.col(task) if isinstance(task, str) else task
    s = F.col(status) if isinstance(status, str) else status
    v = F.col(value) if isinstance(value, str) else value
    failed = F.when(t == "summary", error_text("summary"))
    for name in CLAUSE_NAMES:
        failed = failed.when(t == name, error_text(name))
    before, after = ABSENT_TEXT.split("{name}")
    absent = F.concat(F.lit(before), t, F.lit(after))
    return F.when(s == "error", failed).when(s == "absent", absent).otherwise(v)


def with_sentinels(wide: DataFrame) -> DataFrame:
    """Fill absent clause columns with their phrase, for sinks that have no status column."""
    return wide.withColumns(
        {c.column: F.coalesce(F.col(c.column), F.lit(ABSENT_TEXT.format(name=c.name))) for c in CLAUSE_TYPES}
    )


def indexable(clauses: DataFrame, by_value: bool = False) -> DataFrame:
    """Clauses worth indexing: those found.

    ``by_value`` is the compatible rule for tables without a status: non-empty and starting neither with ``No `` nor
    with ``Error``; it also drops real clauses such as "No party shall …".
    """
    if not by_value:
        return clauses.filter(F.col("status") == "found")
    text = F.coalesce(F.col("clause"), F.lit(""))
    return clauses.filter((text != "") & ~text.startswith("No ") & ~text.startswith("Error"))


def element_coverage(clauses: DataFrame) -> DataFrame:
    """Add ``elements_found``, ``elements_required`` and ``coverage`` of the required elements of each clause."""
    lowered = F.lower("clause")
    found = F.lit(None).cast("int")
    required = F.lit(None).cast("int")
    for c in CLAUSE_TYPES:
        present = reduce(lambda a, b: a + b, [lowered.contains(e).cast("int") for e in c.required_elements])
        found = F.when(F.col("clause_type") == c.name, present).otherwise(found)
        required = F.when(F.col("clause_type") == c.name, F.lit(len(c.required_elements))).otherwise(required)
    return clauses.withColumns({"elements_found": found, "elements_required": required}).withColumn(
        "coverage", F.col("elements_found") / F.col("elements_required")
    )


def _count_map(text: str) -> dict[str, int]:
    counts: dict[str, int] = {}
    for term in re.findall(r"\w+", text.lower()):
        counts[term] = counts.get(term, 0) + 1
    return counts


def _sum_of_squared_counts(sorted_terms: Column) -> Column:
    """Sum of squared run lengths of a sorted array, in one pass."""
    start = F.struct(F.lit("").alias("term"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("total"))

    def step(acc: Column, term: Column) -> Column:
        same = acc["term"] == term
        # (run + 1)^2 - run^2 = 2 run + 1: growing a run by one adds that much.
        return F.struct(
            term.alias("term"),
            F.when(same, acc["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"),
            (acc["total"] + F.when(same, acc["run"] * 2 + 1).otherwise(F.lit(1).cast("long"))).alias("total"),
        )

    return F.aggregate(sorted_terms, start, step, lambda acc: acc["total"])


def _sum_of_lookups(keys: str, weights: Column) -> Column:
    """Sum of ``weights[key]`` over an array of keys; unknown keys add nothing."""
    return F.aggregate(
        keys, F.lit(0).cast("long"), lambda total, k: total + F.coalesce(F.try_element_at(weights, k), F.lit(0))
    )


def exemplar_similarity(clauses: DataFrame) -> DataFrame:
    """Add ``exemplar_score``: term-count cosine of each clause with the sample clause of its type.

    The sample's counts are literals, so this stays inside the row.
    """
    score = F.lit(None).cast("double")
    for name in CLAUSE_NAMES:
        counts = _count_map(clause_type(name).exemplar)
        weight = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
        dot = _sum_of_lookups("_terms", weight)
        norm = sum(n * n for n in counts.values())
        own = F.sqrt(F.col("_squares") * F.lit(norm))
        cosine = F.when(F.col("_squares") == 0, F.lit(0.0)).otherwise(dot / own)
        score = F.when(F.col("clause_type") == name, cosine).otherwise(score)
    return (
        clauses.withColumn("_terms", T.terms("clause"))
        .withColumn("_squares", _sum_of_squared_counts(F.sort_array("_terms")))
        .withColumn("exemplar_score", score)
        .drop("_terms", "_squares")
    )


def with_any_clause(contracts: DataFrame, clauses: DataFrame) -> DataFrame:
    """Contracts that have at least one clause in ``clauses``."""
    return contracts.join(clauses.select("contract_id"), "contract_id", "left_semi")


def best_chunks(chunks: DataFrame) -> DataFrame:
    """Per contract and clause type the chunk with most hit sentences, the earlier one on a tie.

    ``chunks`` comes from ``ingest.chunks``. Only two small numbers per chunk are aggregated, not its text.
    """
    per_type = [
        F.struct(F.lit(c.name).alias("clause_type"), F.size(f"{c.name}_hits").alias("hits")) for c in CLAUSE_TYPES
    ]
    counted = (
        with_hits(chunks.withColumnRenamed("chunk", "text"))
        .select("contract_id", "chunk_no", F.inline(F.array(*per_type)))
        .filter(F.col("hits") > 0)
    )
    best = F.max(F.struct("hits", (-F.col("chunk_no")).alias("earlier")))
    return counted.groupBy("contract_id", "clause_type").agg(best.alias("best")).select(
        "contract_id", "clause_type", (-F.col("best.earlier")).alias("chunk_no"), "best.hits"
    )
