"""Context around clause hits: windows of characters, and overlapping windows merged into passages.

Offsets are running sums over the sentence lengths of a row, so no shuffle is needed and the text is not moved. Array
functions have no running sum that is linear, so the lengths, and nothing else, go through Arrow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.functions import text as T
from clauseloom.operators.clauses import mentions_lowered, with_sentences
from clauseloom.taxonomy import CLAUSE_TYPES, ClauseType

_SPANS = "array<struct<pos:int,first:int,last:int>>"
# Characters of a piece of text: a passage is cut out of the pieces it lies in, not searched from the text's start.
_PIECE = 1_024


def sums_before(lengths: pa.Array) -> pa.Array:
    """Per list the sum of the elements before each element: one running sum over the whole batch."""
    flat = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = lengths.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    running = np.concatenate([[0], np.cumsum(flat)])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    sums = running[:-1] - np.repeat(running[begins], sizes)
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(sums, pa.int32()), mask=lengths.is_null())


def _with_starts(df: DataFrame, sentences: str) -> DataFrame:
    """Add ``lengths`` of the sentences and ``starts``, counted from the first sentence."""
    # Made here: the function needs a running session.
    running = F.arrow_udf(sums_before, "array<int>")
    return df.withColumn("lengths", F.transform(sentences, F.length)).withColumn("starts", running("lengths"))


def sentence_offsets(contracts: DataFrame, id_column: str = "contract_id") -> DataFrame:
    """One row per sentence with its 0-based ``start`` in the text and its ``length``; nothing is shuffled."""
    split = contracts.select(id_column, F.length("text").alias("_total"), T.sentences("text").alias("_sentences"))
    placed = _with_starts(split, "_sentences").drop("_sentences").select(
        id_column, "_total", _covered().alias("_covered"), F.posexplode(F.arrays_zip("starts", "lengths")).alias("pos", "_s")
    )
    # Stops at the very start of a text belong to no sentence.
    start = F.col("_total") - F.col("_covered") + F.col("_s.starts")
    return placed.select(id_column, "pos", start.cast("long").alias("start"), F.col("_s.lengths").alias("length"))


def _covered() -> Column:
    """Characters in sentences; null without any."""
    last = F.size("starts") - 1
    return F.get("starts", last) + F.get("lengths", last)


def _hit_spans(clause: ClauseType) -> Column:
    """Character ranges (0-based first, exclusive last) around the hit sentences of one clause type, in order.

    Expects the columns of ``_with_starts``: sentences are filtered first, so nothing grows with those that do not hit.
    """
    # Stops at the very start of a text belong to no sentence.
    lead = F.col("_total") - _covered()
    places = F.filter(
        F.sequence(F.lit(0), F.size("starts") - 1),
        lambda i: mentions_lowered(F.get("lowered", i), clause.keywords),
    )

    def span(i: Column) -> Column:
        begin = lead + F.get("starts", i)
        return F.struct(
            i.cast("int").alias("pos"),
            F.greatest(F.lit(0), begin - clause.context_window).cast("int").alias("first"),
            F.least(F.col("_total"), begin + F.get("lengths", i) + clause.context_window).cast("int").alias("last"),
        )

    has_any = F.col(f"may_{clause.name}") & (F.size("starts") > 0)
    return F.when(has_any, F.transform(places, span)).otherwise(F.array().cast(_SPANS))


def _merged(spans: Column) -> Column:
    """Overlapping or touching spans joined: a span starts anew where it begins after the end of the one before.

    Spans come in order, and a window is as wide for each hit, so ends rise with starts: no fold is needed. The next
    start decides where a joined span ends.
    """
    opens = F.filter(spans, lambda s, i: (i == 0) | (F.get(spans, i - 1)["last"] < s["first"]))
    closes = F.filter(spans, lambda s, i: F.coalesce(F.get(spans, i + 1)["first"] > s["last"], F.lit(True)))
    return F.zip_with(
        opens, closes, lambda o, c: F.struct(o["pos"].alias("pos"), o["first"].alias("first"), c["last"].alias("last"))
    )


def _cut(first: Column, last: Column) -> Column:
    """The characters from ``first`` up to ``last`` of the text in ``_pieces``."""
    piece = F.floor(first / _PIECE).cast("int")
    around = F.slice("_pieces", piece + 1, F.floor(last / _PIECE).cast("int") - piece + 1)
    return F.substring(F.array_join(around, ""), first - piece * _PIECE + 1, last - first)


def _tag(spans: str, name: str) -> Column:
    """Spans with the name of their clause type and their passage."""
    return F.transform(
        spans,
        lambda s: F.struct(
            F.lit(name).alias("clause_type"), s["pos"].alias("pos"), s["first"].alias("first"), s["last"].alias("last"),
            _cut(s["first"], s["last"]).alias("passage"),
        ),
    )


def _passages(contracts: DataFrame, id_column: str, merge: bool) -> DataFrame:
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    # Made before the running sums, which no optimizer rule moves them past: each is then evaluated once per text.
    whole = with_sentences(contracts).withColumns(
        {
            "_total": F.length("text"),
            "_pieces": F.when(F.size("sentences") > 0, pieces).otherwise(F.array().cast("array<string>")),
        }
    ).drop("text")
    split = _with_starts(whole, "sentences")
    spans = split.withColumns({f"_{c.name}": _hit_spans(c) for c in CLAUSE_TYPES})
    if merge:
        spans = spans.withColumns({f"_{c.name}": _merged(F.col(f"_{c.name}")) for c in CLAUSE_TYPES})
    tagged = F.flatten(F.array(*[_tag(f"_{c.name}", c.name) for c in CLAUSE_TYPES]))
    return spans.select(id_column, F.inline(tagged)).select(id_column, "clause_type", "pos", "first", "last", "passage")


def context_windows(contracts: DataFrame, id_column: str = "contract_id") -> DataFrame:
    """One row per hit: the hit sentence with the clause type's window of characters on both sides."""
    return _passages(contracts, id_column, merge=False)


def merged_passages(contracts: DataFrame, id_column: str = "contract_id") -> DataFrame:
    """Overlapping or touching windows of one clause type joined together; ``pos`` is the first hit's sentence."""
    return _passages(contracts, id_column, merge=True)
