"""Checks on a result table: one row per violated rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """Rows that break a rule. ``rules`` maps a name to a condition that must hold; null counts as broken."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    )
    return rows.select(key, F.explode(broken).alias("rule"))


def clause_rules() -> dict[str, Column]:
    """Rules of the long clause table: keys present, and the status agrees with the value."""
    found = F.col("status") == "found"
    return {
        "contract_id_missing": F.col("contract_id").isNotNull(),
        "filename_missing": F.col("filename").isNotNull(),
        "status_unknown": F.col("status").isin("found", "absent", "error"),
        "found_without_text": ~found | (F.length("clause") > 0),
        "text_without_found": found | F.col("clause").isNull(),
    }


def result_rules(low_words: int = 100, high_words: int = 150, longest_text: int | None = None) -> dict[str, Column]:
    """Rules of the final table: keys present, lengths in bounds, summary inside the asked length."""
    return {
        "contract_id_missing": F.col("contract_id").isNotNull(),
        "filename_missing": F.col("filename").isNotNull(),
        "text_length_negative": F.col("text_length") >= 0,
        **({} if longest_text is None else {"text_too_long": F.col("text_length") <= longest_text}),
        "word_count_negative": F.col("word_count") >= 0,
        "summary_missing": F.length("summary") > 0,
        "summary_length": F.regexp_count("summary", F.lit("[^ ]+")).between(low_words, high_words),
    }
