"""Metadata records: assembly, merging with and without types, lookups and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseloom.functions import text as T

METADATA_SCHEMA = "text_length int, word_count int, processed_at timestamp"


def extraction_metadata(text: Column | str, processed_at: Column | None = None) -> Column:
    """Record of text length, word count and processing time (now, unless given)."""
    stamp = F.current_timestamp() if processed_at is None else processed_at
    return F.struct(
        T.text_length(text).alias("text_length"),
        T.word_count(text).alias("word_count"),
        stamp.alias("processed_at"),
    )


def merge_metadata(user: Column | str, system: Column | str) -> Column:
    """Union of two string maps; on a shared key the system value wins, and user keys are kept.

    (A null map counts as empty.)
    """
    empty = F.create_map().cast("map<string,string>")
    left = F.coalesce(F.col(user) if isinstance(user, str) else user, empty)
    right = F.coalesce(F.col(system) if isinstance(system, str) else system, empty)
    return F.map_zip_with(left, right, lambda _key, u, s: F.coalesce(s, u))


def typed_metadata(**values: Column) -> Column:
    """Map of the given keys to VARIANT values, which keep their types."""
    pairs = [c for key, value in values.items() for c in (F.lit(key), value.cast("variant"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,variant>")


def typed_from_json(text: Column | str) -> Column:
    """A JSON object as a map of VARIANT values; null where the text is no JSON object."""
    return F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")


def merge_typed(user: Column | str, system: Column | str) -> Column:
    """Like ``merge_metadata`` for maps of VARIANT values of mixed types: each value keeps its own type.

    On a shared key the system value wins, unless it is missing (null); a JSON null is a value.
    """
    empty = F.create_map().cast("map<string,variant>")
    left = F.coalesce(F.col(user) if isinstance(user, str) else user, empty)
    right = F.coalesce(F.col(system) if isinstance(system, str) else system, empty)
    return F.map_zip_with(left, right, lambda _key, u, s: F.coalesce(s, u))


def typed_value(mapping: Column | str, key: str, kind: str) -> Column:
    """``mapping[key]`` as the given type; null where the key is missing or its value cannot be read as that type."""
    m = F.col(mapping) if isinstance(mapping, str) else mapping
    return F.try_variant_get(F.try_element_at(m, F.lit(key)), "$", kind)


def kind_of(mapping: Column | str, key: str) -> Column:
    """Type of ``mapping[key]`` as it is stored, for example BIGINT, BOOLEAN or ARRAY<STRING>."""
    m = F.col(mapping) if isinstance(mapping, str) else mapping
    return F.schema_of_variant(F.try_element_at(m, F.lit(key)))


def lookup(mapping: Column | str, key: str, default: object) -> Column:
    """``mapping[key]``, or the default where the key (or the whole map) is missing."""
    m = F.col(mapping) if isinstance(mapping, str) else mapping
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def to_json(record: Column | str) -> Column:
    """Record as JSON text."""
    return F.to_json(record)


def from_json(text: Column | str, schema: str = METADATA_SCHEMA) -> Column:
    """JSON text as a typed record."""
    return F.from_json(text, schema)
