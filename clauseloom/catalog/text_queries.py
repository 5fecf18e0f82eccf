"""Text functions over all contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.catalog import ctes as C
from clauseloom.catalog import fixture
from clauseloom.catalog.registry import query
from clauseloom.functions import records as R
from clauseloom.functions import text as T


@query("collapse_whitespace", C.sql(f"SELECT doc_id, {C.collapse('text')} AS text FROM raw", "raw"))
def _(spark, sf_dir):
    return fixture.raw(spark, sf_dir).select("doc_id", T.collapse_whitespace("text").alias("text"))


@query("strip_symbols", C.sql(f"SELECT doc_id, {C.strip(C.collapse('text'))} AS text FROM raw", "raw"))
def _(spark, sf_dir):
    return fixture.raw(spark, sf_dir).select(
        "doc_id", T.strip_symbols(T.collapse_whitespace("text")).alias("text")
    )


@query("strip_page_numbers", C.sql(f"SELECT doc_id, {C.pages('text')} AS text FROM raw", "raw"))
def _(spark, sf_dir):
    return fixture.raw(spark, sf_dir).select("doc_id", T.strip_page_numbers("text").alias("text"))


@query(
    "blank_digit_text",
    C.sql(
        f"""SELECT doc_id, {C.digits('whole')} AS text FROM (
          SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN doc_id || repeat(' ', CAST(doc_id % 4 AS INTEGER)) ELSE text END AS whole
          FROM raw)""",
        "raw",
    ),
)
def _(spark, sf_dir):
    # Every ninth text is its number and some spaces, so that the rule has something to blank.
    number = F.rpad(F.col("doc_id").cast("string"), (F.length(F.col("doc_id").cast("string")) + F.col("doc_id") % 4).cast("int"), F.lit(" "))
    whole = fixture.raw(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 9 == 0, number).otherwise(F.col("text")).alias("text"))
    return whole.select("doc_id", T.blank_digit_text("text").alias("text"))


@query("normalize_text", C.sql(f"SELECT doc_id, {C.normal('text')} AS text FROM raw", "raw"))
def _(spark, sf_dir):
    return fixture.raw(spark, sf_dir).select("doc_id", T.normalize_text("text").alias("text"))


@query(
    "text_stats",
    C.sql(
        f"""SELECT contract_id, CAST(length(text) AS INTEGER) AS text_length, {C.words('text')} AS word_count
        FROM contracts""",
        "contracts",
    ),
)
def _(spark, sf_dir):
    return fixture.contracts(spark, sf_dir).select(
        "contract_id", T.text_length("text").alias("text_length"), T.word_count("text").alias("word_count")
    )


@query(
    "file_names",
    C.sql(
        """SELECT doc_id, string_split(path, '/')[-1] AS filename, string_split(path, '.')[-1] AS extension
        FROM (SELECT doc_id, '/contracts/' || source || '/' || filename AS path FROM listing)""",
        "listing",
    ),
)
def _(spark, sf_dir):
    paths = fixture.listing(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("/contracts/"), "source", F.lit("/"), "filename").alias("path")
    )
    return paths.select("doc_id", T.file_name("path").alias("filename"), T.file_extension("path").alias("extension"))


@query(
    "previews",
    C.sql(
        """SELECT contract_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END
        AS preview FROM contracts""",
        "contracts",
    ),
)
def _(spark, sf_dir):
    return fixture.contracts(spark, sf_dir).select("contract_id", T.preview("text").alias("preview"))


@query(
    "snippets",
    C.sql(
        """SELECT item_id, substring(clause, 1, 100) || '...' AS short, substring(clause, 1, 150) || '...' AS longer
        FROM items""",
        "items",
    ),
)
def _(spark, sf_dir):
    return fixture.items(spark, sf_dir).select(
        "item_id", T.snippet("clause").alias("short"), T.snippet("clause", 150).alias("longer")
    )


@query(
    "model_input", C.sql("SELECT contract_id, substring(text, 1, 4000) AS text FROM contracts", "contracts")
)
def _(spark, sf_dir):
    return fixture.contracts(spark, sf_dir).select("contract_id", T.head("text").alias("text"))


@query(
    "length_limits",
    C.sql(
        """SELECT contract_id, CAST(length(substring(text, 1, 50000)) AS INTEGER) AS kept,
        length(text) > 50000 AS over_limit, length(text) > 4000 AS over_prompt FROM contracts""",
        "contracts",
    ),
)
def _(spark, sf_dir):
    return fixture.contracts(spark, sf_dir).select(
        "contract_id",
        T.text_length(T.head("text", 50_000)).alias("kept"),
        T.was_truncated("text", 50_000).alias("over_limit"),
        T.was_truncated("text", 4_000).alias("over_prompt"),
    )


@query(
    "clean_responses",
    C.sql(
        f"""SELECT conv_id, turn, regexp_replace(text, '^[{C.WS}]+|[{C.WS}]+$', '', 'g') AS text
        FROM (SELECT conv_id, turn, chr(10) || ' ' || text || chr(160) || chr(9) AS text FROM conversations)"""
    ),
)
def _(spark, sf_dir):
    padded = fixture.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("\n "), "text", F.lit(" \t")).alias("text")
    )
    return padded.select("conv_id", "turn", T.clean_response("text").alias("text"))


@query(
    "termination_flags",
    C.sql(
        "SELECT item_id, contains(lower(clause), 'termination') AS has_termination FROM items",
        "items",
    ),
)
def _(spark, sf_dir):
    return fixture.items(spark, sf_dir).select(
        "item_id", T.mentions_word("clause", "termination").alias("has_termination")
    )


@query(
    "merged_metadata",
    C.sql(
        f"""SELECT contract_id, source AS origin, CAST(length(text) AS VARCHAR) AS text_length,
        CAST({C.words('text')} AS VARCHAR) AS word_count FROM contracts""",
        "contracts",
    ),
)
def _(spark, sf_dir):
    user = F.create_map(F.lit("origin"), F.col("source"), F.lit("text_length"), F.lit("to be replaced"))
    system = F.create_map(
        F.lit("text_length"),
        T.text_length("text").cast("string"),
        F.lit("word_count"),
        T.word_count("text").cast("string"),
    )
    merged = fixture.contracts(spark, sf_dir).select("contract_id", R.merge_metadata(user, system).alias("m"))
    return merged.select(
        "contract_id", *[R.lookup("m", k, "").alias(k) for k in ("origin", "text_length", "word_count")]
    )


@query(
    "typed_metadata",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind, value > 10 AS large,
    CAST(length(props) AS INTEGER) AS size, value, 'BIGINT,STRING,BOOLEAN,BIGINT,DOUBLE' AS kinds FROM events""",
)
def _(spark, sf_dir):
    """Keys of the events' own JSON, caller's keys and counted ones in one map; all keep their types."""
    own = R.typed_metadata(
        kind=F.col("event_type"), large=F.col("value") > 10, size=F.lit("to be replaced"), value=F.col("value")
    )
    system = R.typed_metadata(size=F.length("props"))
    events = fixture.table(spark, sf_dir, "events")
    merged = events.select("event_id", R.merge_typed(R.merge_typed(R.typed_from_json("props"), own), system).alias("m"))
    types = {"k": "bigint", "kind": "string", "large": "boolean", "size": "int", "value": "double"}
    return merged.select(
        "event_id",
        *[R.typed_value("m", key, kind).alias(key) for key, kind in types.items()],
        F.concat_ws(",", *[R.kind_of("m", key) for key in types]).alias("kinds"),
    )


@query(
    "metadata_records",
    C.sql(
        f"""SELECT contract_id, CAST(to_json({{'text_length': length(text), 'word_count': {C.words('text')}}})
        AS VARCHAR) AS metadata, length(text) > 0 AS stamped FROM contracts""",
        "contracts",
    ),
)
def _(spark, sf_dir):
    records = fixture.contracts(spark, sf_dir).select("contract_id", R.extraction_metadata("text").alias("m"))
    return records.select(
        "contract_id",
        R.to_json(F.struct("m.text_length", "m.word_count")).alias("metadata"),
        F.col("m.processed_at").isNotNull().alias("stamped"),
    )


@query(
    "map_lookups",
    """SELECT event_id, CAST(coalesce(json_extract_string(props, '$.k'), '0') AS INTEGER) AS k, 0 AS word_count
    FROM events""",
)
def _(spark, sf_dir):
    maps = fixture.table(spark, sf_dir, "events").select(
        "event_id", R.from_json("props", "map<string,int>").alias("m")
    )
    return maps.select(
        "event_id", R.lookup("m", "k", 0).alias("k"), R.lookup("m", "word_count", 0).alias("word_count")
    )


@query(
    "json_records",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    '{"k":' || json_extract_string(props, '$.k') || '}' AS encoded FROM events""",
)
def _(spark, sf_dir):
    decoded = fixture.table(spark, sf_dir, "events").select(
        "event_id", R.from_json("props", "k int").alias("record")
    )
    return decoded.select("event_id", "record.k", R.to_json("record").alias("encoded"))
