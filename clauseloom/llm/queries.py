"""The operators as queries over the given tables, with the columns that are agreed for each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import (
    byte_bpe,
    chat_format,
    exact_dedup,
    merkle,
    minhash,
    neighbours,
    packing,
    secrets,
    simhash,
    sql,
    token_counts,
    toxicity,
    url_filter,
    whitening,
)
from clauseloom.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one whose texts look like control strings, read back from their format."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat_format.digests(chat_format.format_chats(given.unionByName(tricky)))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, and which document of each stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of secrets in every document."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and their text again."""
    return byte_bpe.encode_and_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of every 50th vector."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every document by the share of shingles that texts have in common."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, and whether the document as it is now still leads to the root."""
    return merkle.proofs(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_chat_format, op3_exact_dedup, op4_packing, op5_secrets, op6_url_filter, op7_toxicity,
        op8_byte_bpe, op9_simhash, op10_neighbours, op11_minhash, op12_whitening, op13_merkle,
    )
}
ORACLES = {
    "op2_chat_format": sql.chats_sql(
        chat_format.START, chat_format.TEXT, chat_format.NEXT, chat_format.END, chat_format.CONTROLS
    ),
    "op3_exact_dedup": sql.EXACT_DEDUP,
    "op11_minhash": sql.near_sets_sql(minhash.SHINGLE, minhash.PERCENT),
    "op13_merkle": sql.MERKLE,
    "op5_secrets": sql.secrets_sql(secrets.RULES, len(secrets.BASE)),
}
