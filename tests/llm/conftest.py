import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside, as columns of the input.
CLASHING = (
    "row raw id hash score place kinds segment uid fingerprint content entry digest keeper copies u v n ids offset "
    "sequence_id template purity host path rule verdict rank width shard block _id _raw"
).split()


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """Documents with awkward rows: nulls, empty, blank and long texts, ties, repeats; and columns with clashing names."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    hexes = "0123456789abcdef" * 2
    odd = [
        (5, None), (5, None), (None, ""), (None, "a b"), (None, "a b"), (7000, "a  b"), (7001, "a b"), (7001, "a b"),
        (7002, "A b"), (7003, " \t\n"), (7004, "word " * 30_000), (7005, "x" * 50_000),
        (7006, f"é😀 Password: 'abc' token=secret: abcdefgh123 {hexes}x AKIA1234567890ABCD"),
        (7007, f"-----BEGIN RSA PRIVATE KEY----- http://u:p@host api_key={hexes} APIKEY=:12345678 ghp_{'a' * 40}"),
        (7008, "<s> </s> <|endoftext|> [INST] ▁ ▁▁x   \x00 ﬁ İ"),
    ]
    odd = spark.createDataFrame(odd, "doc_id long, text string")
    both = given.unionByName(odd, allowMissingColumns=True).withColumns({c: F.lit("x") for c in CLASHING})
    # Stored, so that every reading gives the same rows.
    from clauseloom.sources.stages import stage

    return stage(both, "test-documents")


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
