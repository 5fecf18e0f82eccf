"""Loading, screening, numbering and batching over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.catalog import ctes as C
from clauseloom.catalog import fixture
from clauseloom.catalog.registry import query
from clauseloom.functions import text as T
from clauseloom.operators import ingest, metrics

_LISTED = """(SELECT *, row_number() OVER (ORDER BY CASE WHEN filename LIKE '%.pdf' THEN 0 ELSE 1 END,
  filename, doc_id) AS row_no FROM listing)"""


@query("loaded_contracts", C.sql("SELECT contract_id, filename, source, text FROM contracts", "contracts"))
def _(spark, sf_dir):
    return fixture.contracts(spark, sf_dir).select("contract_id", "filename", "source", "text")


@query(
    "rejects",
    C.sql(
        """SELECT contract_id, filename, reason, CAST(length(text) AS INTEGER) AS text_length FROM screened
        WHERE reason IS NOT NULL""",
        "screened",
    ),
)
def _(spark, sf_dir):
    return ingest.rejected(fixture.screened(spark, sf_dir)).select(
        "contract_id", "filename", "reason", "text_length"
    )


@query(
    "unlifted_rejects",
    f"""SELECT doc_id, CASE WHEN NOT regexp_matches(coalesce(text, ''), '[^{C.WS}]') THEN 'no_text'
      ELSE 'too_short' END AS reason
    FROM documents WHERE length({C.normal("coalesce(text, '')")}) < 100""",
)
def _(spark, sf_dir):
    documents = fixture.table(spark, sf_dir, "documents").select("doc_id", "text")
    return ingest.rejected(ingest.screen(fixture.spread(documents, "doc_id"))).select("doc_id", "reason")


@query(
    "load_funnel",
    C.sql(
        "SELECT coalesce(reason, 'loaded') AS outcome, count(*) AS documents FROM screened GROUP BY 1", "screened"
    ),
)
def _(spark, sf_dir):
    return metrics.load_funnel(fixture.screened(spark, sf_dir))


@query(
    "supported_files",
    C.sql(
        """SELECT doc_id, name FROM (SELECT doc_id, replace(filename, '.docx',
          CASE WHEN source = 'src0' THEN '.odt' ELSE '.DOCX' END) AS name FROM listing)
        WHERE lower(string_split(name, '.')[-1]) IN ('pdf', 'docx', 'txt')""",
        "listing",
    ),
)
def _(spark, sf_dir):
    suffix = F.when(F.col("source") == "src0", ".odt").otherwise(".DOCX")
    renamed = fixture.listing(spark, sf_dir).select(
        "doc_id", F.replace("filename", F.lit(".docx"), suffix).alias("filename")
    )
    return ingest.supported(renamed).withColumnRenamed("filename", "name")


@query(
    "extension_counts",
    C.sql(
        "SELECT string_split(filename, '.')[-1] AS extension, count(*) AS files FROM listing GROUP BY 1", "listing"
    ),
)
def _(spark, sf_dir):
    return metrics.extension_counts(fixture.listing(spark, sf_dir))


@query(
    "source_counts", "SELECT source, count(*) AS files FROM documents GROUP BY source"
)
def _(spark, sf_dir):
    return fixture.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"))


@query(
    "contract_numbers",
    C.sql(f"SELECT doc_id, filename, printf('contract_%03d', row_no) AS contract_id FROM {_LISTED}", "listing"),
)
def _(spark, sf_dir):
    return ingest.assign_contract_ids(fixture.listing(spark, sf_dir), "doc_id").select(
        "doc_id", "filename", "contract_id"
    )


@query(
    "stable_contract_ids",
    C.sql("SELECT doc_id, sha256('/contracts/' || filename) AS contract_id FROM listing", "listing"),
)
def _(spark, sf_dir):
    paths = fixture.listing(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("/contracts/"), "filename").alias("path")
    )
    return ingest.stable_ids(paths).select("doc_id", "contract_id")


@query(
    "first_contracts",
    C.sql(
        f"SELECT doc_id, filename, printf('contract_%03d', row_no) AS contract_id FROM {_LISTED} WHERE row_no <= 50",
        "listing",
    ),
)
def _(spark, sf_dir):
    return ingest.assign_contract_ids(fixture.listing(spark, sf_dir), "doc_id", 50).select(
        "doc_id", "filename", "contract_id"
    )


@query("listing_union", C.sql(f"SELECT row_no, filename FROM {_LISTED}", "listing"))
def _(spark, sf_dir):
    files = fixture.listing(spark, sf_dir)
    extension = T.file_extension("filename")
    both = files.filter(extension == "pdf").unionByName(files.filter(extension == "docx"))
    return ingest.number_listing(both, "doc_id").select("row_no", "filename")


@query(
    "batches",
    C.sql(f"SELECT doc_id, CAST((row_no - 1) // 5 + 1 AS BIGINT) AS batch_no FROM {_LISTED}", "listing"),
)
def _(spark, sf_dir):
    numbered = ingest.number_listing(fixture.listing(spark, sf_dir), "doc_id")
    return ingest.batches(numbered).select("doc_id", "batch_no")


@query(
    "combined_batches",
    C.sql("SELECT contract_id, filename FROM contracts", "contracts"),
)
def _(spark, sf_dir):
    batch = fixture.stored_contracts(spark, sf_dir).select("contract_id", "filename")
    return ingest.combine([batch, batch])


@query(
    "distinct_content",
    "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text",
)
def _(spark, sf_dir):
    documents = fixture.table(spark, sf_dir, "documents").select("doc_id", "text")
    return ingest.distinct_content(documents, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "chunks",
    C.sql(
        """SELECT contract_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(chunk_no * 4000 + 1 AS INTEGER) AS start,
        substring(text, chunk_no * 4000 + 1, 4000) AS chunk
        FROM (SELECT contract_id, text, unnest(range(greatest(1, CAST(ceil(length(text) / 4000.0) AS BIGINT))))
              AS chunk_no FROM contracts)""",
        "contracts",
    ),
)
def _(spark, sf_dir):
    return ingest.chunks(fixture.contracts(spark, sf_dir))
