"""Sinks, extraction, hooks and the whole job over all contracts, each read back from what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clauseloom.catalog import ctes as C
from clauseloom.catalog import fixture
from clauseloom.catalog.registry import query
from clauseloom.operators import clauses, dense, ingest, prompts, sparse
from clauseloom.options import Options, SearchOptions
from clauseloom.plans import contracts as job
from clauseloom.session import checkpoint_dir
from clauseloom.sources import files, listing, results
from clauseloom.sources.stages import new_folder, save_stage, stage

_SHOWN = ", ".join(f"coalesce({c}_clause, 'No {c} clause found') AS {c}_clause" for c in C.PATTERNS)


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _result_rows(spark, sf_dir):
    """The result table of keyword clauses, with a line of text in place of the summary."""
    contracts = fixture.stored_contracts(spark, sf_dir)
    wide = clauses.with_sentinels(clauses.find_clauses(contracts))
    said = wide.withColumn("summary", F.concat(F.lit('Says "no",\n'), "filename")).drop("filename")
    return results.result_rows(contracts, said)


_ROWS = f"""SELECT contract_id, filename, 'Says "no",' || chr(10) || filename AS summary, {_SHOWN},
  CAST(length(text) AS INTEGER) AS text_length, {C.words('text')} AS word_count FROM wide"""


@query("csv_round_trip", C.sql(_ROWS, "wide"))
def _(spark, sf_dir):
    path = _folder(spark, "csv")
    results.write_csv(_result_rows(spark, sf_dir), path)
    return results.read_csv(spark, path)


@query("json_round_trip", C.sql(_ROWS, "wide"))
def _(spark, sf_dir):
    path = _folder(spark, "json")
    results.write_json(_result_rows(spark, sf_dir), path)
    return results.read_json(spark, path).select(*results.CSV_COLUMNS)


@query("stage_round_trip", C.sql("SELECT contract_id, clause_type, clause, status FROM clauses", "clauses"))
def _(spark, sf_dir):
    stored = save_stage(fixture.clauses(spark, sf_dir), _folder(spark, "clauses"), "clause_type")
    return stored.select("contract_id", "clause_type", "clause", "status")


@query(
    "extracted_texts",
    "SELECT doc_id || '.txt' AS filename, md5(coalesce(text, '')) AS text_md5, "
    "CASE WHEN coalesce(text, '') = '' THEN NULL ELSE 'text' END AS extractor_used FROM documents",
)
def _(spark, sf_dir):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    content = F.coalesce("text", F.lit("")).cast("binary")
    given = fixture.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/in/"), name).alias("path"), name.alias("filename"), content.alias("content")
    )
    return files.extract_texts(given).select("filename", F.md5("text").alias("text_md5"), "extractor_used")


@query(
    "folder_bytes",
    """SELECT coalesce(source, '') AS source, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes,
    0::BIGINT AS hidden FROM documents GROUP BY 1""",
)
def _(spark, sf_dir):
    """All texts written as files, a folder per source; the listing of the folders gives their sizes."""
    target = new_folder(spark, "listed")
    given = fixture.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s-"), F.coalesce("source", F.lit(""))).alias("source"), F.coalesce("text", F.lit("")).alias("text")
    )
    given.write.partitionBy("source").text(target)
    listed = listing.list_folders(spark, f"{target}/source=*")
    folder = F.url_decode(F.regexp_extract("path", "/source=s-([^/]*)/[^/]*$", 1))
    hidden = F.count_if(F.col("filename").rlike("^[_.]"))
    return listed.groupBy(folder.alias("source")).agg(F.sum("length").alias("bytes"), hidden.alias("hidden"))


@query(
    "custom_step",
    C.sql("SELECT contract_id, contains(lower(text), 'terminat') AS has_termination FROM contracts", "contracts"),
)
def _(spark, sf_dir):
    def flag(df):
        return df.withColumn("has_termination", F.lower("text").contains("terminat"))

    return fixture.contracts(spark, sf_dir).transform(flag).select("contract_id", "has_termination")


@query(
    "hash_batches",
    C.sql("SELECT count(*) AS documents, true AS in_range, true AS even FROM listing", "listing"),
)
def _(spark, sf_dir):
    # The hash differs between engines: shown is that every document is in a batch and no batch is far too large.
    dealt = ingest.hash_batches(fixture.listing(spark, sf_dir), "filename", 4)
    sizes = dealt.groupBy("batch_no").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.sum("n").alias("documents"), F.bool_and(F.col("batch_no").between(0, 3)).alias("in_range"),
        (F.max("n") <= 0.4 * F.sum("n")).alias("even"),
    )


@query(
    "chunked_prompts",
    C.sql("SELECT contract_id, chunk_no, task, system, md5(prompt) AS prompt_md5 FROM chunk_prompts", "chunk_prompts"),
)
def _(spark, sf_dir):
    rows = prompts.chunked_prompts(fixture.contracts(spark, sf_dir))
    return rows.select("contract_id", "chunk_no", "task", "system", F.md5("prompt").alias("prompt_md5"))


def _answers(spark, sf_dir):
    """A model that answers by the length of the prompt alone: fails, says that nothing is there, or says something."""

    def model(requests):
        if len(requests) > 1 and any(len(r["prompt"]) % 7 == 0 for r in requests):
            raise RuntimeError("one of them fails")
        answers = []
        for r in requests:
            n = len(r["prompt"])
            absent = "no " + r["task"].upper() + " clause found. " if n % 3 == 0 else "  "
            answers.append(None if n % 7 == 0 else absent if n % 3 == 0 or n % 5 == 0 else f" length {n}\n")
        return answers

    return stage(prompts.answer(prompts.chunked_prompts(fixture.contracts(spark, sf_dir)), model), "answers")


@query("model_answers", C.sql("SELECT contract_id, task, chunk_no, status, value FROM chunk_answers", "chunk_answers"))
def _(spark, sf_dir):
    return _answers(spark, sf_dir).select("contract_id", "task", "chunk_no", "status", "value")


@query(
    "chunked_answers",
    C.sql(
        """SELECT contract_id, task,
        CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'found') THEN 'found' ELSE 'absent' END AS status,
        CASE WHEN NOT bool_or(status = 'error') THEN string_agg(value, ' ' ORDER BY chunk_no) END AS value
        FROM chunk_answers GROUP BY contract_id, task""",
        "chunk_answers",
    ),
)
def _(spark, sf_dir):
    return prompts.chunked_answers(_answers(spark, sf_dir)).select("contract_id", "task", "status", "value")


def _letters(texts):
    """A stand-in for an encoder: how often each letter occurs."""
    return [[float(t.lower().count(chr(c))) for c in range(97, 123)] for t in texts]


@query(
    "embedded_search",
    C.sql(
        """SELECT query_id, rank, item_id, round(score, 6) AS score FROM (
          SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item_id) AS rank
          FROM (
            SELECT q.query_id, i.item_id, list_inner_product(q.v, i.v) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(i.v, i.v)) AS score
            FROM (SELECT query_id, list_transform(range(97, 123),
                    lambda c: CAST(length(text) - length(replace(lower(text), chr(CAST(c AS INTEGER)), '')) AS DOUBLE)) AS v
                  FROM sample_queries) q
            CROSS JOIN (SELECT item_id, list_transform(range(97, 123),
                    lambda c: CAST(length(clause) - length(replace(lower(clause), chr(CAST(c AS INTEGER)), '')) AS DOUBLE)) AS v
                  FROM items) i)) WHERE rank <= 5""",
        "sample_queries",
        "items",
    ),
)
def _(spark, sf_dir):
    # The clauses of labelled contracts are in the cache already; the others are embedded now.
    items = fixture.stored_items(spark, sf_dir)
    labelled = fixture.table(spark, sf_dir, "labels").select(F.format_string("contract_%03d", "doc_id").alias("contract_id"))
    texts = items.select(F.sha2("clause", 256).alias("digest"), F.col("clause").alias("text"), "contract_id")
    known = texts.join(labelled, "contract_id", "left_semi").select("digest", "text").dropDuplicates(["digest"])

    def vectors(rows):
        made = dense.unit_vectors(dense.embed(rows, _letters, "digest", "text"), "digest", "vector")
        return made.withColumnRenamed("item_id", "digest")

    cache = stage(vectors(known), "vectors")
    every = cache.unionByName(vectors(dense.uncached(items, cache, "item_id")))
    index = items.select("item_id", F.sha2("clause", 256).alias("digest")).join(every, "digest")
    asked = dense.embed(fixture.sample_queries(spark), _letters, "query_id", "text")
    unit = dense.unit_vectors(asked, "query_id", "vector").withColumnRenamed("item_id", "query_id")
    hits = dense.nearest(unit, index.select("item_id", "vector"), 5)
    return hits.withColumns({"rank": F.col("rank").cast("long"), "score": F.round("score", 6)})


@query(
    "job_results",
    C.sql(
        f"""SELECT contract_id, filename, s.summary, {_SHOWN}, CAST(length(text) AS INTEGER) AS text_length,
        {C.words('text')} AS word_count FROM wide JOIN summaries s USING (contract_id)""",
        "wide",
        "summaries",
    ),
)
def _(spark, sf_dir):
    options = Options(search=SearchOptions(enabled=False), validate=False)
    return job.run(spark, fixture.raw(spark, sf_dir), options).results.select(*results.CSV_COLUMNS)


@query(
    "job_funnel",
    C.sql(
        """SELECT outcome, (SELECT count(*) FROM screened WHERE coalesce(reason, 'loaded') = outcome) AS documents
        FROM (VALUES ('loaded'), ('no_text'), ('too_short'), ('unsupported')) AS outcomes(outcome)""",
        "screened",
    ),
)
def _(spark, sf_dir):
    options = Options(search=SearchOptions(enabled=False), validate=False)
    funnel = job.run(spark, fixture.raw(spark, sf_dir), options).funnel
    return spark.createDataFrame(sorted(funnel.items()), "outcome string, documents long")


@query(
    "search_all",
    C.sql(
        f"SELECT query_id, count(*) AS hits FROM {C.text_hits('sample_queries')} WHERE rank <= 50 GROUP BY query_id",
        "postings",
        "item_idf",
        "items",
        "sample_queries",
    ),
)
def _(spark, sf_dir):
    # A search for fifty hits gives fifty, where there are as many.
    hits = sparse.search(fixture.sample_queries(spark), fixture.stored_items(spark, sf_dir), 50)
    return hits.groupBy("query_id").agg(F.count("*").alias("hits"))
