"""The whole job: documents in, result tables out, and search over the clauses found."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.operators import clauses, dense, ingest, inverted, metrics, prompts, sparse, summary, typed, validate
from clauseloom.options import Options
from clauseloom.sources import files as file_source
from clauseloom.sources import results as result_sink
from clauseloom.sources.stages import deal, save_stage, stage, stage_by_key
from clauseloom.sources.vector_store import add_vectors, read_vectors


@dataclass(frozen=True)
class Run:
    """Tables of a finished run; each is stored or derived from stored tables.

    ``funnel`` holds documents per outcome, ``loaded`` or a reason for rejection; it adds up to the listing.
    """

    contracts: DataFrame
    rejects: DataFrame
    clauses: DataFrame
    results: DataFrame
    responses: DataFrame | None = None
    items: DataFrame | None = None
    term_weights: DataFrame | None = None
    postings: DataFrame | None = None
    index: inverted.TermIndex | None = None
    vectors: DataFrame | None = None
    violations: DataFrame | None = None
    funnel: Mapping[str, int] = field(default_factory=dict)


def load(
    spark: SparkSession,
    source: str | DataFrame,
    options: Options = Options(),
    extractors: Mapping[str, Sequence[file_source.Extractor]] | None = None,
) -> DataFrame:
    """Documents with ``contract_id``, ``filename`` and raw ``text``.

    ``source`` is a folder of files or a table. A table without ``contract_id`` must have a unique ``path``; contracts
    then get one: a digest of the path, or numbers in listing order if asked for. Only the listing is ever ordered, and
    texts of files beyond ``max_contracts`` are not extracted.
    """
    limit = options.ingest.max_contracts
    if isinstance(source, str):
        documents = file_source.read_files(spark, source, options.ingest.supported_formats)
    elif "contract_id" in source.columns:
        return source if limit is None else ingest.first_documents(source, limit, "contract_id")
    else:
        documents = source

    names = documents.select("path", "filename")
    if options.ingest.sequential_ids:
        names = ingest.assign_contract_ids(names, "path", limit).drop("filename")
    elif limit is not None:
        names = ingest.first_documents(names, limit, "path").select("path")
    if limit is not None:
        documents = documents.join(names.select("path"), "path", "left_semi")
    texts = file_source.extract_texts(documents, extractors) if isinstance(source, str) else documents
    return texts.join(names, "path") if options.ingest.sequential_ids else ingest.stable_ids(texts)


def _unsupported(spark: SparkSession, source: str | DataFrame, options: Options) -> DataFrame | None:
    """Reject rows of a folder's files whose format is not asked for."""
    if not isinstance(source, str):
        return None
    others = file_source.other_files(spark, source, options.ingest.supported_formats)
    return ingest.stable_ids(others).select("contract_id", "path", "filename", F.lit("unsupported").alias("reason"))


def _ask(contracts: DataFrame, model: prompts.Model, options: Options, store) -> DataFrame:
    """Answers of the model to all tasks about every chunk; what failed is asked again, up to the allowed attempts.

    Every round is stored before the next one starts, so no call is ever repeated by a recomputation.
    """
    keys = ["contract_id", "task", "chunk_no"]
    questions = prompts.chunked_prompts(contracts, options.ingest.chunk_size, options.model)
    responses = store(prompts.answer(questions, model), "responses-1")
    for attempt in range(2, options.model.max_attempts + 1):
        pending = prompts.pending_tasks(questions, responses, options.model.max_attempts, keys)
        again = questions.join(pending.select(*keys), keys, "left_semi")
        answers = store(prompts.answer(again, model, attempt), f"responses-{attempt}")
        if answers.isEmpty():
            break
        responses = responses.unionByName(answers)
    return responses


def _embed(
    items: DataFrame, embedder: dense.Embedder, cache: DataFrame | str | None, options: Options, store
) -> DataFrame:
    """(digest, vector) of every clause text, of unit length; texts in the cache are not embedded again."""
    spark = items.sparkSession
    known = cache if options.search.cache_embeddings else None
    if isinstance(known, str):
        held = read_vectors(spark, known)
    elif known is not None:
        held = known.select("digest", "vector")
    else:
        held = spark.createDataFrame([], "digest string, vector array<double>")
    new = dense.uncached(items, held, "item_id")
    vectors = dense.unit_vectors(dense.embed(new, embedder, "digest", "text"), "digest", "vector")
    made = vectors.select(F.col("item_id").alias("digest"), "vector")
    if isinstance(known, str):
        return add_vectors(known, made)
    # Only what is new is stored; the cache stays where the caller has it.
    made = store(made, "vectors")
    return made if known is None else made.unionByName(held)


def run(
    spark: SparkSession,
    source: str | DataFrame,
    options: Options = Options(),
    model: prompts.Model | None = None,
    extractors: Mapping[str, Sequence[file_source.Extractor]] | None = None,
    embedder: dense.Embedder | None = None,
    vector_cache: DataFrame | str | None = None,
    taxonomy: DataFrame | None = None,
) -> Run:
    """Load, screen, find clauses, summarise, write the sinks asked for, and index the clauses.

    With a ``model`` it answers prompts about every chunk of every text; without one, clauses are found by keyword and
    summaries are extractive. With an ``embedder`` clauses also get vectors, kept by digest; a ``vector_cache``
    saves those already made: the ``vectors`` of an earlier run, or the folder of a store that this run adds to. A ``taxonomy`` (clause_type, keyword) adds the caller's own
    clause types, found by keyword in any case; they are in ``clauses`` and can be searched like the built-in ones, and
    a type of a built-in name replaces it there. Rejected documents, also those without a byte or in a
    format not asked for, are stored with their reason. Raises ``ValueError`` if no document is accepted.
    """
    output = options.output

    def store(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        if output.stage_path:
            return save_stage(df, f"{output.stage_path.rstrip('/')}/{name}", partition_by)
        return stage(df, name)

    # Summaries join texts by contract; a folder of the caller's holds plain files, without a catalog. Rows are dealt
    # before they are counted: tasks before a shuffle can run again, and would count twice.
    laid_out = model is None and not output.stage_path
    documents = load(spark, source, options, extractors)
    documents = ingest.screen(deal(documents, "contract_id") if laid_out else documents, options.ingest)
    documents, screening = metrics.observed_funnel(documents, ingest.REASONS)
    if laid_out:
        screened = stage_by_key(documents, "screened", "contract_id", dealt=True)
    else:
        screened = store(documents, "screened")
    contracts = ingest.accepted(screened)
    rejects = ingest.rejected(screened)
    unsupported = _unsupported(spark, source, options)
    if unsupported is not None:
        rejects = rejects.unionByName(unsupported, allowMissingColumns=True)
    rejects, rejecting = metrics.observed_funnel(rejects, ["unsupported"])
    rejects = store(rejects, "rejects")
    funnel = {**screening.get, "unsupported": rejecting.get["unsupported"]}
    if contracts.isEmpty():
        raise ValueError("no contracts loaded")

    responses = None
    if model is None:
        texts = contracts.select("contract_id", "filename", "text")
        found = store(clauses.find_clauses(texts).drop("text"), "found")
        long = clauses.clause_rows(found)
        shown = clauses.with_sentinels(found).drop("filename")
        summaries = summary.summarize(contracts).select("contract_id", "summary")
        wide = shown.join(summaries, "contract_id", "left")
    else:
        responses = _ask(contracts, model, options, store)
        answers = prompts.chunked_answers(responses)
        results = store(prompts.task_results(prompts.tasks(contracts.select("contract_id")), answers), "answers")
        names = contracts.select("contract_id", "filename")
        long = results.filter(F.col("task") != "summary").join(names, "contract_id").select(
            "contract_id", "filename", F.col("task").alias("clause_type"), F.col("value").alias("clause"), "status"
        )
        wide = prompts.wide_results(results)
    if taxonomy is not None:
        compiled = typed.compile_keywords(taxonomy)
        own = typed.find_clauses(contracts.select("contract_id", "filename", "text"), compiled)
        names = compiled.select("clause_type").distinct()
        long = long.join(names, "clause_type", "left_anti").select(*own.columns).unionByName(own)
        # As many folders as types would be too many.
        long = store(long, "clauses")
    elif output.stage_path or model is not None:
        long = store(long, "clauses", "clause_type")

    rows = store(result_sink.result_rows(contracts, wide), "results")
    if output.csv_path:
        result_sink.write_csv(rows, output.csv_path)
    if output.json_path:
        result_sink.write_json(rows, output.json_path, output.include_full_text, output.include_metadata)

    items = weights = postings = index = vectors = None
    if options.search.enabled:
        items = clauses.indexable(long).withColumn("item_id", F.concat_ws(":", "contract_id", "clause_type"))
        weights = store(sparse.term_weights(items), "term-weights")
        index = inverted.build(items, weights, store=store)
        postings = index.vectors
        if embedder is not None:
            vectors = _embed(items, embedder, vector_cache, options, store)
    rules = validate.result_rules(longest_text=options.ingest.max_text_length)
    return Run(
        contracts=contracts,
        rejects=rejects,
        clauses=long,
        results=rows,
        responses=responses,
        items=items,
        term_weights=weights,
        postings=postings,
        index=index,
        vectors=vectors,
        violations=validate.violations(rows, rules, "contract_id") if options.validate else None,
        funnel=funnel,
    )


def search(
    finished: Run, queries: DataFrame, k: int = 5, options: Options = Options(), embedder: dense.Embedder | None = None
) -> DataFrame:
    """Top-k clauses per query text with contract, type, file and clause text.

    ``queries`` is (query_id, text). With an ``embedder`` the vectors of the run are searched, else its terms. A
    ``max_results`` option caps ``k``; hits below ``similarity_threshold`` are dropped. Without an index there are none.
    """
    schema = "query_id string, rank int, score double, contract_id string, clause_type string, filename string, clause string"
    if finished.items is None or (embedder is not None and finished.vectors is None):
        return queries.sparkSession.createDataFrame([], schema)
    if options.search.max_results is not None:
        k = min(k, options.search.max_results)
    if embedder is None:
        hits = inverted.search(queries, finished.items, k, finished.index)
    else:
        asked = dense.unit_vectors(dense.embed(queries, embedder, "query_id", "text"), "query_id", "vector")
        digests = finished.items.select("item_id", F.sha2("clause", 256).alias("digest"))
        index = digests.join(finished.vectors, "digest").select("item_id", "vector")
        hits = dense.nearest(asked.withColumnRenamed("item_id", "query_id"), index, k)
    if options.search.similarity_threshold is not None:
        hits = sparse.above(hits, options.search.similarity_threshold)
    return sparse.attach(hits, finished.items).select(
        "query_id", "rank", "score", "contract_id", "clause_type", "filename", "clause"
    )
