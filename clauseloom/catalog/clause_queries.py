"""Finding, joining and judging clauses over all contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.catalog import ctes as C
from clauseloom.catalog import fixture
from clauseloom.catalog.registry import query
from clauseloom.functions import text as T
from clauseloom.operators import clauses, ingest, metrics, passages, typed, validate
from clauseloom.taxonomy import CLAUSE_COLUMNS, CLAUSE_TYPES

_COVERAGE = " ".join(
    f"WHEN '{c.name}' THEN "
    + " + ".join(f"CAST(contains(lower(clause), '{e}') AS INTEGER)" for e in c.required_elements)
    for c in CLAUSE_TYPES
)
_REQUIRED = " ".join(f"WHEN '{c.name}' THEN {len(c.required_elements)}" for c in CLAUSE_TYPES)
_EXEMPLARS = " UNION ALL ".join(
    f"SELECT '{c.name}' AS clause_type, unnest({C.term_list(C.quote(c.exemplar))}) AS term" for c in CLAUSE_TYPES
)


@query("sentences", C.sql("SELECT contract_id, pos, trim(sentence) AS sentence FROM sentences", "sentences"))
def _(spark, sf_dir):
    return clauses.sentence_rows(fixture.contracts(spark, sf_dir))


@query("keyword_hits", C.sql("SELECT contract_id, clause_type, pos, sentence FROM hits", "hits"))
def _(spark, sf_dir):
    return clauses.hit_rows(fixture.contracts(spark, sf_dir))


@query(
    "keyword_counts",
    C.sql(
        "SELECT contract_id, clause_type, CAST(count(*) AS INTEGER) AS hit_sentences, "
        "CASE clause_type "
        + " ".join(
            f"WHEN '{c.name}' THEN concat_ws(', ', "
            + ", ".join(
                f"CASE WHEN bool_or(regexp_matches(lower(sentence), '(^|[^{C.WORD}]){k}"
                + (f"($|[^{C.WORD}])" if k == "end" else "")
                + f"')) THEN '{k}' END"
                for k in c.keywords
            )
            + ")"
            for c in CLAUSE_TYPES
        )
        + " END AS keywords FROM hits GROUP BY contract_id, clause_type",
        "hits",
    ),
)
def _(spark, sf_dir):
    return clauses.keyword_counts(fixture.contracts(spark, sf_dir))


@query(
    "presence_matrix",
    C.sql(
        "SELECT contract_id, "
        + ", ".join(f"CAST({c} IS NOT NULL AS INTEGER) AS has_{c.removesuffix('_clause')}" for c in CLAUSE_COLUMNS)
        + " FROM wide",
        "wide",
    ),
)
def _(spark, sf_dir):
    return clauses.presence_matrix(fixture.contracts(spark, sf_dir))


@query(
    "sentence_offsets",
    C.sql(
        "SELECT contract_id, pos, start, CAST(length(sentence) AS INTEGER) AS length FROM sentence_starts",
        "sentence_starts",
    ),
)
def _(spark, sf_dir):
    return passages.sentence_offsets(fixture.contracts(spark, sf_dir))


@query(
    "context_windows",
    C.sql(
        """SELECT contract_id, clause_type, pos, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last,
        substring(text, first + 1, last - first) AS passage FROM windows JOIN contracts USING (contract_id)""",
        "windows",
        "contracts",
    ),
)
def _(spark, sf_dir):
    return passages.context_windows(fixture.contracts(spark, sf_dir))


@query(
    "merged_passages",
    C.sql(
        """SELECT contract_id, clause_type, pos, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last,
        substring(text, first + 1, last - first) AS passage
        FROM (
          SELECT contract_id, clause_type, island, min(pos) AS pos, min(first) AS first, max(last) AS last FROM (
            SELECT *, sum(CASE WHEN reach IS NULL OR reach < first THEN 1 ELSE 0 END) OVER (
              PARTITION BY contract_id, clause_type ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island
            FROM (SELECT *, max(last) OVER (PARTITION BY contract_id, clause_type ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM windows))
          GROUP BY contract_id, clause_type, island) JOIN contracts USING (contract_id)""",
        "windows",
        "contracts",
    ),
)
def _(spark, sf_dir):
    return passages.merged_passages(fixture.contracts(spark, sf_dir))


@query(
    "clause_table",
    C.sql(
        "SELECT contract_id, filename, "
        + ", ".join(
            f"coalesce({c}, 'No {c.removesuffix('_clause')} clause found') AS {c}" for c in CLAUSE_COLUMNS
        )
        + " FROM wide",
        "wide",
    ),
)
def _(spark, sf_dir):
    return clauses.with_sentinels(fixture.wide(spark, sf_dir)).select("contract_id", "filename", *CLAUSE_COLUMNS)


@query("clause_rows", C.sql("SELECT contract_id, filename, clause_type, clause, status FROM clauses", "clauses"))
def _(spark, sf_dir):
    return fixture.clauses(spark, sf_dir)


@query(
    "absent_clauses",
    C.sql(
        """SELECT contract_id, clause_type, coalesce(clause, 'No ' || clause_type || ' clause found') AS shown
        FROM clauses""",
        "clauses",
    ),
)
def _(spark, sf_dir):
    return fixture.clauses(spark, sf_dir).select(
        "contract_id", "clause_type", clauses.sentinel("clause_type", "status", "clause").alias("shown")
    )


@query(
    "indexable_clauses",
    C.sql("SELECT contract_id, clause_type, filename, clause FROM items", "items"),
)
def _(spark, sf_dir):
    return clauses.indexable(fixture.clauses(spark, sf_dir)).select("contract_id", "clause_type", "filename", "clause")


@query(
    "indexable_by_value",
    C.sql(
        """SELECT contract_id, task, shown FROM results WHERE task <> 'summary' AND shown <> ''
        AND NOT starts_with(shown, 'No ') AND NOT starts_with(shown, 'Error')""",
        "results",
    ),
)
def _(spark, sf_dir):
    from clauseloom.operators.prompts import task_results, tasks

    contracts = fixture.stored_contracts(spark, sf_dir)
    results = task_results(tasks(contracts), fixture.responses(contracts))
    shown = results.filter(F.col("task") != "summary").withColumnRenamed("shown", "clause")
    return clauses.indexable(shown, by_value=True).select("contract_id", "task", F.col("clause").alias("shown"))


@query(
    "element_coverage",
    C.sql(
        f"""SELECT item_id, CAST(found AS INTEGER) AS elements_found, CAST(required AS INTEGER) AS elements_required,
        round(found / required, 6) AS coverage
        FROM (SELECT item_id, CASE clause_type {_COVERAGE} END AS found, CASE clause_type {_REQUIRED} END AS required
              FROM items)""",
        "items",
    ),
)
def _(spark, sf_dir):
    return clauses.element_coverage(fixture.items(spark, sf_dir)).select(
        "item_id", "elements_found", "elements_required", F.round("coverage", 6).alias("coverage")
    )


@query(
    "exemplar_similarity",
    C.sql(
        f"""SELECT i.item_id, round(coalesce(dot, 0) / sqrt(own * sample), 6) AS score
        FROM items i
        JOIN (SELECT item_id, sum(n * n) AS own FROM item_terms GROUP BY item_id) USING (item_id)
        JOIN (SELECT clause_type, sum(m * m) AS sample FROM (
          SELECT clause_type, term, count(*) AS m FROM ({_EXEMPLARS}) GROUP BY ALL) GROUP BY clause_type)
          USING (clause_type)
        LEFT JOIN (SELECT t.item_id, sum(t.n * e.m) AS dot FROM item_terms t
          JOIN items x USING (item_id)
          JOIN (SELECT clause_type, term, count(*) AS m FROM ({_EXEMPLARS}) GROUP BY ALL) e
            ON e.clause_type = x.clause_type AND e.term = t.term GROUP BY t.item_id) USING (item_id)""",
        "items",
        "item_terms",
    ),
)
def _(spark, sf_dir):
    return clauses.exemplar_similarity(fixture.items(spark, sf_dir)).select(
        "item_id", F.round("exemplar_score", 6).alias("score")
    )


@query(
    "contracts_with_clauses",
    C.sql(
        "SELECT contract_id, filename FROM contracts WHERE contract_id IN (SELECT contract_id FROM found)",
        "contracts",
        "found",
    ),
)
def _(spark, sf_dir):
    return clauses.with_any_clause(
        fixture.contracts(spark, sf_dir).select("contract_id", "filename"), fixture.items(spark, sf_dir)
    )


@query(
    "best_chunks",
    C.sql(
        "SELECT contract_id, clause_type, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(hits AS INTEGER) AS hits FROM ("
        "SELECT *, row_number() OVER (PARTITION BY contract_id, clause_type ORDER BY hits DESC, chunk_no) AS rn FROM ("
        + " UNION ALL ".join(
            f"SELECT contract_id, '{k}' AS clause_type, chunk_no, count(*) AS hits FROM parts "
            f"WHERE {C.mentions('sentence', k)} GROUP BY contract_id, chunk_no"
            for k in C.PATTERNS
        )
        + ")) WHERE rn = 1",
        "contracts",
    ).replace(
        "\nSELECT contract_id, clause_type, CAST(chunk_no",
        f""", parts AS (SELECT contract_id, chunk_no,
          unnest(regexp_extract_all(substring(text, chunk_no * 4000 + 1, 4000), '{C.SENTENCE}')) AS sentence
        FROM (SELECT contract_id, text, unnest(range(CAST(ceil(length(text) / 4000.0) AS BIGINT))) AS chunk_no
              FROM contracts))
SELECT contract_id, clause_type, CAST(chunk_no""",
        1,
    ),
)
def _(spark, sf_dir):
    return clauses.best_chunks(ingest.chunks(fixture.contracts(spark, sf_dir)))


@query(
    "detection_rate",
    C.sql(
        """SELECT clause_type, count(*) AS contracts, count(clause) AS found,
        round(count(clause) / count(*), 6) AS rate FROM clauses GROUP BY clause_type""",
        "clauses",
    ),
)
def _(spark, sf_dir):
    return metrics.detection_rate(fixture.wide(spark, sf_dir))


_REPORT = """SELECT source, clause_type, CAST(GROUPING(source, clause_type) AS BIGINT) AS level, count(*) AS checked,
  count(clause) AS found, round(count(clause) / count(*), 6) AS rate
FROM clauses JOIN (SELECT contract_id, source FROM contracts) USING (contract_id)
GROUP BY {grouping}"""


@query(
    "detection_rollup", C.sql(_REPORT.format(grouping="ROLLUP (source, clause_type)"), "clauses", "contracts")
)
def _(spark, sf_dir):
    return metrics.detection_report(fixture.wide(spark, sf_dir))


@query("detection_cube", C.sql(_REPORT.format(grouping="CUBE (source, clause_type)"), "clauses", "contracts"))
def _(spark, sf_dir):
    return metrics.detection_report(fixture.wide(spark, sf_dir), kind="cube")


@query(
    "detection_subtotals",
    C.sql(
        """SELECT source, clause_type, count(*) AS checked, count(clause) AS found
        FROM clauses JOIN (SELECT contract_id, source FROM contracts) USING (contract_id)
        GROUP BY GROUPING SETS ((source), (clause_type))""",
        "clauses",
        "contracts",
    ),
)
def _(spark, sf_dir):
    return metrics.detection_subtotals(fixture.wide(spark, sf_dir))


@query(
    "detection_accuracy",
    C.sql(
        """SELECT clause_type, count(*) FILTER (t = 1 AND p = 1) AS true_positive,
        count(*) FILTER (t IS NULL) AS false_positive, count(*) FILTER (p IS NULL) AS false_negative,
        round(count(*) FILTER (t = 1 AND p = 1) / nullif(count(p), 0), 6) AS precision,
        round(count(*) FILTER (t = 1 AND p = 1) / nullif(count(t), 0), 6) AS recall
        FROM (SELECT *, 1 AS t FROM truth) FULL JOIN (SELECT contract_id, clause_type, 1 AS p FROM found)
        USING (contract_id, clause_type) GROUP BY clause_type""",
        "truth",
        "found",
    ),
)
def _(spark, sf_dir):
    contracts = fixture.stored_contracts(spark, sf_dir)
    found = clauses.indexable(clauses.clause_rows(clauses.find_clauses(contracts)))
    return metrics.detection_accuracy(fixture.truth(contracts), found)


@query(
    "index_counts",
    C.sql(
        "SELECT coalesce(clause_type, 'all') AS clause_type, count(*) AS clauses FROM items "
        "GROUP BY ROLLUP (clause_type)",
        "items",
    ),
)
def _(spark, sf_dir):
    return metrics.index_counts(fixture.items(spark, sf_dir))


@query(
    "contracts_per_type",
    C.sql(
        "SELECT clause_type, count(DISTINCT contract_id) AS contracts FROM items GROUP BY clause_type", "items"
    ),
)
def _(spark, sf_dir):
    return metrics.contracts_per_type(fixture.items(spark, sf_dir))


@query(
    "contracts_per_type_approx",
    C.sql(
        "SELECT clause_type, count(DISTINCT contract_id) AS contracts, true AS close FROM items GROUP BY clause_type",
        "items",
    ),
)
def _(spark, sf_dir):
    # The sketch itself differs between engines: shown are the exact count and whether the sketch is near it.
    items = fixture.items(spark, sf_dir).select("clause_type", "contract_id")
    sketched = metrics.contracts_per_type(items, approximate=True).withColumnRenamed("contracts", "sketch")
    both = metrics.contracts_per_type(items).join(sketched, "clause_type")
    close = F.abs(F.col("sketch") - F.col("contracts")) <= F.greatest(F.lit(1.0), 0.15 * F.col("contracts"))
    return both.select("clause_type", "contracts", close.alias("close"))


@query(
    "length_distribution",
    C.sql(
        """SELECT measure, count(*) AS contracts, min(value) AS low, max(value) AS high,
        round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90
        FROM (SELECT 'text_length' AS measure, CAST(length(text) AS BIGINT) AS value FROM contracts
              UNION ALL SELECT 'word_count', CAST("""
        + C.words("text")
        + " AS BIGINT) FROM contracts) GROUP BY measure",
        "contracts",
    ),
)
def _(spark, sf_dir):
    return metrics.length_distribution(fixture.contracts(spark, sf_dir))


@query(
    "clause_violations",
    C.sql(
        """SELECT contract_id, 'filename_missing' AS rule FROM clauses JOIN contracts USING (contract_id)
        WHERE source = 'src0'
        UNION ALL SELECT contract_id, 'text_without_found' FROM clauses WHERE clause_type = 'liability'
        AND status = 'found'
        UNION ALL SELECT contract_id, 'status_unknown' FROM clauses WHERE clause_type = 'liability'
        AND status = 'found'""",
        "clauses",
        "contracts",
    ),
)
def _(spark, sf_dir):
    # Two faults are planted: one source loses its file names, liability clauses get a made-up status.
    found = F.col("status") == "found"
    damaged = clauses.clause_rows(fixture.wide(spark, sf_dir), ["contract_id", "filename", "source"]).withColumns(
        {
            "filename": F.when(F.col("source") != "src0", F.col("filename")),
            "status": F.when((F.col("clause_type") == "liability") & found, "maybe").otherwise(F.col("status")),
        }
    )
    return validate.violations(damaged, validate.clause_rules(), "contract_id")


@query(
    "term_counts",
    C.sql(
        f"""SELECT contract_id, CAST(len({C.term_list('text')}) AS INTEGER) AS terms FROM contracts""", "contracts"
    ),
)
def _(spark, sf_dir):
    return fixture.contracts(spark, sf_dir).select("contract_id", F.size(T.terms("text")).alias("terms"))


def _own_keywords(spark, sf_dir):
    """(clause_type, keyword): a type per document, of its first two words and its first word of twelve letters or more."""
    lowered = F.lower("text")
    found = F.array(
        F.regexp_extract(lowered, "^[^a-z]*([a-z]+ [a-z]+)", 1), F.regexp_extract(lowered, "(^|[^a-z])([a-z]{12,})", 2)
    )
    rows = fixture.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("type_"), "doc_id").alias("clause_type"), F.explode(found).alias("keyword")
    )
    return typed.compile_keywords(rows.filter("keyword <> ''"))


@query(
    "own_type_hits",
    C.sql("SELECT DISTINCT contract_id, clause_type, pos, trim(sentence) AS sentence FROM own_matches", "own_matches"),
)
def _(spark, sf_dir):
    return typed.hit_rows(fixture.contracts(spark, sf_dir), _own_keywords(spark, sf_dir))


@query(
    "own_type_counts",
    C.sql(
        """SELECT contract_id, clause_type, count(DISTINCT pos) AS hit_sentences, count(DISTINCT keyword) AS keywords,
        count(*) AS matches FROM own_matches GROUP BY contract_id, clause_type""",
        "own_matches",
    ),
)
def _(spark, sf_dir):
    return typed.keyword_counts(fixture.contracts(spark, sf_dir), _own_keywords(spark, sf_dir))


@query(
    "own_type_clauses",
    C.sql(
        """SELECT contract_id, filename, clause_type, string_agg(sentence, ' ' ORDER BY pos) AS clause, 'found' AS status
        FROM (SELECT DISTINCT contract_id, clause_type, pos, trim(sentence) AS sentence FROM own_matches)
        JOIN contracts USING (contract_id) GROUP BY contract_id, filename, clause_type""",
        "own_matches",
        "contracts",
    ),
)
def _(spark, sf_dir):
    return typed.find_clauses(fixture.contracts(spark, sf_dir), _own_keywords(spark, sf_dir))
