"""SQL counterparts of the shared tables, for DuckDB."""

from __future__ import annotations

from clauseloom.taxonomy import CLAUSE_TYPES, SAMPLE_QUERIES, TASKS, clause_type, prompt_frame

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\p{Z}"
WORD = r"\p{L}\p{N}_"
SENTENCE = "[^.!?]+[.!?]*"


def _pattern(keywords: tuple[str, ...]) -> str:
    """Keywords with a word boundary on the left; those under five letters need one on the right as well."""
    each = [f"{k}($|[^{WORD}])" if len(k) < 5 else k for k in keywords]
    return f"(^|[^{WORD}])({'|'.join(each)})"


PATTERNS = {c.name: _pattern(c.keywords) for c in CLAUSE_TYPES}


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '[{WS}]+', ' ', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '[^{WORD} .,;:!?()-]', '', 'g')"


def pages(x: str) -> str:
    return rf"regexp_replace({x}, '(?i)Page \p{{Nd}}+', '', 'g')"


def digits(x: str) -> str:
    return rf"regexp_replace({x}, '^\p{{Nd}}+ *$', '', 'g')"


def normal(x: str) -> str:
    return f"trim({digits(pages(strip(collapse(x))))})"


def words(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '[^{WS}]+')) AS INTEGER)"


def term_list(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^{WORD}]+'), lambda t: t <> '')"


def mentions(x: str, kind: str) -> str:
    return f"regexp_matches(lower({x}), {quote(PATTERNS[kind])})"


_T, _C, _L = (quote(". " + clause_type(n).exemplar) for n in ("termination", "confidentiality", "liability"))
_TYPES = "(VALUES ('termination'), ('confidentiality'), ('liability')) AS kinds(clause_type)"
_TASKS = (
    "(VALUES " + ", ".join(f"('{t.name}', {t.max_tokens}, {t.temperature})" for t in TASKS)
    + ") AS settings(task, max_tokens, temperature)"
)


def _prompts(source: str, text: str, keys: str) -> str:
    """Prompts of all tasks over a text expression of a table."""
    frames = {t.name: prompt_frame(t.name) for t in TASKS}
    return " UNION ALL ".join(
        f"SELECT {keys}, '{name}' AS task, {quote(system)} AS system, {quote(before)} || {text} || {quote(after)} AS prompt "
        f"FROM {source}"
        for name, (system, before, after) in frames.items()
    )


# name -> (names it builds on, body)
_TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "listing": (
        (),
        "SELECT doc_id, doc_id || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.docx' END AS filename, source "
        "FROM documents",
    ),
    "raw": (
        (),
        f"""SELECT doc_id, printf('contract_%03d', doc_id) AS contract_id,
        doc_id || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.docx' END AS filename, source,
        CASE WHEN doc_id % 7 = 0 THEN 'Page ' || doc_id || ' ' ELSE '' END || text
        || CASE WHEN doc_id % 2 = 0 THEN {_T} ELSE '' END
        || CASE WHEN doc_id % 3 = 0 THEN {_C} ELSE '' END
        || CASE WHEN doc_id % 5 = 0 THEN {_L} ELSE '' END AS text
        FROM documents""",
    ),
    "screened": (
        ("raw",),
        f"""SELECT doc_id, contract_id, filename, source, clean AS text,
        CASE WHEN NOT regexp_matches(coalesce(text, ''), '[^{WS}]') THEN 'no_text'
             WHEN length(clean) < 100 THEN 'too_short' END AS reason
        FROM (SELECT *, {normal("coalesce(text, '')")} AS clean FROM raw)""",
    ),
    "contracts": (
        ("screened",),
        "SELECT doc_id, contract_id, filename, source, text FROM screened WHERE reason IS NULL",
    ),
    "sentences": (
        ("contracts",),
        f"""SELECT contract_id, CAST(unnest(range(len(parts))) AS INTEGER) AS pos, unnest(parts) AS sentence
        FROM (SELECT contract_id, regexp_extract_all(text, '{SENTENCE}') AS parts FROM contracts)""",
    ),
    "own_keywords": (
        (),
        # A type per document: its first two words, and its first word of twelve letters or more.
        """SELECT DISTINCT clause_type, keyword FROM (
          SELECT 'type_' || doc_id AS clause_type, unnest([regexp_extract(lower(text), '^[^a-z]*([a-z]+ [a-z]+)', 1),
            regexp_extract(lower(text), '(^|[^a-z])([a-z]{12,})', 2)]) AS keyword FROM documents) WHERE keyword <> ''""",
    ),
    "own_matches": (
        ("sentences", "own_keywords"),
        # Phrases by their whole first word, long words by their first twelve letters.
        f"""SELECT m.contract_id, m.pos, m.sentence, k.clause_type, k.keyword FROM (
          SELECT DISTINCT s.contract_id, s.pos, s.sentence, d.keyword
          FROM (SELECT *, unnest(list_distinct(list_concat(words, list_transform(list_filter(words, lambda w: length(w) >= 12),
                  lambda w: substring(w, 1, 12))))) AS key
                FROM (SELECT *, regexp_extract_all(lower(sentence), '[{WORD}]+') AS words FROM sentences)) s
          JOIN (SELECT DISTINCT keyword FROM own_keywords) d
            ON s.key = CASE WHEN contains(d.keyword, ' ') THEN split_part(d.keyword, ' ', 1) ELSE substring(d.keyword, 1, 12) END
          WHERE contains(lower(s.sentence), d.keyword) AND regexp_matches(lower(s.sentence),
            '(^|[^{WORD}])' || d.keyword || CASE WHEN length(d.keyword) < 5 THEN '($|[^{WORD}])' ELSE '' END)) m
        JOIN own_keywords k USING (keyword)""",
    ),
    "hits": (
        ("sentences",),
        " UNION ALL ".join(
            f"SELECT contract_id, '{kind}' AS clause_type, pos, trim(sentence) AS sentence FROM sentences "
            f"WHERE {mentions('sentence', kind)}"
            for kind in PATTERNS
        ),
    ),
    "found": (
        ("hits",),
        "SELECT contract_id, clause_type, string_agg(sentence, ' ' ORDER BY pos) AS clause FROM hits "
        "GROUP BY contract_id, clause_type",
    ),
    "clauses": (
        ("contracts", "found"),
        f"""SELECT contract_id, filename, clause_type, clause,
        CASE WHEN clause IS NULL THEN 'absent' ELSE 'found' END AS status
        FROM contracts CROSS JOIN {_TYPES} LEFT JOIN found USING (contract_id, clause_type)""",
    ),
    "items": (
        ("clauses",),
        "SELECT contract_id || ':' || clause_type AS item_id, * FROM clauses WHERE status = 'found'",
    ),
    "wide": (
        ("contracts", "found"),
        """SELECT c.doc_id, c.contract_id, c.filename, c.source, c.text,
        max(CASE WHEN clause_type = 'termination' THEN clause END) AS termination_clause,
        max(CASE WHEN clause_type = 'confidentiality' THEN clause END) AS confidentiality_clause,
        max(CASE WHEN clause_type = 'liability' THEN clause END) AS liability_clause
        FROM contracts c LEFT JOIN found f ON c.contract_id = f.contract_id
        GROUP BY c.doc_id, c.contract_id, c.filename, c.source, c.text""",
    ),
    "tasks": (
        ("contracts",),
        f"""SELECT contract_id, doc_id, task, CAST(max_tokens AS INTEGER) AS max_tokens,
        CAST(temperature AS DOUBLE) AS temperature FROM contracts CROSS JOIN {_TASKS}""",
    ),
    "responses": (
        ("contracts", "clauses"),
        """SELECT contract_id, task, CAST(doc_id % 3 + 1 AS INTEGER) AS attempt,
        CASE WHEN doc_id % 11 = 0 THEN 'error' WHEN value IS NULL THEN 'absent' ELSE 'found' END AS status,
        CASE WHEN doc_id % 11 <> 0 THEN value END AS value
        FROM (SELECT doc_id, contract_id, clause_type AS task, clause AS value FROM clauses
              JOIN contracts USING (contract_id)
              UNION ALL SELECT doc_id, contract_id, 'summary', text FROM contracts)""",
    ),
    "results": (
        ("tasks", "responses"),
        """SELECT contract_id, task, coalesce(status, 'error') AS status, value,
        CASE coalesce(status, 'error')
          WHEN 'error' THEN CASE WHEN task = 'summary' THEN 'Error generating summary'
                                 ELSE 'Error extracting ' || task || ' clause' END
          WHEN 'absent' THEN 'No ' || task || ' clause found' ELSE value END AS shown
        FROM tasks LEFT JOIN responses USING (contract_id, task)""",
    ),
    "truth": (
        ("contracts",),
        """SELECT contract_id, 'termination' AS clause_type FROM contracts WHERE doc_id % 2 = 0
        UNION ALL SELECT contract_id, 'confidentiality' FROM contracts WHERE doc_id % 3 = 0
        UNION ALL SELECT contract_id, 'liability' FROM contracts WHERE doc_id % 5 = 0""",
    ),
    "sentence_starts": (
        ("sentences", "contracts"),
        """SELECT contract_id, pos, sentence, total,
        CAST(total - sum(length(sentence)) OVER (PARTITION BY contract_id)
          + coalesce(sum(length(sentence)) OVER (PARTITION BY contract_id ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM sentences JOIN (SELECT contract_id, length(text) AS total FROM contracts) USING (contract_id)""",
    ),
    "windows": (
        ("sentence_starts",),
        " UNION ALL ".join(
            f"SELECT contract_id, '{c.name}' AS clause_type, pos, "
            f"greatest(0, start - {c.context_window}) AS first, "
            f"least(total, start + length(sentence) + {c.context_window}) AS last "
            f"FROM sentence_starts WHERE {mentions('sentence', c.name)}"
            for c in CLAUSE_TYPES
        ),
    ),
    "prompts": (("contracts",), _prompts("contracts", "substring(text, 1, 4000)", "contract_id")),
    "chunks": (
        ("contracts",),
        """SELECT contract_id, CAST(chunk_no AS INTEGER) AS chunk_no, substring(text, chunk_no * 4000 + 1, 4000) AS chunk
        FROM (SELECT contract_id, text, unnest(range(greatest(1, CAST(ceil(length(text) / 4000.0) AS BIGINT))))
              AS chunk_no FROM contracts)""",
    ),
    "chunk_prompts": (("chunks",), _prompts("chunks", "chunk", "contract_id, chunk_no")),
    "chunk_answers": (
        ("chunk_prompts",),
        """SELECT contract_id, task, chunk_no,
        CASE WHEN length(prompt) % 7 = 0 THEN 'error' WHEN length(prompt) % 3 = 0 OR length(prompt) % 5 = 0 THEN 'absent'
             ELSE 'found' END AS status,
        CASE WHEN length(prompt) % 7 <> 0 AND length(prompt) % 3 <> 0 AND length(prompt) % 5 <> 0
             THEN 'length ' || length(prompt) END AS value
        FROM chunk_prompts""",
    ),
    "clean_sentences": (
        ("sentences",),
        "SELECT contract_id, pos, array_to_string("
        "list_filter(string_split(sentence, ' '), lambda w: w <> ''), ' ') AS sentence FROM sentences",
    ),
    "contract_idf": (
        ("contracts",),
        f"""SELECT term, ln((1.0 + (SELECT count(*) FROM contracts)) / (1.0 + count(*))) + 1.0 AS idf
        FROM (SELECT DISTINCT contract_id, unnest({term_list("text")}) AS term FROM contracts) GROUP BY term""",
    ),
    "sentence_scores": (
        ("clean_sentences", "contract_idf"),
        f"""SELECT s.contract_id, s.pos, {words("any_value(s.sentence)")} AS words,
        round(avg(idf) + {" + ".join(f"CAST({mentions('any_value(s.sentence)', k)} AS INTEGER)" for k in PATTERNS)},
              6) AS score
        FROM (SELECT contract_id, pos, sentence, unnest({term_list("sentence")}) AS term FROM clean_sentences) s
        JOIN contract_idf USING (term) GROUP BY s.contract_id, s.pos""",
    ),
    "summaries": (
        ("sentence_scores", "clean_sentences", "contracts"),
        """SELECT c.contract_id, coalesce(string_agg(t.sentence, ' ' ORDER BY t.pos), '') AS summary,
        CAST(coalesce(sum(s.words), 0) AS BIGINT) AS words
        FROM contracts c LEFT JOIN (
          SELECT *, sum(words) OVER by_score AS running, row_number() OVER by_score AS place FROM sentence_scores
          WINDOW by_score AS (PARTITION BY contract_id ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING)
        ) s ON s.contract_id = c.contract_id AND (s.running <= 150 OR s.place = 1)
        LEFT JOIN clean_sentences t ON t.contract_id = s.contract_id AND t.pos = s.pos GROUP BY c.contract_id""",
    ),
    "item_terms": (
        ("items",),
        f"""SELECT item_id, term, count(*) AS n
        FROM (SELECT item_id, unnest({term_list("clause")}) AS term FROM items) GROUP BY item_id, term""",
    ),
    "item_idf": (
        ("item_terms", "items"),
        """SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM items)) / (1.0 + count(*))) + 1.0 AS idf
        FROM item_terms GROUP BY term""",
    ),
    "postings": (
        ("item_terms", "item_idf"),
        """SELECT item_id, term, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY item_id)) AS weight
        FROM item_terms JOIN item_idf USING (term)""",
    ),
    "sample_queries": (
        (),
        "SELECT * FROM (VALUES "
        + ", ".join(f"({i}, {quote(q)})" for i, q in enumerate(SAMPLE_QUERIES, start=1))
        + ") AS asked(query_id, text)",
    ),
    "exemplar_queries": (
        (),
        " UNION ALL ".join(
            f"SELECT {quote(c.name)} AS query_id, {quote(c.exemplar)} AS text" for c in CLAUSE_TYPES
        ),
    ),
    "benchmark_queries": ((), "SELECT item_id AS query_id, text FROM benchmark"),
    "units": (
        (),
        """SELECT vec_id, label, CASE WHEN norm = 0 THEN v ELSE list_transform(v, lambda x: x / norm) END AS v
        FROM (SELECT *, sqrt(list_inner_product(v, v)) AS norm
              FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))""",
    ),
    "label_means": (
        (),
        """SELECT label, list(x ORDER BY pos) AS v FROM (
          SELECT label, pos, avg(x) AS x FROM (
            SELECT label, unnest(range(len(embedding))) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x
            FROM embeddings) GROUP BY label, pos) GROUP BY label""",
    ),
    "label_queries": (
        ("label_means",),
        "SELECT label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM label_means",
    ),
    "label_hits": (
        ("label_queries", "units"),
        """SELECT q.label AS query_id, u.vec_id AS item_id, round(list_inner_product(q.v, u.v), 6) AS score,
        row_number() OVER (PARTITION BY q.label ORDER BY round(list_inner_product(q.v, u.v), 12) DESC, u.vec_id)
          AS rank
        FROM label_queries q CROSS JOIN units u""",
    ),
    "exact_hits": (
        ("units",),
        """SELECT q.vec_id AS query_id, u.vec_id AS item_id, list_inner_product(q.v, u.v) AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.v, u.v), 12) DESC, u.vec_id) AS rank
        FROM (SELECT * FROM units WHERE vec_id % 25 = 0) q CROSS JOIN units u""",
    ),
    "near_cells": (
        ("units", "label_queries"),
        """SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY
          list_inner_product(c, c) - 2 * list_inner_product(v, c), cell) AS place
        FROM units CROSS JOIN (SELECT v AS c, row_number() OVER (ORDER BY label) - 1 AS cell FROM label_queries)""",
    ),
    "cell_hits": (
        ("units", "near_cells"),
        """SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item_id) AS rank
        FROM (SELECT q.vec_id AS query_id, u.vec_id AS item_id, list_inner_product(q.v, u.v) AS score
              FROM (SELECT * FROM units WHERE vec_id % 25 = 0) q
              JOIN (SELECT vec_id, cell FROM near_cells WHERE place <= 2) p ON p.vec_id = q.vec_id
              JOIN (SELECT vec_id, cell FROM near_cells WHERE place = 1) o ON o.cell = p.cell
              JOIN units u ON u.vec_id = o.vec_id)""",
    ),
}


def text_hits(queries: str) -> str:
    """Ranked tf-idf hits of one query table, as a derived table (needs ``postings``)."""
    return f"""(SELECT query_id, item_id, round(score, 6) AS score,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
      FROM (
        SELECT query_id, item_id, round(sum(asked * weight), 12) AS score FROM postings JOIN (
          SELECT query_id, term, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY query_id)) AS asked
          FROM (
            SELECT query_id, term, count(*) AS n,
              coalesce(any_value(i.idf), ln(1.0 + (SELECT count(*) FROM items)) + 1.0) AS idf
            FROM (SELECT query_id, unnest({term_list("text")}) AS term FROM {queries})
            LEFT JOIN item_idf i USING (term) GROUP BY query_id, term)
        ) USING (term) GROUP BY query_id, item_id))"""


def sql(body: str, *tables: str) -> str:
    """A full statement: the shared tables that ``body`` needs, in order, then ``body``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for parent in _TABLES[name][0]:
            add(parent)
        ordered.append(name)

    for name in tables:
        add(name)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({_TABLES[n][1]})" for n in ordered) + "\n" + body
