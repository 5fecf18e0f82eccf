"""The queries that SQL can express, as DuckDB SQL."""

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
), g AS (SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY content)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.content) AS text_sha256
FROM d JOIN g USING (content)
"""


def _spans_cte(name: str, pattern: str, value: int, least: int, number: int) -> str:
    """Matches of one rule: the text is cut at them, and lengths add up to places."""
    keep = f"AND length(regexp_extract(m, '{pattern}', {value})) >= {least}" if least else ""
    return f"""
  SELECT doc_id, '{name}' AS kind, {number} AS n, e - length(m) AS s, e FROM (
    SELECT doc_id, m, sum(length(b) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id ORDER BY pos) AS e
    FROM (
      SELECT doc_id, unnest(string_split_regex(text, '{pattern}')) AS b, unnest(regexp_extract_all(text, '{pattern}')) AS m,
             generate_subscripts(string_split_regex(text, '{pattern}'), 1) AS pos
      FROM d WHERE regexp_matches(text, '{pattern}')
    )
  ) WHERE m IS NOT NULL {keep}"""


def secrets_sql(rules: tuple, n_base: int) -> str:
    """Every rule over every whole text, without an index. ``rules``: (kind, pattern, value, least)."""
    each = "\n  UNION ALL".join(
        _spans_cte(r.kind, r.pattern.replace("'", "''"), r.value, r.least, n) for n, r in enumerate(rules)
    )
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, n), '')"
    base = f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, n) FILTER (n < {n_base}), '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules[:n_base])
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({each})
SELECT d.doc_id, {counts}, sha256({base}) AS base_sha256, {listed} AS spans
FROM d LEFT JOIN (SELECT doc_id AS id, kind, n, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM found) f ON d.doc_id = f.id
GROUP BY d.doc_id
"""


def chats_sql(start: str, text: str, next_: str, end: str, controls: str) -> str:
    """The digests of formatted conversations. Escapes add one sign per control string; what is read back is the input."""

    def extra(column: str) -> str:
        return f"len(regexp_extract_all({column}, '[<\\[]\\\\*(?:{controls})'))"

    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS same
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + {extra('text')} + CASE WHEN same THEN {len(next_)}
    ELSE length(role) + {extra('role')} + {len(start) + len(text) + len(end) + 1} END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def near_sets_sql(shingle: int, percent: int) -> str:
    """Every two documents that share a shingle, their whole sets compared; groups by following links."""
    words = " || ' ' || ".join(f"ws[i + {k}]" for k in range(shingle))
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({lower}, '[\\x20\\x09-\\x0D]+'), lambda s: s <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {shingle} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {shingle - 2}), lambda i: {words})) END AS items FROM w
), sh AS (SELECT doc_id, len(items) AS n, unnest(items) AS s FROM sets),
link AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, v FROM reach JOIN link ON link.u = reach.r
), least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(items) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM sets s JOIN least l ON l.doc_id = s.doc_id
"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_CRC32 = """xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))))"""

# One tree per source and one (number -1) over them, level by level; then every leaf climbs with its siblings.
MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf("CASE WHEN even THEN replace(text, chr(10), '') ELSE text END")} AS given
  FROM (SELECT *, coalesce({_CRC32} % 2 = 0, false) AS even FROM documents)
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, given) - 1 AS place,
    count(*) OVER (PARTITION BY source) AS size FROM leaves
), up AS (
  SELECT tree, 0 AS level, place, size, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM up WHERE size > 1
  GROUP BY tree, level, place // 3, size
), over_up AS (
  SELECT -1 AS tree, 0 AS level, tree AS place, count(*) OVER () AS size, digest FROM up WHERE size = 1
  UNION ALL
  SELECT tree, level + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM over_up WHERE size > 1
  GROUP BY tree, level, place // 3, size
), every AS (SELECT * FROM up UNION ALL SELECT * FROM over_up),
sides AS (
  SELECT tree, level, place, size, digest,
    coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM every WINDOW run AS (PARTITION BY tree, level, place // 3 ORDER BY place)
), climb AS (
  SELECT row_number() OVER () AS r, doc_id, leaf, tree AS home, tree, 0 AS level, place, '' AS proof, given AS now FROM placed
  UNION ALL
  SELECT r, doc_id, leaf, home, CASE WHEN s.size > 1 THEN c.tree ELSE -1 END, CASE WHEN s.size > 1 THEN c.level + 1 ELSE 0 END,
    CASE WHEN s.size > 1 THEN c.place // 3 ELSE c.tree END,
    CASE WHEN s.size > 1 THEN proof || before || after ELSE proof END,
    CASE WHEN s.size > 1 THEN sha256(before || now || after) ELSE now END
  FROM climb c JOIN sides s ON s.tree = c.tree AND s.level = c.level AND s.place = c.place
  WHERE s.size > 1 OR c.tree >= 0
), ends AS (SELECT c.* FROM climb c JOIN sides s ON s.tree = c.tree AND s.level = c.level AND s.place = c.place WHERE c.tree = -1 AND s.size = 1)
SELECT e.doc_id, e.leaf, u.digest AS subroot, o.digest AS root, sha256(proof) AS proof_sha256, now AS folded_root,
  now = o.digest AS verified
FROM ends e JOIN up u ON u.tree = e.home AND u.size = 1, (SELECT digest FROM over_up WHERE size = 1) o
"""
