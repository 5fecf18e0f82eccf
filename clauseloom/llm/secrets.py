"""Secret scans over a trigram inverted index, with DataFrame functions only."""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from functools import reduce
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import raw_hash, require_columns, stage, whole_rows


class Rule(NamedTuple):
    """A kind of secret. Patterns keep to what Java, RE2 and Python read alike; ``least`` bounds the length of the
    group ``value`` (0: the whole match), and shorter matches are dropped after matching."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 0


# The three base kinds, in the order in which spans at one place are listed.
BASE = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        value=2,
        least=8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Further kinds.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("login", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._-]+@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE
MASK = "[SECRET]"
MAX_WAYS = 64
ROW = ("doc_id", "raw")


def _runs(items: list, ways: list[list[str]]) -> list[list[str]]:
    """Extend every way to match, a list of literal runs of which the last is still open, by parsed items."""
    for kind, value in items:
        if kind is op.LITERAL:
            options = [[chr(value)]]
        elif kind is op.SUBPATTERN:
            options = _runs(list(value[-1]), [[""]])
        elif kind is op.BRANCH:
            options = [w for branch in value[1] for w in _runs(list(branch), [[""]])]
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
            options = [[chr(v)] for _, v in value]
        elif kind is op.MAX_REPEAT and value[1] == 1:
            options = [[""]] + _runs(list(value[2]), [[""]])
        elif kind is op.MAX_REPEAT and value[0] >= 1 and len(value[2]) == 1 and value[2][0][0] is op.LITERAL:
            options = [[chr(value[2][0][1]) * value[0], ""]] if value[1] != value[0] else [[chr(value[2][0][1]) * value[0]]]
        else:
            options = [["", ""]]  # anything: the run ends, another begins
        if len(ways) * len(options) > MAX_WAYS:
            options = [["", ""]]
        ways = [[*w[:-1], w[-1] + o[0], *o[1:]] for w, o in product(ways, options)]
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The Boolean query of a pattern: a match holds all trigrams of at least one of these sets, in lower case.

    Empty if some way to match has no trigram of its own; such a rule has to read every text.
    """
    found = set()
    for way in _runs(list(parser.parse(pattern)), [[""]]):
        grams = frozenset(run[i : i + 3].lower() for run in way for i in range(len(run) - 2) if run.isascii())
        if not grams:
            return []
        found.add(grams)
    # A set that holds another one says nothing more.
    return sorted((s for s in found if not any(o < s for o in found)), key=sorted)


def _rows(documents: DataFrame) -> DataFrame:
    require_columns(documents, "doc_id", "text")
    return documents.select("doc_id", raw_hash("text").alias("raw"), F.coalesce("text", F.lit("")).alias("text"))


def _holds(low: Column, grams: frozenset[str]) -> Column:
    return reduce(Column.__and__, [F.contains(low, F.lit(g)) for g in sorted(grams)])


def may_match(text: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a text satisfies the query of any indexed rule."""
    sets = {s for r in rules for s in trigram_query(r.pattern)}
    low = F.lower(text)
    return reduce(Column.__or__, [_holds(low, s) for s in sorted(sets, key=sorted)], F.lit(False))


def postings(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index (trigram, doc_id, raw), of the trigrams that the rules' queries name."""
    grams = sorted({g for r in rules for s in trigram_query(r.pattern) for g in s})
    low = _rows(documents).select(*ROW, F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select(*ROW, F.explode(present).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, raw, kinds): documents in the intersection of the postings of some trigram set of a rule.

    The sets are few and fixed by the rules, so each posting is matched with them in its row; counting how many
    trigrams of a set a document has intersects the postings, summed inside each task before anything is shuffled.
    """
    sets = [(r.kind, s) for r in rules for s in trigram_query(r.pattern)]
    of: dict[str, list[int]] = {}
    for n, (_, grams) in enumerate(sets):
        for g in grams:
            of.setdefault(g, []).append(n)
    named = F.create_map(*[F.lit(x) for g, ns in sorted(of.items()) for x in (g, ns)])
    kind_of = F.array(*[F.lit(kind) for kind, _ in sets])
    size_of = F.array(*[F.lit(len(grams)) for _, grams in sets])
    met = index.distinct().select(*ROW, F.explode(named[F.col("trigram")]).alias("n")).groupBy(*ROW, "n").count()
    full = met.filter(F.col("count") == F.get(size_of, F.col("n")))
    return full.groupBy(*ROW).agg(F.collect_set(F.get(kind_of, F.col("n"))).alias("kinds"))


def _matches(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, raw, kind, start, end) of all matches of ``rules`` in rows (doc_id, raw, text, kinds).

    A text is cut at the matches; the lengths of what lies between them and of the matches add up to the places.
    """
    cut = F.array_compact(
        F.array(
            *[
                F.when(
                    F.array_contains("kinds", r.kind) & F.col("text").rlike(r.pattern),
                    F.struct(
                        F.lit(r.kind).alias("kind"),
                        F.lit(n).alias("n"),
                        F.split("text", r.pattern, -1).alias("between"),
                        F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("found"),
                    ),
                )
                for n, r in enumerate(rules)
            ]
        )
    )
    # The number tells rows apart that repeat both doc_id and text.
    each = rows.select(F.monotonically_increasing_id().alias("uid"), *ROW, F.inline(cut))
    pairs = each.select(
        "uid", *ROW, "kind", "n",
        F.posexplode(F.arrays_zip(F.transform("between", F.length).alias("before"), F.col("found").alias("match"))),
    ).select("uid", *ROW, "kind", "n", "pos", F.col("col.before").alias("before"), F.col("col.match").alias("match"))
    so_far = Window.partitionBy("uid", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("before") + F.coalesce(F.length("match"), F.lit(0))).over(so_far)
    long_enough = reduce(
        lambda column, r: column.when(
            F.col("kind") == r.kind, F.length(F.regexp_extract("match", r.pattern, r.value)) >= r.least
        ),
        [r for r in rules if r.least],
        F.when(F.lit(False), True),
    ).otherwise(True)
    placed = pairs.withColumn("end", end).filter(F.col("match").isNotNull() & long_enough)
    return placed.select(*ROW, "kind", "n", (F.col("end") - F.length("match")).alias("start"), "end").distinct()


def spans(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, raw, kind, n, start, end): every secret in every whole text, in code points, end exclusive.

    ``n`` is the rule's number. Rules with mandatory trigrams are checked in the candidates that the index gives;
    rules without scan every text in place. The candidates' scan repeats the query as a filter, so of the texts
    only candidates are shuffled, to meet the kinds to check. Texts that repeat both doc_id and text count once here.
    """
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    scanned = tuple(r for r in rules if r not in indexed)
    rows = _rows(documents)
    found = []
    if indexed:
        index = stage(postings(documents, indexed), "postings")
        chosen = candidates(index, indexed).select(F.col("doc_id").alias("_id"), F.col("raw").alias("_raw"), "kinds")
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("raw") == F.col("_raw"))
        texts = rows.filter(may_match("text", indexed)).join(chosen, same)
        found.append(_matches(texts, indexed))
    if scanned:
        every = rows.withColumn("kinds", F.array(*[F.lit(r.kind) for r in scanned]))
        found.append(_matches(every, scanned))
    number = {r.kind: n for n, r in enumerate(rules)}
    order = F.create_map(*[F.lit(x) for item in number.items() for x in item])
    return reduce(DataFrame.unionByName, found).withColumn("n", order[F.col("kind")])


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: (doc_id, n_assign, n_access, n_hex, base_sha256, spans).

    ``spans`` lists kind:start:end by start, then by the rules' order, joined by commas; ``base_sha256`` is the digest
    of the base kinds' list. A null text counts as empty, a null doc_id stays null, repeated rows give repeated rows,
    other columns are ignored, an empty table gives no rows.
    """
    entry = F.struct("start", "n", "end", "kind")
    listed = spans(documents, rules).groupBy(*ROW).agg(F.sort_array(F.collect_list(entry)).alias("all"))
    shown = listed.select(
        F.col("doc_id").alias("_id"),
        F.col("raw").alias("_raw"),
        *[_number_of(r.kind).alias(f"n_{r.kind}") for r in BASE],
        _join(F.filter("all", lambda s: s["n"] < len(BASE))).alias("base"),
        _join(F.col("all")).alias("spans"),
    )
    rows = _rows(documents).select(*ROW)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("raw") == F.col("_raw"))
    none = F.lit(0).cast("long")
    return rows.join(shown, same, "left").select(
        "doc_id",
        *[F.coalesce(f"n_{r.kind}", none).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def _number_of(kind: str) -> Column:
    return F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")


def _join(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(documents: DataFrame, rules: tuple[Rule, ...] = RULES, by: str = MASK) -> DataFrame:
    """The documents with every secret replaced by ``by``; ``n_chars``, if there, is the new length.

    Rows, columns and all other text stay. Texts that no rule can match are passed on where they are.
    """
    scanned = [r for r in rules if not trigram_query(r.pattern)]
    touched = may_match("text", rules)
    for r in scanned:
        touched = touched | F.col("text").rlike(r.pattern)
    touched = F.coalesce(touched, F.lit(False))
    # Overlapping spans become one: a span begins anew where it starts at or after all earlier ends.
    before = Window.partitionBy(*ROW).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*ROW).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("int")
    islands = (
        spans(documents, rules).withColumn("new", new).withColumn("island", F.sum("new").over(upto))
        .groupBy(*ROW, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone"))
    )
    some = whole_rows(
        documents.filter(touched), F.col("doc_id").alias("id"), raw_hash("text").alias("hash"), F.col("text").alias("full")
    )
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("raw"))
    end_before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("gone", i - 1)["end"]).cast("int")
    kept = F.transform(
        "gone", lambda s, i: F.concat(F.col("full").substr(end_before(i) + 1, s["start"].cast("int") - end_before(i)), F.lit(by))
    )
    rest = F.col("full").substr((F.element_at("gone", -1)["end"] + 1).cast("int"), F.length("full"))
    masked = F.when(F.col("gone").isNull(), F.col("full")).otherwise(F.concat(F.array_join(kept, ""), rest))
    done = some.join(islands, same, "left").select("row", masked.alias("masked"))
    row = F.col("row").withField("text", F.col("masked"))
    if "n_chars" in documents.columns:
        row = row.withField("n_chars", F.length("masked").cast(documents.schema["n_chars"].dataType))
    return documents.filter(~touched).unionByName(done.select(row.alias("row")).select("row.*"))
