"""Toxicity from a learned lexicon: misspellings by Levenshtein automata over its trie, quotation by context windows."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import Memo, once_per_worker, require_columns, stage, whole_rows

WORD = re.compile(r"[^\W\d_]+")
JAVA_WORD = r"\p{L}+"
HELD_OUT, FOLDS, CUT = 2, 4, 0.3
# Bound of what is fitted: labelled documents, chosen by a hash of their id. It bounds the terms as well.
MAX_LABELLED = 40_000
WINDOW = 60
QUOTED = 0.3
SHORT = 100
# Evidence, times SCALE, counts in steps of 1/STEPS on a logarithmic scale when scores are fitted.
SCALE, STEPS = 10, 4
MAX_BIN = 40
PRIOR_RATE, PRIOR_ROWS = 0.1, 10
# Marks that open and close a quotation, and words that report one (en, de, fr, es).
QUOTES = "\"“”„«»"
REPORTING = (
    "said wrote called quote quoted quoting term word words sagte schrieb nannte wort zitat "
    "disait appelait terme mot citation dijo llama palabra cita"
).split()


class Lexicon(NamedTuple):
    """Terms with their weights, and the points (evidence bin, score) of the fitted curve."""

    weights: dict[str, float]
    curve: list[tuple[float, float]]


class Trie:
    """A lexicon as tries, searched with the Levenshtein automaton of a word.

    Cut into one part more than edits are allowed, a term keeps at least one part whole in every misspelling. Terms of a
    length that share a part form one trie; the automaton reads those whose part the word has about where it belongs,
    letter by letter, and leaves a path as soon as none of its states is alive, that is, when no beginning of the word
    is within the allowed distance.
    """

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.longest = max(map(len, weights), default=0) + 2
        # Length of terms -> for each of their parts where it starts and ends, and the tries by the part.
        self.parts: dict[int, list[tuple[int, int, dict[str, dict]]]] = {}
        # Size of words -> where they are looked at, and the tries by what stands there.
        self.looks: dict[int, list[tuple[int, int, dict[str, list[tuple[int, dict]]]]]] = {}
        for term in weights:
            n, count = len(term), edits(len(term)) + 1
            if count == 1:
                continue
            if n not in self.parts:
                self.parts[n] = [(n * i // count, n * (i + 1) // count, {}) for i in range(count)]
            for start, end, tries in self.parts[n]:
                node = tries.setdefault(term[start:end], {})
                for char in term:
                    node = node.setdefault(char, {})
                node[""] = term

    def look(self, size: int) -> list[tuple[int, int, dict[str, list[tuple[int, dict]]]]]:
        """Places at which a word of ``size`` letters may have a part whole, with the edits allowed and the tries by it."""
        reach, found = edits(size + 1), {}
        for n in range(size - reach, size + reach + 1):
            allowed = min(reach, edits(n))
            if abs(n - size) > allowed:
                continue
            for start, end, tries in self.parts.get(n, ()):
                if start == 0:
                    shifts = (0,)
                elif end == n:
                    shifts = (size - n,)
                else:  # one edit on either side; with two on one side the part on the other is whole
                    shifts = (-1, 0, 1)
                for by in shifts:
                    own = found.setdefault((start + by, end + by), {})
                    for part, trie in tries.items():
                        own.setdefault(part, []).append((allowed, trie))
        return [(*place, own) for place, own in found.items()]

    def nearest(self, word: str) -> tuple[str, int] | None:
        """The term at the smallest distance within its allowance, the heavier of equals, and that distance."""
        if word in self.weights:
            return word, 0
        size = len(word)
        if size > self.longest:
            return None
        if size not in self.looks:
            self.looks[size] = self.look(size)
        near = [pair for start, end, tries in self.looks[size] for pair in tries.get(word[start:end], ())]
        if not near:
            return None
        # The automaton as bits: bit i of row e says that i letters of the word may be read with e edits.
        places: dict[str, int] = {}
        for i, char in enumerate(word):
            places[char] = places.get(char, 0) | 1 << i
        full = (2 << size) - 1
        best: tuple[int, float, str] | None = None
        for allowed, trie in near:
            stack = [(trie, 1, 3, 7 if allowed > 1 else 0)]
            while stack:
                node, zero, one, two = stack.pop()
                for char, child in node.items():
                    if char == "":
                        distance = 0 if zero >> size else 1 if one >> size else 2 if two >> size else 3
                        if distance <= allowed:
                            best = min(best or (9, 0.0, ""), (distance, -self.weights[child], child))
                        continue
                    here = places.get(char, 0)
                    zero_ = (zero & here) << 1
                    one_ = ((one & here) << 1 | zero | zero << 1 | zero_ << 1) & full
                    two_ = ((two & here) << 1 | one | one << 1 | one_ << 1) & full if allowed > 1 else 0
                    if zero_ or one_ or two_:
                        stack.append((child, zero_, one_, two_))
        return None if best is None else (best[2], best[0])


def edits(length: int) -> int:
    """Edits allowed for a term of a length: short words change their sense too easily."""
    return 0 if length < 5 else 1 if length < 10 else 2


class Reader:
    """Reads evidence out of texts."""

    def __init__(self, weights: dict[str, float]) -> None:
        trie = Trie(weights)

        def weigh(word: str) -> float:
            found = trie.nearest(word)
            return weights[found[0]] * 0.5 ** found[1] if found else 0.0

        self.words = Memo(weigh, 250_000)

    def evidence(self, text: str) -> float:
        """Weights of the terms in a text, summed; a term in quotation counts ``QUOTED`` of its weight.

        Beyond ``SHORT`` words the sum is divided by the root of the length: a long text holds some term by chance.
        """
        low = text.lower()
        words = WORD.findall(low)
        if not any(map(self.words.__getitem__, words)):
            return 0.0
        total, places = 0.0, None
        for found in WORD.finditer(low):
            weight = self.words[found[0]]
            if not weight:
                continue
            if places is None:
                places = [i for i, c in enumerate(low) if c in QUOTES]
            total += weight * (QUOTED if quoted(low, found.start(), found.end(), places) else 1.0)
        return total / math.sqrt(max(1.0, len(words) / SHORT))


def quoted(text: str, start: int, end: int, places: list[int]) -> bool:
    """Whether a term stands in quotation: marks on both sides within the window, or a reporting word before it."""
    n = bisect.bisect_left(places, start)
    opened = n % 2 == 1 and places[n - 1] >= start - WINDOW and n < len(places) and places[n] <= end + WINDOW
    return opened or any(w in REPORTING for w in WORD.findall(text[max(0, start - WINDOW) : start])[-3:])


def evidence(text: str, weights: dict[str, float]) -> Column:
    """Evidence of a text column; null counts as empty."""

    @F.pandas_udf("double")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = once_per_worker(("toxicity", hash(tuple(weights.items()))), lambda: Reader(weights))
        for texts in batches:
            yield pd.Series([reader.evidence(t) if t else 0.0 for t in texts], dtype="float64")

    return read(F.col(text))


def held_out(doc_id: str) -> Column:
    """Whether a row is left out of learning; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _labelled(documents: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, text, toxic) of the documents to learn from.

    At most about ``limit`` labels are taken, by a hash of the id, so they can be broadcast and texts stay in place.
    """
    require_columns(labels, "doc_id", "toxic")
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    single = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, limit / max(1, single.count()))
    chosen = single.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def learn_terms(labelled: DataFrame) -> dict[str, float]:
    """Terms that are more frequent in toxic documents than chance over all words explains, with log-odds weights.

    A term's log-likelihood ratio has to exceed the logarithm of the number of words tried, so that with any size of
    corpus about one word gets in by chance at most.
    """
    totals = labelled.agg(F.sum("toxic"), F.count("*")).first()
    toxic, rows = int(totals[0] or 0), int(totals[1])
    if not 0 < toxic < rows:
        return {}
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(JAVA_WORD), F.lit(0)))
    some = F.filter(words, lambda w: F.length(w) >= 3)
    counts = stage(
        labelled.select("toxic", F.explode(some).alias("word"))
        .groupBy("word")
        .agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
        .filter(F.col("n") >= 3),
        "word-counts",
    )
    rate = toxic / rows
    share = F.col("t") / F.col("n")
    ratio = F.col("t") * F.log(share / rate) + F.when(share < 1, (F.col("n") - F.col("t")) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (rows - toxic + 1))
    tried = counts.count()
    found = (
        counts.filter(share > rate)
        .filter(ratio > math.log(max(2, tried)))
        .select("word", F.least(weight, F.lit(5.0)).alias("weight"), ratio.alias("ratio"))
        .orderBy(F.desc("ratio"), "word")
    )
    return {r["word"]: float(r["weight"]) for r in found.collect() if r["weight"] > 0}


def _bin(strength: Column) -> Column:
    return F.least(F.floor(F.log1p(strength * SCALE) * STEPS), F.lit(MAX_BIN)).cast("int")


def fit_curve(counts: list[tuple[int, int, int]]) -> list[tuple[float, float]]:
    """Points (bin, share of toxic documents) that never fall, from (bin, rows, toxic rows).

    Shares are drawn towards a prior; neighbouring bins out of order are pooled until the shares rise.
    """
    pools: list[list[float]] = []  # [rows, toxic rows, first bin, last bin]
    share = lambda p: (p[1] + PRIOR_RATE * PRIOR_ROWS) / (p[0] + PRIOR_ROWS)
    for place, rows, toxic in sorted(counts):
        pools.append([rows, toxic, place, place])
        while len(pools) > 1 and share(pools[-2]) >= share(pools[-1]):
            rows_, toxic_, _, last = pools.pop()
            pools[-1][0] += rows_
            pools[-1][1] += toxic_
            pools[-1][3] = last
    return [((p[2] + p[3]) / 2, share(p)) for p in pools] or [(0.0, PRIOR_RATE)]


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Lexicon:
    """Learn terms and the score curve from labelled rows that are not held out; only words of texts are inputs."""
    labelled = _labelled(documents, labels, max_labelled)
    weights = learn_terms(labelled)
    read = labelled.select("toxic", evidence("text", weights).alias("strength"))
    bins = read.groupBy(_bin(F.col("strength")).alias("bin")).agg(F.count("*"), F.sum("toxic")).collect()
    return Lexicon(weights, fit_curve([tuple(r) for r in bins]))


def scored(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(row, score): the documents with a score from 0 to 1: the curve, straight between its points."""
    place = F.least(F.log1p(evidence("text", lexicon.weights) * SCALE) * STEPS, F.lit(float(MAX_BIN)))
    (first, value), *rest = lexicon.curve
    column = F.lit(value)
    low, low_value = first, value
    for high, high_value in rest:
        along = F.lit(low_value) + (F.col("place") - low) * ((high_value - low_value) / (high - low))
        column = F.when(F.col("place") > low, F.least(along, F.lit(high_value))).otherwise(column)
        low, low_value = high, high_value
    return whole_rows(documents, place.alias("place")).select("row", column.alias("score"))


def toxicity(documents: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; predicted is 1 where score >= ``cut``.

    Whole texts are read; null and empty texts have no evidence and get the lowest score. Rows that repeat are scored
    each, a null doc_id stays null and is scored alike, other columns are ignored, an empty table gives no rows. Without
    labels the lexicon is empty and every score is the prior. Nothing but word counts of labelled documents is shuffled.
    """
    require_columns(documents, "doc_id", "text")
    lexicon = fit(documents, labels)
    rows = scored(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lexicon)
    return rows.select("row.doc_id", "score").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )


def clean_documents(documents: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents whose score is below ``cut``, with all their columns."""
    return scored(documents, fit(documents, labels)).filter(F.col("score") < cut).select("row.*")
