"""Short extractive summaries and their quality checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseloom.functions import text as T
from clauseloom.operators.clauses import mentions, mentions_lowered
from clauseloom.sources.stages import stage
from clauseloom.taxonomy import CLAUSE_TYPES

MIN_WORDS = 100
MAX_WORDS = 150
# As many of the most frequent terms are looked up without a shuffle.
FREQUENT = 100_000
# Bytes of text that are split at a time.
SLICE_BYTES = 2 << 20
# What a character is: inside a term, white space, or the end of a sentence.
_TERM, _SPACE, _STOP = 1, 2, 3


def inverse_frequency(df: Column, total: Column) -> Column:
    """Smoothed inverse document frequency: ln((1 + N) / (1 + df)) + 1."""
    return F.log((F.lit(1.0) + total) / (F.lit(1.0) + df)) + 1.0


def _kinds(spark: SparkSession) -> np.ndarray:
    """For each code point whether a text in lower case has it inside a term, as white space or as a stop.

    Spark's own expressions say so, one character each: what tasks split by this table is split as ``text.terms`` does.
    """
    points = spark.range(0x110000).filter(~F.col("id").between(0xD800, 0xDFFF))
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    told = points.select("id", (F.size(T.lowered_terms(char)) > 0).alias("word"), char.rlike(f"[{T.WHITESPACE}]").alias("space"))
    found = told.filter("word OR space").toArrow()
    kinds = np.zeros(0x200000, np.uint8)  # as many as four bytes of UTF-8 can say
    kinds[found["id"].to_numpy()] = np.where(found["word"].to_numpy(), _TERM, _SPACE)
    kinds[[ord(c) for c in ".!?"]] = _STOP
    return kinds


class Characters:
    """Some texts of an Arrow batch, all in lower case, with what each byte is: places are in bytes from the first text on."""

    def __init__(self, texts: pa.Array, kinds: np.ndarray) -> None:
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        self.bounds = ends - ends[0]
        self.kinds = kinds[self.data]
        # A character of several bytes has its kind at each of them.
        lead = np.flatnonzero(self.data >= 0xC0)
        point = self.data[lead].astype(np.int64)
        size = 2 + (point >= 0xE0) + (point >= 0xF0)
        point &= 0x7F >> size
        for n in range(1, 4):
            longer = size > n
            point[longer] = point[longer] << 6 | self.data[lead[longer] + n] & 0x3F
        for n in range(4):
            longer = size > n
            self.kinds[lead[longer] + n] = kinds[point[longer]]
        self.term = self.kinds == _TERM
        self.starts = np.flatnonzero(self.runs(self.term, self.bounds))

    def runs(self, inside: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where a run of ``inside`` begins; one that goes on over a bound begins again."""
        after = np.zeros(len(inside), bool)
        after[1:] = inside[:-1]
        after[bounds[bounds < len(inside)]] = False
        return inside & ~after


class _Split(Characters):
    """Texts with the terms in them."""

    def __init__(self, texts: pa.Array, kinds: np.ndarray) -> None:
        super().__init__(texts, kinds)
        term = self.term
        begin = np.append(np.cumsum(term, dtype=np.int32)[self.starts] - 1, np.count_nonzero(term)).astype(np.int32)
        held = pa.py_buffer(begin), pa.py_buffer(self.data[term])
        terms = pa.StringArray.from_buffers(len(self.starts), *held).dictionary_encode()
        self.codes, self.terms = terms.indices.to_numpy(), terms.dictionary

    def owners(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each term the one of the given pieces, which hold all terms, that it is in."""
        return np.repeat(np.arange(len(begin)), np.searchsorted(self.starts, end) - np.searchsorted(self.starts, begin))

    def sentences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, begin, end) of the sentences, as ``text.sentences`` has them."""
        begin = np.flatnonzero(self.runs(self.kinds != _STOP, self.bounds))
        text = np.searchsorted(self.bounds, begin, side="right") - 1
        end = np.minimum(np.append(begin[1:], len(self.data)), self.bounds[text + 1])
        return text, begin, end

    def words(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of white-space separated words of each piece."""
        at = np.flatnonzero(self.runs(self.kinds != _SPACE, begin))
        return (np.searchsorted(at, end) - np.searchsorted(at, begin)).astype(np.int32)


def _slices(rows: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts have about ``SLICE_BYTES`` together; a longer text is a part of its own."""
    ends = np.cumsum(pc.binary_length(rows.column(text)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield rows.slice(at, upto - at)
        at = upto


def document_frequency(rows: DataFrame, text: str, name: str = "df") -> DataFrame:
    """Number of rows whose text holds each term; one output row per term."""
    shared = rows.sparkSession.sparkContext.broadcast(_kinds(rows.sparkSession))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows per term and Arrow batch leave the task.
        for batch in batches:
            made = []
            for part in _slices(batch, 0):
                own = _Split(part.column(0), shared.value)
                pairs = np.sort(own.owners(own.bounds[:-1], own.bounds[1:]) * len(own.terms) + own.codes)
                pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
                n = np.bincount(pairs % max(len(own.terms), 1), minlength=len(own.terms))
                made.append(pa.table([own.terms, pa.array(n, pa.int64())], ["term", "n"]))
            if made:
                counts = pa.concat_tables(made).group_by("term").aggregate([("n", "sum")])
                yield from counts.select(["term", "n_sum"]).rename_columns(["term", "n"]).to_batches()

    lowered = rows.select(F.coalesce(F.lower(text), F.lit("")).alias("text"))
    return lowered.mapInArrow(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias(name))


def _most_frequent(idf: DataFrame, limit: int) -> pa.Table:
    """(term, idf) of the most frequent terms, by steps of their counts as many as ``limit`` allows."""
    stepped = idf.withColumn("_step", F.floor(F.log2("df") * 8))
    least, n = None, 0
    # Eight steps for each doubling of the counts: a few hundred rows.
    for row in sorted(stepped.groupBy("_step").agg(F.count("*").alias("n")).collect(), reverse=True):
        n += row["n"]
        if n > limit:
            break
        least = row["_step"]
    return stepped.filter(F.col("_step") >= least if least is not None else F.lit(False)).select("term", "idf").toArrow()


def _sentence_sums(contracts: DataFrame, idf: DataFrame, hit_bonus: float) -> DataFrame:
    """(contract_id, pos, words, bonus, total, terms): the sum of ``idf`` over each sentence's terms, rows dealt by contract.

    Frequent terms, a bounded list, are looked up where the sentence is, some texts at a time. A sentence leaves the
    task as one row, with its sum and its rare terms, and with its text only if that holds a keyword of a clause type;
    rare terms alone are shuffled by term.
    """
    keys = ["contract_id", "pos", "words", "bonus"]
    spark = contracts.sparkSession
    near = _most_frequent(idf, FREQUENT)
    shared = spark.sparkContext.broadcast((near["term"].to_pylist(), near["idf"].to_pylist(), _kinds(spark)))
    keywords = sorted({k for c in CLAUSE_TYPES for k in c.keywords})
    columns = ["contract_id", "pos", "words", "said", "total", "terms", "rare"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, kinds = pa.array(shared.value[0], pa.string()), np.array([*shared.value[1], 0.0]), shared.value[2]
        for part in (p for batch in batches for p in _slices(batch, 1)):
            own = _Split(part.column(1), kinds)
            text, begin, end = own.sentences()
            if not len(text):
                continue
            pos = np.arange(len(text)) - np.searchsorted(text, text)
            at = pc.index_in(own.terms, value_set=known).fill_null(len(known)).to_numpy(zero_copy_only=False)[own.codes]
            owner = own.owners(begin, end)
            total = np.bincount(owner, weights[at], len(text)).astype(float)  # without any term they are integers
            terms = np.bincount(owner, minlength=len(text))
            rare = at == len(known)
            offsets = np.append(0, np.cumsum(np.bincount(owner[rare], minlength=len(text))))
            others = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), own.terms.take(pa.array(own.codes[rare])))
            # One string a sentence; stops before a text's first sentence go with the sentence before, and hold no keyword.
            buffers = [pa.py_buffer(np.append(begin, len(own.data))), pa.py_buffer(own.data)]
            sentences = pa.LargeStringArray.from_buffers(len(text), *buffers)
            said = np.zeros(len(text), bool)
            for keyword in keywords:
                said |= pc.match_substring(sentences, keyword).to_numpy(zero_copy_only=False)
            made = [part.column(0).take(pa.array(text)), pa.array(pos, pa.int32()), pa.array(own.words(begin, end))]
            made += [sentences.take(pa.array(np.arange(len(text)), mask=~said)).cast(pa.string())]
            made += [pa.array(total, pa.float64()), pa.array(terms, pa.int64()), others]
            yield pa.RecordBatch.from_arrays(made, columns)

    lowered = contracts.select("contract_id", F.coalesce(F.lower("text"), F.lit("")).alias("text"))
    key = contracts.schema["contract_id"].dataType.simpleString()
    split = lowered.mapInArrow(
        summed, f"contract_id {key}, pos int, words int, said string, total double, terms long, rare array<string>"
    )
    hits = reduce(lambda a, b: a + b, [mentions_lowered(F.col("said"), c.keywords).cast("int") for c in CLAUSE_TYPES])
    bonus = F.when(F.col("said").isNotNull(), hits * F.lit(hit_bonus)).otherwise(F.lit(0 * hit_bonus)).alias("bonus")
    # Stored, as the sentences are read for their sums and for their rare terms.
    sums = stage(split.select("contract_id", "pos", "words", bonus, "total", "terms", "rare"), "sentence-sums")
    rare = sums.select(*keys, F.explode("rare").alias("term")).join(idf.select("term", "idf"), "term")
    rest = rare.select(*keys, F.col("idf").alias("total"), F.lit(0).cast("long").alias("terms"))
    every = sums.select(*keys, "total", "terms").filter("terms > 0").unionByName(rest).repartition("contract_id")
    return every.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("terms").alias("terms"))


def summarize(contracts: DataFrame, max_words: int = MAX_WORDS, hit_bonus: float = 1.0) -> DataFrame:
    """Extractive summary per contract: (contract_id, summary, words); every contract gets a row.

    A sentence scores the mean inverse document frequency of its terms plus ``hit_bonus`` per clause type it
    mentions. Sentences are taken whole, by score, while their words add up to at most ``max_words``, then put back
    into document order; the best one is taken whatever its length, and ``length_check`` tells of it. A contract
    without any scorable sentence has an empty summary. Expects normalised text, from a stored table: it is read several
    times. From one laid out by contract (see ``stages.stage_by_key``) no text is moved: terms are summed and chosen
    positions joined where the texts are.
    """
    n_contracts = contracts.agg(F.count("*")).scalar()
    frequency = stage(document_frequency(contracts, "text"), "document-frequency")
    idf = frequency.withColumn("idf", inverse_frequency(F.col("df"), n_contracts))
    scored = _sentence_sums(contracts, idf, hit_bonus).withColumn("score", F.round(F.col("total") / F.col("terms") + F.col("bonus"), 6))
    best_first = Window.partitionBy("contract_id").orderBy(F.desc("score"), "pos")
    running = F.sum("words").over(best_first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = (
        scored.withColumn("running", running)
        .withColumn("place", F.row_number().over(best_first))
        .filter((F.col("running") <= max_words) | (F.col("place") == 1))
        .groupBy("contract_id")
        .agg(F.collect_list("pos").alias("chosen"), F.sum("words").alias("words"))
    )
    # At most ``max_words`` positions are chosen, for a sentence has at least one word.
    own = F.filter(T.sentences("text"), lambda _, i: F.array_contains("chosen", i))
    picked = F.transform(own, lambda s: F.array_join(F.array_remove(F.split(s, " +"), ""), " "))
    # Positions are few beside the texts: hashing them keeps the texts from being sorted.
    texts = contracts.select("contract_id", "text").join(chosen.hint("shuffle_hash"), "contract_id", "left")
    return texts.select(
        "contract_id",
        F.coalesce(F.array_join(picked, " "), F.lit("")).alias("summary"),
        F.coalesce("words", F.lit(0)).cast("long").alias("words"),
    )


def length_check(summaries: DataFrame, low: int = MIN_WORDS, high: int = MAX_WORDS) -> DataFrame:
    """Add ``words`` and ``in_range``: whether the summary keeps to the asked length."""
    return summaries.withColumn("words", T.word_count("summary")).withColumn(
        "in_range", F.col("words").between(low, high)
    )


def completeness(summaries: DataFrame, found: DataFrame) -> DataFrame:
    """Share of a contract's clause types that its summary mentions.

    ``found`` holds the wide clause columns, null where absent. Contracts without clauses get null.
    """
    joined = summaries.select("contract_id", "summary").join(
        found.select("contract_id", *[F.col(c.column).isNotNull().alias(c.name) for c in CLAUSE_TYPES]), "contract_id"
    )
    types = reduce(lambda a, b: a + b, [F.col(c.name).cast("int") for c in CLAUSE_TYPES])
    covered = reduce(
        lambda a, b: a + b,
        [(F.col(c.name) & mentions("summary", c.keywords)).cast("int") for c in CLAUSE_TYPES],
    )
    return joined.select(
        "contract_id",
        types.alias("types_found"),
        covered.alias("types_mentioned"),
        F.when(types > 0, covered / types).alias("completeness"),
    )
