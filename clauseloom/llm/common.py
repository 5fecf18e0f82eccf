"""What several of these operators need: tables, shared stages, Arrow columns."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clauseloom.sources.stages import stage

__all__ = ["table", "stage", "per_batch", "batch", "texts_of", "blank_nulls", "require_columns", "Memo",
           "once_per_worker", "keep_rows", "raw_hash", "whole_rows"]


class Memo(dict):
    """Results of ``make`` by key, bounded: two generations of at most ``limit`` keys, of which the older one goes.

    What is in use moves to the younger generation. Keys longer than ``longest`` are not kept. Losing a key costs
    time and never changes a result. ``memo[key]`` makes what is missing.
    """

    def __init__(self, make: Callable, limit: int, longest: int = 64) -> None:
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest
        self.older: dict = {}

    def __missing__(self, key):  # noqa: ANN001, ANN204
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value



def once_per_worker(key: tuple, build: Callable[[], object]) -> object:
    """What ``build`` makes, made once per Python process: compiled vocabularies outlive the task that made them.

    Functions travel to the workers by value, so a variable of this module would start anew with every task; the
    store therefore hangs on a module that every process has.
    """
    kept = sys.__dict__.setdefault("_clauseloom_kept", {})
    if key not in kept:
        if len(kept) >= 4:
            kept.clear()
        kept[key] = build()
        # Millions of small long-lived objects: looking through them for cycles at the usual rate costs a third of the time.
        gc.freeze()
        gc.set_threshold(200_000, 50, 50)
    return kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_columns(df: DataFrame, *names: str) -> None:
    """Fail early, with a plain message, if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def blank_nulls(column: str) -> F.Column:
    """The column as text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def batch(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    """A record batch from columns by name; lists and NumPy arrays are converted to the schema's types."""
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, type=field.type)
        for field in schema
        for c in [columns[field.name]]
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def texts_of(column: pa.Array) -> Iterator[str]:
    """The texts of a string column one by one, so that only one is held as a Python string at a time."""
    for value in column:
        yield value.as_py() or ""


def per_batch(
    df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: StructType | str
) -> DataFrame:
    """Map every Arrow batch of every partition.

    ``work`` is called once per task and returns the function for a batch; what it builds (a compiled tokenizer, a
    memo) then lasts for the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for b in batches:
            yield from step(b)

    return df.mapInArrow(run, schema)


def keep_rows(documents: DataFrame, decisions: DataFrame) -> DataFrame:
    """The documents whose (doc_id, text hash) is in ``decisions``; of rows that repeat both, one.

    ``decisions`` has columns doc_id and raw, see ``raw_hash``. All columns of ``documents`` come back, whatever their
    names. Only here are whole texts shuffled, once; rows that repeat meet where the join has put them.
    """
    keyed = whole_rows(documents, F.col("doc_id").cast("long").alias("id"), raw_hash("text").alias("hash"))
    chosen = decisions.select("doc_id", "raw").distinct()
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("raw"))
    return keyed.join(chosen, same, "left_semi").dropDuplicates(["id", "hash"]).select("row.*")


def whole_rows(documents: DataFrame, *columns: F.Column) -> DataFrame:
    """(row, further columns): all given columns inside a struct, so that none can clash with an added one."""
    return documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("row"), *columns)


def raw_hash(text: str) -> F.Column:
    """A hash of the text as it is, which tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))
