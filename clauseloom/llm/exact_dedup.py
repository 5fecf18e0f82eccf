"""Exact deduplication by Grace hashing: buckets go to spill files until each fits a table that compares contents."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import tempfile
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import batch, keep_rows, raw_hash, require_columns, stage

WHITE = re.compile(rb"[\x20\x09-\x0D]+")
# Bytes of content that one table may hold, before copies are sent on (map side) or spilled (reduce side).
ROOM = 48 << 20
FAN_OUT_BITS = 4
BATCH_BYTES = 4 << 20
NO_ID = (1 << 63) - 1

_SEEN = pa.schema(
    [
        ("row", pa.int64()), ("doc_id", pa.int64()), ("raw", pa.int64()), ("digest", pa.binary()), ("entry", pa.int64()),
        ("hash", pa.int64()), ("content", pa.binary()), ("smallest", pa.int64()), ("keeper", pa.int64()),
        ("copies", pa.int64()),
    ]
)
SEEN = (
    "row long, doc_id long, raw long, digest binary, entry long, hash long, content binary, smallest long, "
    "keeper long, copies long"
)
_GROUPS = pa.schema([(n, pa.int64()) for n in ("entry", "keep_id", "keeper", "group_size")])
GROUPS = "entry long, keep_id long, keeper long, group_size long"


class Record(NamedTuple):
    """Copies of one content met so far: the smallest doc_id and the row that has it, and their number."""

    hash: int
    entry: int
    smallest: int
    keeper: int
    copies: int
    content: bytes


class Contents:
    """Open addressing with linear probing: a slot holds the number of an entry, and whole contents are compared."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots, self.hashes, self.contents, self.size = [-1] * 1024, [], [], 0

    def place(self, hash_: int, content: bytes) -> tuple[int, bool]:
        """(entry, whether it is new)."""
        slots, mask = self.slots, len(self.slots) - 1
        at = hash_ & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == hash_ and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        entry = slots[at] = len(self.contents)
        self.hashes.append(hash_)
        self.contents.append(content)
        self.size += len(content) + 200
        if 2 * len(self.contents) > mask:
            self._grow()
        return entry, True

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = slots = [-1] * (mask + 1)
        for entry, hash_ in enumerate(self.hashes):
            at = hash_ & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = entry


#: Before each content in a spill file: the five numbers of its record and its length.
HEAD = "<QqqqqI"


class Spill:
    """Records in files by some bits of their hash."""

    def __init__(self, folder: str, level: int) -> None:
        self.shift = 60 - FAN_OUT_BITS * level
        self.paths = [os.path.join(folder, f"{level}-{n:02d}-{os.urandom(4).hex()}") for n in range(1 << FAN_OUT_BITS)]
        self.files = [open(p, "wb", buffering=1 << 16) for p in self.paths]

    def write(self, record: Record) -> None:
        bucket = (record.hash >> self.shift) & ((1 << FAN_OUT_BITS) - 1)
        self.files[bucket].write(struct.pack(HEAD, *record[:5], len(record.content)) + record.content)

    def buckets(self) -> Iterator[Iterator[Record]]:
        """The records of each bucket in turn; its file goes when the next is asked for."""
        for file in self.files:
            file.close()
        for path in self.paths:
            yield self._read(path)
            os.unlink(path)

    def _read(self, path: str) -> Iterator[Record]:
        with open(path, "rb", buffering=1 << 16) as file:
            while head := file.read(struct.calcsize(HEAD)):
                *fields, size = struct.unpack(HEAD, head)
                yield Record(*fields, file.read(size))


def grace(records: Iterable[Record], folder: str, room: int = ROOM, level: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(entry, keep_id, keeper, group_size) of every record, where records of equal content form a group.

    Records go to a table in memory. When its contents exceed ``room``, everything goes to spill files by the next
    bits of the hash, and each file is treated in the same way. Copies take no room for content, so equal records,
    which no hash can part, never force a split; the last level takes what is left.
    """
    table, members, spill = Contents(), [], None
    last_level = FAN_OUT_BITS * (level + 1) > 56
    for record in records:
        if spill is not None:
            spill.write(record)
            continue
        place, new = table.place(record.hash, record.content)
        if new:
            members.append([])
        members[place].append(record[:5])
        if table.size > room and not last_level:
            spill = Spill(folder, level)
            for content, group in zip(table.contents, members):
                for fields in group:
                    spill.write(Record(*fields, content))
            table.clear()
            members = []
    if spill is not None:
        for bucket in spill.buckets():
            yield from grace(bucket, folder, room, level + 1)
        return
    for group in members:
        smallest, keeper = min((fields[2], fields[3]) for fields in group)
        size = sum(fields[4] for fields in group)
        for fields in group:
            yield fields[1], smallest, keeper, size


def spill_folder() -> str | None:
    """Where Spark lets this task's own process spill; the files are the task's alone and go with it."""
    folders = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")
    return next((f for f in folders if f and os.path.isdir(f)), None)


def _combine(room: int):
    """Map side: fold the copies within a task. Emits a row per document, and a row with the content per entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        table, found, rows = Contents(), [], 0
        entries = base

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal found, entries
            out, size = [], 0
            for n, content in enumerate(table.contents):
                smallest, keeper, copies = found[n]
                out.append((entries + n, _signed(table.hashes[n]), content, smallest, keeper, copies))
                size += len(content)
                if size > BATCH_BYTES or n + 1 == len(table.contents):
                    entry, hash_, text, low, keep, number = zip(*out)
                    none = [None] * len(out)
                    yield batch(_SEEN, dict(zip(_SEEN.names, (none, none, none, none, entry, hash_, text, low, keep, number))))
                    out, size = [], 0
            entries += len(table.contents)
            table.clear()
            found = []

        for b in batches:
            digests, entry_of, first = [], [], base + rows
            for n, (doc_id, text) in enumerate(zip(b["doc_id"].to_pylist(), b["text"])):
                content = WHITE.sub(b" ", text.as_py() or b"")
                digests.append(hashlib.sha256(content).digest())
                place, new = table.place(xxhash.xxh3_64_intdigest(content), content)
                mine = (NO_ID if doc_id is None else doc_id, first + n)
                if new:
                    found.append((*mine, 1))
                else:
                    smallest, keeper, copies = found[place]
                    found[place] = (*min(mine, (smallest, keeper)), copies + 1)
                entry_of.append(entries + place)
                # Flushing inside a batch keeps the table bounded; a later copy then opens another entry.
                if table.size > room:
                    yield from flush()
            rows += b.num_rows
            none = pa.nulls(b.num_rows)
            numbers = pa.array(range(first, first + b.num_rows), pa.int64())
            columns = (numbers, b["doc_id"], b["raw"], digests, entry_of, *[none.cast(_SEEN.field(i).type) for i in range(5, 10)])
            yield batch(_SEEN, dict(zip(_SEEN.names, columns)))
        yield from flush()

    return run


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _reduce(room: int):
    """Reduce side: Grace hashing over the entries of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for b in batches:
                fields = zip(*[b[n].to_pylist() for n in ("hash", "entry", "smallest", "keeper", "copies")], b["content"])
                for hash_, entry, smallest, keeper, copies, content in fields:
                    yield Record(hash_ & (2**64 - 1), entry, smallest, keeper, copies, content.as_py())

        with tempfile.TemporaryDirectory(prefix="grace-", dir=spill_folder()) as folder:
            out = []
            for group in grace(records(), folder, room):
                out.append(group)
                if len(out) == 10_000:
                    yield batch(_GROUPS, dict(zip(_GROUPS.names, zip(*out))))
                    out = []
            if out:
                yield batch(_GROUPS, dict(zip(_GROUPS.names, zip(*out))))

    return run


def _verdicts(documents: DataFrame, room: int) -> DataFrame:
    require_columns(documents, "doc_id", "text")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        raw_hash("text").alias("raw"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    seen = stage(rows.mapInArrow(_combine(room), SEEN), "contents")
    entries = seen.filter(F.col("content").isNotNull()).select("hash", "entry", "smallest", "keeper", "copies", "content")
    groups = entries.repartition("hash").mapInArrow(_reduce(room), GROUPS)
    members = seen.filter(F.col("row").isNotNull()).select("row", "doc_id", "raw", "digest", "entry")
    return members.join(groups, "entry").select(
        "doc_id",
        F.when(F.col("keep_id") != NO_ID, F.col("keep_id")).alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keeper")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "raw",
    )


def exact_groups(documents: DataFrame, room: int = ROOM) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when they are identical after each run of ASCII white space is replaced by one space. Of equal
    texts the row with the smallest doc_id is kept, of rows that repeat both one; a row without doc_id is kept only if
    no equal text has one (keep_id is then null). A null text counts as empty; other columns are ignored; an empty
    table gives no rows.

    Copies are folded inside each map task first, so a group that holds a third of all rows reaches its bucket once
    per task. Whole contents are shuffled by their hash once; each bucket is settled with bounded memory by spill
    files of the task's own, and a task that is lost is run again from the stored contents. Verdicts return to the
    documents by entry number, without texts.
    """
    return _verdicts(documents, room).drop("raw")


def distinct_documents(documents: DataFrame, room: int = ROOM) -> DataFrame:
    """The documents that stay, with all their columns."""
    return keep_rows(documents, _verdicts(documents, room).filter("kept"))
