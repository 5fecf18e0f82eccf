"""Packing documents into sequences of fixed length: full windows first, the rest best-fit decreasing."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from clauseloom.llm.common import Memo, batch, blank_nulls, once_per_worker, per_batch, require_columns, stage, texts_of

WINDOW = 4096
# Pieces that one task packs. More pieces fill windows better and take more memory (about 60 bytes each).
PIECES_PER_SHARD = 25_000
# Words of which a worker keeps the ids; more cost time and change nothing.
MAX_WORDS = 250_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
PACKED = PIECES + ", sequence_id long, offset long"
_PACKED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


#: Latin letters that normalisation leaves as they are, beside ASCII.
LATIN = "".join(c for c in map(chr, range(0xAA, 0x100)) if c.isalpha())
PLAIN = re.compile(f"[!-~{LATIN}]+")
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


class WordIds:
    """Word (bytes without ASCII white space) -> its ids as little-endian 32-bit numbers.

    The vocabulary drops white space and no token spans it, so the ids of a text are those of its words in order.
    Words of ASCII and Latin letters are cut into runs as the vocabulary's own pattern does and the runs go straight
    to its merges; all others, and those that may hold a special token, go through the whole tokenizer.
    """

    def __init__(self, tokenizer: Tokenizer) -> None:
        tokenizer.encode_special_tokens = False
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {ord(c): spell.pre_tokenize_str(c)[0][0] for c in LATIN}
        self.runs_of = re.compile(f"{CONTRACTIONS}|[a-z{LATIN}]+|[0-9]|[^\\s0-9a-z{LATIN}]+").findall
        self.runs = Memo(self.run_ids, MAX_WORDS)
        self.words = Memo(self.word_ids, MAX_WORDS)

    def run_ids(self, run: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(run if run.isascii() else run.translate(self.spelling))]
        return np.asarray(ids, dtype="<u4").tobytes()

    def word_ids(self, word: bytes) -> bytes:
        text = word.decode()
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join(map(self.runs.__getitem__, self.runs_of(text.lower())))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def of(self, text: str) -> bytes:
        """The ids of a whole text."""
        return b"".join(map(self.words.__getitem__, text.encode().split()))


def word_ids(path: str) -> WordIds:
    """One per Python worker and vocabulary file."""
    return once_per_worker(("words", path), lambda: WordIds(Tokenizer.from_file(path)))


def cut(doc_tokens: int, window: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then what is left."""
    for start in range(0, doc_tokens, window):
        yield start, min(window, doc_tokens - start)


def pieces(documents: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Tokenize every whole text, append ``end_id`` and cut: one row per piece, without the ids themselves.

    A null text counts as empty and gives one piece that holds the end id alone.
    """
    require_columns(documents, "doc_id", "text")
    ending = np.asarray([end_id], dtype="<u4").tobytes()

    def work() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        words = word_ids(tokenizer_path)

        def step(rows: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            out: list[tuple[int | None, int, int, int, int]] = []
            for doc_id, text in zip(rows["doc_id"].to_pylist(), texts_of(rows["text"])):
                ids = words.of(text) + ending
                total = len(ids) // 4
                for start, length in cut(total, window):
                    out.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total))
            yield batch(_PIECES, dict(zip(_PIECES.names, zip(*out)))) if out else _PIECES.empty_table().to_batches()[0]

        return step

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), blank_nulls("text"))
    return per_batch(rows, work, PIECES)


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that finds the tightest one a piece fits into.

    Leaf ``c`` counts the open windows with ``c`` free places; an inner node holds the sum of its leaves. The
    tightest fit for a piece of length ``n`` is the leftmost non-empty leaf at or after ``n``.
    """

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.counts = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, window_no: int) -> None:
        self.open[capacity].append(window_no)
        node = self.size + capacity
        while node:
            self.counts[node] += 1
            node >>= 1

    def take_tightest(self, length: int) -> tuple[int, int] | None:
        """(capacity, window) of the open window with the least capacity that is at least ``length``."""
        counts, node = self.counts, self.size + length
        while not counts[node]:
            while node & 1:  # a right child: what lies further right hangs off an ancestor
                node >>= 1
                if node <= 1:
                    return None
            if node <= 1:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if counts[2 * node] else 2 * node + 1
        capacity = node - self.size
        window_no = self.open[capacity].pop()
        while node:
            counts[node] -= 1
            node >>= 1
        return capacity, window_no


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each piece; ``lengths`` must be in decreasing order, each from 1 to ``window``."""
    spaces = OpenWindows(window)
    number, offset, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, length in enumerate(lengths.tolist()):
        found = spaces.take_tightest(length)
        if found is None:
            found = window, opened
            opened += 1
        capacity, number[i] = found
        offset[i] = window - capacity
        if capacity > length:
            spaces.add(capacity - length, int(number[i]))
    return number, offset


def pack(rows: DataFrame, window: int = WINDOW, pieces_per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """Give each piece a sequence and an offset there.

    Pieces are dealt by hash into shards of about ``pieces_per_shard``, whose number follows from their count; each
    shard is packed best-fit decreasing, full windows first as sequences of their own. The salt keeps a repeated
    doc_id from filling one shard. Dealing and order depend on the stored rows alone, so a task that is run again
    gives the same sequences. Only ids, lengths and checksums are shuffled. ``rows`` must be a stored table: it is
    read twice.
    """
    n_pieces = rows.count()
    shards = max(1, -(-n_pieces // pieces_per_shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        length, start = rows["length"].to_numpy(), rows["start"].to_numpy()
        doc_id = rows["doc_id"].fill_null(-1).to_numpy()
        order = np.lexsort((rows["ids_crc32"].to_numpy(), start, doc_id, -length))
        number, offset = best_fit_decreasing(length[order], window)
        shard = TaskContext.get().partitionId()
        packed = rows.take(pa.array(order))
        for name, values in (("sequence_id", (shard << 32) + number), ("offset", offset)):
            packed = packed.append_column(name, pa.array(values, type=pa.int64()))
        yield from packed.cast(_PACKED).to_batches()

    salt = F.monotonically_increasing_id() % 1_024
    dealt = rows.withColumn("_salt", salt).repartition(shards, "doc_id", "start", "_salt")
    return dealt.drop("_salt").mapInArrow(run, PACKED)


def pack_documents(
    documents: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW,
    pieces_per_shard: int = PIECES_PER_SHARD,
) -> DataFrame:
    """Pack all documents: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece.

    ``documents`` needs doc_id and text; other columns are ignored. Null texts count as empty; a null doc_id stays
    null. Repeated rows are packed as often as they occur. An empty table gives no rows. Sequences are gapless from
    offset 0; the space after the last piece is padding.
    """
    return pack(stage(pieces(documents, tokenizer_path, end_id, window), "pieces"), window, pieces_per_shard)


def materialize(documents: DataFrame, packed: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """(sequence_id, offset, doc_id, ids array<int>): the pieces' ids, for writing sequences out.

    Texts are tokenized again instead of being stored; ``packed`` gives where each piece goes. Expects unique ids.
    """
    ending = np.asarray([end_id], dtype="<u4")
    schema = pa.schema(
        [("sequence_id", pa.int64()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]
    )

    def work() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        words = word_ids(tokenizer_path)

        def step(rows: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            out: list[tuple] = []
            for row in rows.to_pylist():
                ids = np.concatenate([np.frombuffer(words.of(row["text"]), "<u4"), ending])
                for p in row["places"]:
                    piece = ids[p["start"] : p["start"] + p["length"]].astype(np.int32)
                    out.append((p["sequence_id"], p["offset"], row["doc_id"], piece))
            if out:
                yield batch(schema, dict(zip(schema.names, zip(*out))))

        return step

    places = packed.groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("places")
    )
    rows = documents.select("doc_id", blank_nulls("text")).join(places, "doc_id")
    return per_batch(rows, work, "sequence_id long, offset long, doc_id long, ids array<int>")
