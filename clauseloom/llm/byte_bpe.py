"""Byte-level BPE in linear time: longest matches, backtracking, and a memo of which tokens may stand side by side."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from clauseloom.llm.common import Memo, batch, blank_nulls, once_per_worker, per_batch, require_columns, texts_of
from clauseloom.llm.merges import Neighbours, merge

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)
# Bounds of the memos, which cost time when passed and never change a result.
MAX_PIECES = 250_000
MAX_PAIRS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encoder and decoder over the ranks of one vocabulary.

    A token sequence is what the merges give exactly if every adjacent pair of it is what the merges give for that
    pair alone. So a search may go from left to right: take the longest token that fits the one before, shorten it
    when it does not, step back when nothing fits, and never try a position again that led to a dead end.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"{len(missing)} bytes have no token of their own")
        # The automaton works on text, so each byte stands as the Latin-1 character with its number. Only tokens that
        # the merges can make take part.
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in self.bytes_of}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if token and merge(token, ranks) == [token]:
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self._shorter: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._neighbours = Neighbours(ranks, memo=1)

    def shorter(self, token: int) -> tuple[int, int] | None:
        """The longest token that is a proper prefix of this one, and its length."""
        if token not in self._shorter:
            text = self.bytes_of[token].decode("latin-1")
            ends = (n for n in range(len(text) - 1, 0, -1) if text[:n] in self.automaton)
            n = next(ends, None)
            self._shorter[token] = None if n is None else self.automaton.get(text[:n])
        return self._shorter[token]

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens as they are when they stand side by side."""
        if len(self._pairs) >= MAX_PAIRS:
            self._pairs.clear()
        known = self._neighbours.apart(self.bytes_of[left], self.bytes_of[right])
        self._pairs[left, right] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece, as the merges give them."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        text, size = piece.decode("latin-1"), len(piece)
        longest: list[tuple[int, int] | None] = [None] * (size + 1)
        for end, match in self.automaton.iter(text):
            longest[end + 1 - match[1]] = match  # later ends are longer
        dead = bytearray(size + 1)
        pairs, ids, lengths = self._pairs, [], []
        at, candidate = 0, longest[0]
        while at < size:
            while candidate is not None:
                token, length = candidate
                if not dead[at + length]:
                    if not ids:
                        break
                    fits = pairs.get((ids[-1], token))
                    if self.side_by_side(ids[-1], token) if fits is None else fits:
                        break
                candidate = self.shorter(token)
            if candidate is not None:
                ids.append(token)
                lengths.append(length)
                at += length
                candidate = longest[at]
            else:
                dead[at] = 1
                candidate = ids.pop(), lengths.pop()
                at -= candidate[1]
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def compiled(path: str) -> tuple[ByteBpe, Memo]:
    """One encoder per Python worker and vocabulary file, and a memo from a piece of text to its ids."""

    def build() -> tuple[ByteBpe, Memo]:
        bpe = ByteBpe(read_ranks(path))
        return bpe, Memo(lambda piece: bpe.encode_piece(piece.encode()), MAX_PIECES)

    return once_per_worker(("bytes", path), build)


def encode_text(text: str, pieces: Memo, split: Callable[[str], list[str]]) -> list[int]:
    """The ids of a whole text; no special tokens."""
    ids: list[int] = []
    for piece in split(text):
        ids += pieces[piece]
    return ids


def encode_and_decode(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode every whole text and decode the ids again: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    ``documents`` needs doc_id and text; other columns are ignored, whatever their names. A null text counts as empty
    (0 tokens), a null doc_id stays null, repeated rows give repeated rows, an empty table gives none. Nothing is
    shuffled: each task compiles the vocabulary once per Python worker and holds bounded memos. ``ranks_path`` must
    be readable on every executor.
    """
    require_columns(documents, "doc_id", "text")

    def work() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        bpe, pieces = compiled(ranks_path)
        split, name = regex.compile(pattern).findall, bpe.names.__getitem__

        def step(rows: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            counts, ids_digests, decoded = [], [], []
            for text in texts_of(rows["text"]):
                ids = encode_text(text, pieces, split)
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield batch(
                _ARROW,
                {"doc_id": rows["doc_id"], "n_tokens": counts, "ids_sha256": ids_digests, "decoded_sha256": decoded},
            )

        return step

    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), blank_nulls("text"))
    return per_batch(rows, work, SCHEMA)


def encode(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; nulls, repeats and empty tables as in ``encode_and_decode``."""
    require_columns(documents, "doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def work() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        pieces, split = compiled(ranks_path)[1], regex.compile(pattern).findall

        def step(rows: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            ids = [encode_text(t, pieces, split) for t in texts_of(rows["text"])]
            yield batch(schema, {"doc_id": rows["doc_id"], "ids": ids})

        return step

    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), blank_nulls("text"))
    return per_batch(rows, work, "doc_id long, ids array<int>")
