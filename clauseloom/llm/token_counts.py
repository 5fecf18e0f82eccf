"""Token counts by a transducer compiled from a subword vocabulary; chunk maps compose by a parallel prefix scan."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from clauseloom.llm.common import Memo, batch, blank_nulls, once_per_worker, per_batch, require_columns, texts_of
from clauseloom.llm.merges import Neighbours, merge

SPACE = "▁"
CHUNK = 16_384
# Bounds of what a worker keeps, which cost time when passed and never change a count.
MAX_STATES = 200_000
MAX_PAIRS = 1_000_000
MAX_WORDS = 300_000
OVER_LIMIT = 4096

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]
)


class State:
    """A state of the transducer: what of the text so far can still change how it splits into tokens.

    ``live`` holds, for each end of the text that begins some piece, the longest first: (that end, last token before
    it, tokens before it less the tokens now). ``run`` is the length
    class of the run of spaces that ends here, or 0. ``moves`` maps a character to (next state, tokens emitted).
    """

    __slots__ = ("live", "run", "moves")

    def __init__(self, live: tuple, run: int) -> None:
        self.live, self.run = live, run
        self.moves: dict[str, tuple[State, int]] = {}


class Transducer:
    """Deterministic transducer from characters to numbers of emitted tokens.

    States are built when first reached. A transition emits the change of the token count, which can be 0 or negative
    where a longer piece replaces several shorter ones; the sum over a text is its number of tokens. Three facts make
    it finite: a token sequence is right if every adjacent pair is right, so only the last token of a prefix matters;
    no piece is longer than the longest of the vocabulary; pieces hold spaces in front only, so a space after another
    character always leads to the same state. Runs of spaces, where equal scores are settled from the left, are
    counted apart, and their lengths fold into classes once the counts repeat.
    """

    def __init__(self, scores: dict[str, float]) -> None:
        self.ranks = ranks = {piece: -score for piece, score in scores.items()}
        inner = [p for p in scores if SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE))]
        if inner:
            raise ValueError(f"pieces with inner spaces are not supported: {inner[:3]}")
        lowest = min((s for p, s in scores.items() if p.strip(SPACE)), default=0.0)
        runs = [p for p in scores if not p.strip(SPACE)]
        if any(scores[p] >= lowest for p in runs if len(p) > 1):
            raise ValueError("runs of spaces must be merged last")
        self.pieces = {p for p in scores if p.strip(SPACE) and merge(p, ranks) == [p]} | {SPACE}
        #: Text -> 1 if it begins a longer piece, 2 if it is a piece, 3 if both.
        self.kinds: dict[str, int] = dict.fromkeys((p[:n] for p in self.pieces for n in range(1, len(p))), 1)
        for piece in self.pieces:
            self.kinds[piece] = self.kinds.get(piece, 0) + 2
        self.neighbours = Neighbours(ranks, memo=1)
        self.pairs: dict[tuple[str, str], bool] = {}
        self._fold_runs(max(map(len, runs), default=1))
        self.reset()

    def _fold_runs(self, longest: int) -> None:
        """Tokens of runs of 0, 1, … spaces, up to where they repeat, and the length that follows the last."""
        reach = 8 * longest + 1
        counts = [len(merge(SPACE * n, self.ranks)) for n in range(reach + 1)]
        steps = [b - a for a, b in zip(counts, counts[1:])]
        for period in range(1, 2 * longest + 1):
            start = 4 * longest
            if all(steps[i] == steps[i + period] for i in range(start, reach - period)):
                break
        else:
            raise ValueError("counts of runs of spaces do not repeat")
        self.run_counts = counts[: start + period + 1]
        self.run_back = start + 1

    def reset(self) -> None:
        """Forget the states built so far."""
        self.states: dict[tuple, State] = {}
        self.runs = [None] + [self._run_state(n) for n in range(1, len(self.run_counts))]
        self.empty = self._state((("", None, 0),), 0)
        #: Where a text begins: the library puts a space in front of it.
        self.start = self.runs[1]

    def _state(self, live: tuple, run: int) -> State:
        found = self.states.get((live, run))
        if found is None:
            found = self.states[live, run] = State(live, run)
        return found

    def _apart(self, left: str, right: str) -> bool:
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = known = self.neighbours.apart(left, right)
        return known

    def _run_state(self, n: int) -> State:
        ahead = self.run_counts[n - 1] - self.run_counts[n]
        return self._state(((SPACE, None, ahead), ("", SPACE, 0)), n)

    def move(self, state: State, char: str) -> tuple[State, int]:
        """The transition for a character, built when it is first asked for."""
        if char in (" ", SPACE):
            if not state.run:
                found = self.runs[1], 1
            else:
                n = state.run + 1
                more = self.run_counts[n] - self.run_counts[n - 1] if n < len(self.run_counts) else None
                if more is None:  # the class that lies one period before
                    n = self.run_back
                    more = self.run_counts[n] - self.run_counts[n - 1]
                found = self.runs[n], more
        elif char not in self.pieces:  # spelled in bytes; nothing is ever joined with it
            found = self.empty, len(char.encode())
        else:
            kind_of, known, grown, token, emitted = self.kinds.get, self.pairs, [], None, 0
            for rest, last, tokens in state.live:
                rest += char
                kind = kind_of(rest)
                if kind is None:
                    continue
                if kind >= 2 and token is None:
                    if last is None or (known[last, rest] if (last, rest) in known else self._apart(last, rest)):
                        token, emitted = rest, tokens + 1
                if kind != 2:
                    grown.append((rest, last, tokens))
            live = (*[(rest, last, n - emitted) for rest, last, n in grown], ("", token, 0))
            found = self._state(live, 0), emitted
        state.moves[char] = found
        return found

    def run(self, state: State, text: str) -> tuple[State, int]:
        """Read a text from a state: the state after it and the tokens emitted."""
        if len(self.states) > MAX_STATES:
            # States in use stay valid on their own; only the table of known ones starts anew.
            self.reset()
            gc.collect()
        total = 0
        for char in text:
            moves = state.moves
            state, emitted = moves[char] if char in moves else self.move(state, char)
            total += emitted
        return state, total


class WordCounts(Memo):
    """Word without spaces -> tokens emitted by reading it after a single space."""

    def __init__(self, machine: Transducer) -> None:
        super().__init__(lambda word: machine.run(machine.start, word)[1], MAX_WORDS)
        self.machine = machine


class ChunkMap:
    """What a chunk of text does to the state before it.

    A space that follows another character always leads to one and the same state. So ``head``, the pieces of text up
    to the first such space, is all that depends on the state before; from there the chunk emits ``rest`` tokens and
    ends in ``end``. A chunk without such a space is all head, and ``end`` is None. Maps compose, and composition is
    associative; it lists pieces and does not copy text.
    """

    __slots__ = ("head", "rest", "end")

    def __init__(self, head: tuple[str, ...], rest: int, end: State | None) -> None:
        self.head, self.rest, self.end = head, rest, end

    @classmethod
    def of(cls, chunk: str, words: WordCounts) -> ChunkMap:
        machine = words.machine
        lead = len(chunk) - len(chunk.lstrip(" "))
        cut = chunk.find(" ", lead + 1) if lead < len(chunk) else -1
        if cut < 0:
            return cls((chunk,), 0, None)
        # The head's last character is the space: after it the state is the one that every text begins in.
        *full, last = chunk[cut + 1 :].split(" ")
        if "" in full:
            state, rest = machine.run(machine.start, chunk[cut + 1 :])
        else:
            rest = sum(map(words.__getitem__, full)) + len(full)
            state, tokens = machine.run(machine.start, last)
            rest += tokens
        return cls((chunk[: cut + 1],), rest, state)

    def then(self, after: ChunkMap, machine: Transducer) -> ChunkMap:
        """The map of this chunk followed by another."""
        if self.end is None:
            return ChunkMap(self.head + after.head, after.rest, after.end)
        state, tokens = self.read(self.end, after.head, machine)
        return ChunkMap(self.head, self.rest + tokens + after.rest, state if after.end is None else after.end)

    def apply(self, state: State, machine: Transducer) -> tuple[State, int]:
        after, tokens = self.read(state, self.head, machine)
        return (after if self.end is None else self.end), tokens + self.rest

    @staticmethod
    def read(state: State, pieces: tuple[str, ...], machine: Transducer) -> tuple[State, int]:
        total = 0
        for piece in pieces:
            state, tokens = machine.run(state, piece)
            total += tokens
        return state, total


def compose(maps: list[ChunkMap], machine: Transducer) -> list[list[ChunkMap]]:
    """The maps, those of neighbouring pairs, of pairs of pairs, … up to one map of everything.

    The compositions of a level do not depend on one another. A head is read once its left neighbour has an end, and
    is then gone: all levels together read the text once.
    """
    levels = [maps]
    while len(levels[-1]) > 1:
        below = levels[-1]
        pairs = [a.then(b, machine) for a, b in zip(below[::2], below[1::2])]
        levels.append(pairs + below[len(pairs) * 2 :])
    return levels


def states_before(levels: list[list[ChunkMap]], machine: Transducer) -> list[tuple[State, int]]:
    """The way down of the scan: (state, tokens) before each chunk, from the composed maps of all that lies before.

    A level applies the left map of each pair, so it reads the text at most once; there are logarithmically many.
    """
    before = [(machine.start, 0)]
    for below in reversed(levels[:-1]):
        spread = []
        for (state, tokens), left in zip(before, below[::2]):
            after, more = left.apply(state, machine)
            spread += [(state, tokens), (after, tokens + more)]
        before = spread[: len(below)]
    return before


def _maps(text: str, words: WordCounts, size: int) -> list[ChunkMap]:
    text = text.replace(SPACE, " ")
    return [ChunkMap.of(text[i : i + size], words) for i in range(0, len(text), size)]


def chunk_ends(text: str, words: WordCounts, size: int = CHUNK) -> list[int]:
    """Number of tokens up to the end of each chunk of ``size`` characters; empty for an empty text."""
    maps, machine = _maps(text, words, size), words.machine
    before = states_before(compose(maps, machine), machine) if maps else []
    # 1 for the space that the library puts in front.
    return [1 + tokens + m.apply(state, machine)[1] for (state, tokens), m in zip(before, maps)]


def count_tokens(text: str, words: WordCounts, size: int = CHUNK) -> int:
    """Tokens of a text: the composition of all chunk maps, applied to the state that a text begins in."""
    if not text:
        return 0
    machine = words.machine
    return 1 + compose(_maps(text, words, size), machine)[-1][0].apply(machine.start, machine)[1]


def read_scores(path: str) -> dict[str, float]:
    """Piece -> score of a model's ordinary pieces; checks that the model is of the kind the transducer covers."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [
        i for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    if sum(map(model.is_byte, range(model.get_piece_size()))) != 256:
        raise ValueError("the model must spell unknown characters in bytes")
    return {model.id_to_piece(i): model.get_score(i) for i in ordinary}


def compiled(path: str) -> WordCounts:
    """One transducer, with its memo, per Python worker and model file."""
    return once_per_worker(("tokens", path), lambda: WordCounts(Transducer(read_scores(path))))


def token_counts(documents: DataFrame, model_path: str, limit: int = OVER_LIMIT) -> DataFrame:
    """Tokens of every whole text: (doc_id, n_bytes, n_tokens, over_limit), over_limit where n_tokens > ``limit``.

    ``documents`` needs doc_id and text; other columns are ignored, whatever their names. A null text counts as empty
    (0 bytes, 0 tokens), a null doc_id stays null, repeated rows give repeated rows, an empty table gives none.
    Nothing is shuffled: each task builds the states it meets and keeps a bounded number of them. ``model_path`` must
    be readable on every executor.
    """
    require_columns(documents, "doc_id", "text")

    def work() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        words = compiled(model_path)

        def step(rows: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            sizes, counts = [], []
            for text in texts_of(rows["text"]):
                sizes.append(len(text.encode()))
                counts.append(count_tokens(text, words))
            yield batch(
                _ARROW,
                {
                    "doc_id": rows["doc_id"], "n_bytes": sizes, "n_tokens": counts,
                    "over_limit": [n > limit for n in counts],
                },
            )

        return step

    rows = documents.select(documents["doc_id"].cast("long").alias("doc_id"), blank_nulls("text"))
    return per_batch(rows, work, SCHEMA)
