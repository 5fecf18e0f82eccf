"""Token counts, byte-level BPE and packing against the public libraries."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from clauseloom.llm import byte_bpe, packing, token_counts
from clauseloom.llm.merges import Neighbours, merge

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BITS = [
    " ", " ", "▁", "a", "e", "t", "h", "\n", "\t", "é", "=", "-", "*", "1", "2", "(", "日", "の", "😀", "\x00", "İ", "ing",
    " the", "http", "  ", "    ", "Function", "------", "́", "नम", "ß", "'ll", "'S", "12345", "aaaaaaaa", "\x1c", "\x85", "\xa0",
    "　", "<|endoftext|>", "</s>", "ΑΣ", "µ", "²", "ª", "?!",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 60))) for _ in range(1_500)]


@pytest.fixture(scope="module")
def library():
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ranks = byte_bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return pieces, own, Tokenizer.from_file(WORDS)


def test_transducer_counts_like_the_library(texts, library):
    words = token_counts.compiled(PIECES)
    for text in texts:
        expected = len(library[0].encode(text))
        assert token_counts.count_tokens(text, words) == expected, text
        assert token_counts.count_tokens(text, words, size=5) == expected, text


def test_runs_of_spaces_and_signs(library):
    words = token_counts.compiled(PIECES)
    for n in [*range(200), 1_000]:
        for text in (" " * n, "a" + " " * n + "b", " " * n + "7", "-" * n, "=" * n + " x"):
            assert token_counts.count_tokens(text, words, size=64) == len(library[0].encode(text))


def test_chunk_maps_compose_in_any_order():
    words = token_counts.compiled(PIECES)
    machine, text = words.machine, "some words and  averyveryverylongwordwithoutanyspace then more "
    maps = [token_counts.ChunkMap.of(text[i : i + 4], words) for i in range(0, len(text), 4)]
    left = maps[0]
    for m in maps[1:]:
        left = left.then(m, machine)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = m.then(right, machine)
    for state in (machine.start, machine.empty):
        assert left.apply(state, machine) == right.apply(state, machine)
        assert token_counts.compose(maps, machine)[-1][0].apply(state, machine) == left.apply(state, machine)
    # The scan gives the state and the tokens before every chunk.
    state, tokens = machine.start, 0
    for found, m in zip(token_counts.states_before(token_counts.compose(maps, machine), machine), maps):
        assert found == (state, tokens)
        state, more = m.apply(state, machine)
        tokens += more


def test_long_texts_without_spaces_are_read_once(library):
    words, rng = token_counts.compiled(PIECES), random.Random(4)
    signs = "".join(rng.choice("日本語のテキストabcdefXYZ0123456789+/") for _ in range(100_000))
    for text in (signs * 20, "a few words, then " + signs * 20):
        start = time.perf_counter()
        ends = token_counts.chunk_ends(text, words)
        assert token_counts.count_tokens(text, words) == ends[-1] and time.perf_counter() - start < 30
    part = text[:40_000]
    assert token_counts.chunk_ends(part, words, 1_000)[-1] == len(library[0].encode(part))


def test_states_can_be_forgotten(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    words = token_counts.WordCounts(token_counts.Transducer(token_counts.read_scores(PIECES)))
    text = "The quick brown fox jumps over the lazy dog and runs away from representatives"
    assert token_counts.count_tokens(text, words) == len(library[0].encode(text))


def test_token_counts_of_documents(documents, nothing, library):
    expected = sorted(
        (str(r.doc_id), len((r.text or "").encode()), len(library[0].encode(r.text or ""))) for r in documents.collect()
    )
    found = token_counts.token_counts(documents, PIECES).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in found) == expected
    assert all(r.over_limit == (r.n_tokens > 4096) for r in found)
    assert token_counts.token_counts(nothing, PIECES).count() == 0


def test_neighbours_agree_with_the_merges():
    ranks = {c: i for i, c in enumerate("abc")}
    ranks |= {t: 10 + i for i, t in enumerate(["ab", "bc", "aa", "abc", "aab", "bca", "aabc", "cab"])}
    apart = Neighbours(ranks).apart
    makeable = [t for t in ranks if merge(t, ranks) == [t]]
    for a in makeable:
        for b in makeable:
            assert apart(a, b) == (merge(a + b, ranks) == [a, b])


def test_byte_bpe_encodes_and_decodes_like_the_library(texts, library):
    bpe, pieces = byte_bpe.compiled(RANKS)
    split = regex.compile(public_tokenizers.PATTERN).findall
    for text in [*texts, "ab" * 5_000, "=" * 777, "aaaaab" * 99]:
        ids = byte_bpe.encode_text(text, pieces, split)
        assert ids == library[1].encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_byte_bpe_of_documents(documents, nothing, library):
    def expected(text):
        ids = library[1].encode_ordinary(text)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        return len(ids), digest(",".join(map(str, ids)).encode()), digest(text.encode())

    found = byte_bpe.encode_and_decode(documents, RANKS, public_tokenizers.PATTERN)
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == sorted(
        (str(r.doc_id), *expected(r.text or "")) for r in documents.collect()
    )
    assert byte_bpe.encode_and_decode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.encode(documents, RANKS, public_tokenizers.PATTERN).count() == documents.count()


def test_word_ids_like_the_library(texts, library):
    words = packing.word_ids(WORDS)
    for text in texts:
        expected = np.asarray(library[2].encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert words.of(text) == expected, text


def test_best_fit_decreasing_takes_the_tightest_window():
    rng = random.Random(4)
    lengths = sorted((rng.randint(1, 64) for _ in range(400)), reverse=True)
    number, offset = packing.best_fit_decreasing(np.array(lengths), 64)
    free: list[int] = []
    for length, n, at in zip(lengths, number.tolist(), offset.tolist()):
        fitting = [c for c in free if c >= length]
        if not fitting:
            free.append(64)
        else:
            assert free[n] == min(fitting)
        assert at == 64 - free[n]
        free[n] -= length
    assert min(free) >= 0


@pytest.mark.parametrize("shard", [25_000, 20])
def test_packing_holds_every_id_once(documents, nothing, library, shard):
    rows = packing.pack_documents(documents, WORDS, pieces_per_shard=shard).toPandas()
    found = []
    for (key, total), pieces in rows.fillna({"doc_id": -1}).groupby(["doc_id", "doc_tokens"]):
        found.append((key, total, sorted(zip(pieces.start, pieces.length, pieces.ids_crc32))))
    expected = {}
    for r in documents.collect():
        ids = np.asarray([*library[2].encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        cut = [(s, min(4096, len(ids) - s)) for s in range(0, len(ids), 4096)]
        pieces = [(s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n in cut]
        expected.setdefault((-1 if r.doc_id is None else r.doc_id, len(ids)), []).extend(pieces)
    assert sorted(found) == sorted((*k, sorted(v)) for k, v in expected.items())
    for _, sequence in rows.sort_values("offset").groupby("sequence_id"):
        ends = np.cumsum([0, *sequence.length])
        assert ends[-1] <= 4096 and list(sequence.offset) == list(ends[:-1])
    assert packing.pack_documents(nothing, WORDS).count() == 0


def test_materialized_pieces(spark, sf_dir, library):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    packed = packing.pack_documents(documents, WORDS)
    made = packing.materialize(documents, packed, WORDS).toPandas()
    checks = {(r.sequence_id, r.offset): r.ids_crc32 for r in packed.collect()}
    assert len(made) == len(checks)
    for r in made.itertuples():
        assert zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == checks[r.sequence_id, r.offset]
