"""Exact and near duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from clauseloom.llm import exact_dedup, simhash
from clauseloom.llm.components import components


def _normal(text):
    return re.sub(rb"[\x20\x09-\x0D]+", b" ", (text or "").encode())


@pytest.mark.parametrize("room", [exact_dedup.ROOM, 20_000])
def test_exact_groups(documents, nothing, room):
    rows = documents.collect()
    groups = {}
    for r in rows:
        groups.setdefault(_normal(r.text), []).append(r.doc_id)
    low = {n: min((i for i in ids if i is not None), default=None) for n, ids in groups.items()}
    found = exact_dedup.exact_groups(documents, room).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == sorted(
        (str(r.doc_id), str(low[n]), len(groups[n]), hashlib.sha256(n).hexdigest()) for r in rows for n in [_normal(r.text)]
    )
    assert sum(r.kept for r in found) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_distinct_documents_keep_one_row_of_each_text(documents):
    kept = exact_dedup.distinct_documents(documents)
    assert kept.columns == documents.columns
    texts = [_normal(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {_normal(r.text) for r in documents.collect()}


def test_grace_splits_until_buckets_fit(tmp_path):
    rng = random.Random(2)
    contents = [bytes([rng.randrange(97, 123)]) * rng.randint(1, 40) for _ in range(300)]
    # Contents with equal hashes must still be told apart.
    records = [exact_dedup.Record(xxhash.xxh3_64_intdigest(c[:1]), n, n, n, 1, c) for n, c in enumerate(contents)]
    found = {e: (k, size) for e, k, _, size in exact_dedup.grace(records, str(tmp_path), room=1_000)}
    for n, c in enumerate(contents):
        same = [i for i, other in enumerate(contents) if other == c]
        assert found[n] == (same[0], len(same))
    assert not list(tmp_path.iterdir())


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)][: len(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(prints, ids):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    distinct = sorted(set(prints))
    for n, a in enumerate(distinct):
        for b in distinct[:n]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for p, i in zip(prints, ids):
        if i is not None:
            low[find(p)] = min(low.get(find(p), i), i)
    return [low.get(find(p)) for p in prints]


@pytest.mark.parametrize("limit", [simhash.ROUTE_LIMIT, 2])
def test_near_duplicates(spark, documents, nothing, limit):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    near = spark.createDataFrame([(9000 + n, base * 20 + f"end{n}") for n in range(12)], "doc_id long, text string")
    rows = documents.select("doc_id", "text").unionByName(near)
    given = rows.collect()
    prints = [_fingerprint(r.text) for r in given]
    expected = _groups(prints, [r.doc_id for r in given])
    found = simhash.near_duplicates(rows, limit=limit).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == sorted(
        (str(r.doc_id), f"{p:016x}", str(c)) for r, p, c in zip(given, prints, expected)
    )
    assert simhash.near_duplicates(nothing).count() == 0


def test_representatives(documents):
    kept = simhash.representatives(documents)
    assert kept.columns == documents.columns
    given = documents.collect()
    groups = _groups([_fingerprint(r.text) for r in given], [r.doc_id for r in given])
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({g for g in groups if g is not None})
    # Of a group whose rows all lack a doc_id one row stays: with stand-ins for them, such a group starts at one.
    standing = _groups([_fingerprint(r.text) for r in given], [10**9 + n if r.doc_id is None else r.doc_id for n, r in enumerate(given)])
    assert kept.filter("doc_id IS NULL").count() == len({g for g in standing if g >= 10**9})


def test_rows_without_doc_id_link_like_any_other(spark):
    rows = [(1, "a b c d e f"), (None, "a b c d e f"), (None, "u v w x"), (None, "u v w x"), (None, "U V W X"), (7, None)]
    documents = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, root int")
    found = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(documents).collect()}
    alone, group = (f"{_fingerprint(t):016x}" for t in ("u v w x", "a b c d e f"))
    assert found[None, group] == found[1, group] == 1 and found[None, alone] is None and found[7, "0" * 16] == 7
    kept = simhash.representatives(documents).collect()
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in kept) == [(0, "u v w x"), (1, "a b c d e f"), (7, "")]


def test_a_row_without_doc_id_connects_two_others(spark):
    rng, size = np.random.default_rng(1), simhash.SHINGLE
    prints, low = {}, None
    # Texts are looked for whose fingerprints form a path a - b - c with a and c apart.
    for _ in range(400):
        words = [f"w{n}" for n in rng.integers(0, 50, 300)]
        for at in range(0, 300, 3):
            text = " ".join(words[:at] + ["x"] + words[at + 1 :])
            prints[text] = simhash.fingerprint(simhash.shingle_hashes(text.encode(), size)) & (2**64 - 1)
        values = list(prints.items())
        for t, p in values:
            close = [(u, q) for u, q in values if 0 < (p ^ q).bit_count() <= 2]
            apart = [(u, v) for u, q in close for v, r in close if (q ^ r).bit_count() > 2]
            if apart:
                low = (apart[0][0], t, apart[0][1])
                break
        if low:
            break
        prints = {}
    documents = spark.createDataFrame([(1, low[0]), (None, low[1]), (2, low[2])], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(documents).collect()] == [1, 1, 1]


def test_trie_self_join_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flipped = base[rng.integers(0, 40, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    first, second = np.unique(np.concatenate([base, flipped])), np.unique(flipped[:50])
    codes = np.concatenate([first, second, base[:1]])
    starts = np.array([0, len(first), len(first) + len(second), len(codes)])
    i, j = simhash.trie_self_join(codes, starts)
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    assert len(found) == len(i)
    group = np.searchsorted(starts, np.arange(len(codes)), side="right")
    expected = {
        (a, b) for b in range(len(codes)) for a in range(b)
        if group[a] == group[b] and int(codes[a] ^ codes[b]).bit_count() <= 2
    }
    assert found == expected


def test_routes_miss_no_pair():
    rng = random.Random(5)
    for blocks in (4, 6, 10, 16):
        masks = [m & (2**64 - 1) for m in simhash.routes(blocks, 2)]
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            assert any(a & m == b & m for m in masks)


def test_components(spark):
    rng = random.Random(6)
    edges = [(n, n + 1) for n in range(60)] + [(100, n) for n in range(200, 260)] + [(5, 5), (300, 301), (301, 300)]
    rng.shuffle(edges)
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    expected = {n: 0 for n in range(1, 61)} | {n: 100 for n in range(200, 260)} | {301: 300}
    assert roots == expected
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
