"""HyperMinHash near-duplicates against brute force over whole sets."""

import random
import re

import numpy as np
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from clauseloom.llm import minhash
from clauseloom.llm.queries import ORACLES, QUERIES


def _set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def _expected(rows, percent=85):
    sets = [_set(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            low[find(i)] = min(low.get(find(i), r.doc_id), r.doc_id)
    return sorted(
        (str(r.doc_id), len(sets[i]), str(low.get(find(i))), r.doc_id == low.get(find(i))) for i, r in enumerate(rows)
    )


def _found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def _variants(rng, words, n, edits):
    """A text and ``n`` versions of it, each with ``edits`` words of its own."""
    yield " ".join(words)
    for _ in range(n):
        own = list(words)
        for at in rng.sample(range(len(words)), edits):
            own[at] = f"new{rng.randrange(10**9)}"
        yield " ".join(own)


@pytest.fixture(scope="module")
def families(spark):
    """Families near the threshold, chains, short texts that share most words, and rows without doc_id."""
    rng = random.Random(5)
    vocabulary = [f"w{n}" for n in range(3_000)]
    texts = []
    for size in (8, 20, 60, 200, 600):
        for edits in (1, 2, 4, 8, 14):
            if edits * 4 < size:
                texts += _variants(rng, rng.choices(vocabulary, k=size), 6, edits)
    chain = rng.choices(vocabulary, k=100)
    for n in range(12):  # neighbours alike, ends not
        texts.append(" ".join(chain))
        chain[n * 8 + 3] = f"step{n}"
    # Hot band keys: many short texts share a sentence and are no copies of each other.
    texts += [f"all rights reserved by the owner of this text {rng.randrange(10**6)} {rng.randrange(10**6)} {n} x{n}" for n in range(300)]
    rows = [(n if n % 7 else None, t) for n, t in enumerate(texts)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("limit", [minhash.ROUTE_LIMIT, 4])
def test_groups_equal_brute_force(families, limit):
    assert _found(minhash.near_duplicates(families, limit=limit)) == _expected(families.collect())


def test_awkward_rows(documents, nothing):
    assert _found(minhash.near_duplicates(documents)) == _expected(documents.collect())
    assert minhash.near_duplicates(nothing).count() == 0
    with pytest.raises(ValueError, match="percent"):
        minhash.near_duplicates(documents, percent=50)


def test_query_equals_sql(spark, sf_dir):
    assert not differences(duck(sf_dir), QUERIES["op11_minhash"](spark, sf_dir), ORACLES["op11_minhash"])


def test_one_leader_of_a_large_family_is_confirmed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PARTNERS", 10)
    rng = random.Random(8)
    rows = list(enumerate(_variants(rng, [f"w{n}" for n in range(90)], 70, 2)))
    given = spark.createDataFrame(rows, "doc_id long, text string")
    assert minhash.near_duplicates(given).agg(F.countDistinct("component_id")).first()[0] == len(
        {e[2] for e in _expected(given.collect())}
    )


def test_registers_hold_zeros_and_mantissa():
    values = np.array([0, 1, 5, (1 << 56) | 12345, (1 << 57) - 1], np.uint64)
    for bucket, value in enumerate(values):
        item = (np.uint64(bucket) << np.uint64(57)) | value
        got = int(minhash.registers(np.array([item], np.uint64))[bucket])
        bits = f"{int(value):057b}"
        zeros = len(bits) - len(bits.lstrip("0"))
        assert got == (zeros + 1 << 10) + int((bits[zeros + 1 :] + "0" * 10)[:10], 2)


def test_collision_correction_and_estimate():
    rng = np.random.default_rng(3)

    def sketch(hashes):
        return minhash.registers(np.unique(hashes))

    def draw(n):
        return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)

    for n in (300, 3_000):
        sets = [sketch(draw(n)) for _ in range(400)]
        hits = np.mean([(a == b)[(a > 0) & (b > 0)].sum() for a, b in zip(sets[::2], sets[1::2])])
        size = np.array([n])
        assert hits == pytest.approx(minhash.expected_collisions(size, size)[0], abs=0.1)
    shares = []
    for _ in range(200):
        common = draw(850)
        one, two = (np.concatenate([common, draw(75)]) for _ in range(2))
        shares.append(minhash.estimate(sketch(one)[None], sketch(two)[None], np.array([925]), np.array([925]))[0][0])
    assert np.mean(shares) == pytest.approx(0.85, abs=0.01)
    least = minhash._cutoffs(85)
    assert (np.array(shares) >= least[128]).all() and 0.5 < least[128] < 0.8


def test_bands_lose_no_pair_at_the_threshold():
    rng, orders = np.random.default_rng(4), minhash._orders()
    for n in (7, 20, 100, 1_000):
        apart = int(0.15 * n)
        for _ in range(300):
            both = rng.integers(0, 1 << 63, n - apart, dtype=np.uint64) * np.uint64(2)
            sets = [np.unique(np.concatenate([both, rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)]))
                    for size in (apart // 2, apart - apart // 2)]
            one, two = (minhash.filled_up(minhash.registers(s), orders).view("<i8") for s in sets)
            assert (one == two).any()


def test_borrowed_registers_agree_as_often_as_sets_do():
    rng, orders = np.random.default_rng(6), minhash._orders()
    hits = []
    for _ in range(400):
        both = rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2)
        one, two = (
            minhash.filled_up(minhash.registers(np.unique(np.append(both, rng.integers(0, 1 << 63, 4, dtype=np.uint64) * np.uint64(2)))), orders)
            for _ in range(2)
        )
        assert one.all() and two.all()
        hits.append((one == two).mean())
    assert np.mean(hits) == pytest.approx(8 / 16, abs=0.03)
    assert not minhash.filled_up(minhash.registers(np.empty(0, np.uint64)), orders).any()
