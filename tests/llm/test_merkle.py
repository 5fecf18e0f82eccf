"""The Merkle manifest against a plain tree per source."""

import hashlib
import zlib

import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from clauseloom.llm import merkle
from clauseloom.llm.queries import ORACLES, QUERIES


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, text):
    values = (r.doc_id, r.source, r.lang, r.n_chars, text)
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _levels(level):
    levels = [level]
    while len(level) > 1:
        level = [_h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        levels.append(level)
    return levels


def _climb(levels, place):
    """(position in its run, run) per level."""
    steps = []
    for level in levels[:-1]:
        steps.append((place % 3, level[place // 3 * 3 : place // 3 * 3 + 3]))
        place //= 3
    return steps


def _expected(rows):
    sources = {}
    for r in rows:
        even = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        given = r.text.replace("\n", "") if even and r.text is not None else r.text
        sources.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, _leaf(r, r.text), _leaf(r, given), r.doc_id))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _levels([x[2] for x in sorted(sources[s], key=lambda x: x[:4])]) for s in names}
    top = _levels([trees[s][-1][0] for s in names])
    out = []
    for n, s in enumerate(names):
        for place, (_, _, leaf, given, doc_id) in enumerate(sorted(sources[s], key=lambda x: x[:4])):
            steps = _climb(trees[s], place) + _climb(top, n)
            now, siblings = given, []
            for at, run in steps:
                siblings += [d for i, d in enumerate(run) if i != at]
                now = _h(*[now if i == at else d for i, d in enumerate(run)])
            root = top[-1][0]
            out.append((str(doc_id), leaf, trees[s][-1][0], root, _h(*siblings), now, now == root))
    return sorted(out)


def _found(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


@pytest.mark.parametrize("levels", [merkle.LEVELS, 1, 2])
def test_proofs_equal_a_plain_tree(documents, nothing, monkeypatch, levels):
    # Small segments make several rounds, also over the subroots.
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SEGMENT", 3**levels)
    given = documents.drop(*[c for c in documents.columns if c in ("tree", "rank", "size", "block", "path", "given", "leaf")])
    given = given.withColumns({c: F.lit("x") for c in ("tree", "rank", "size", "block", "path", "given", "leaf", "number", "kind")})
    assert _found(merkle.proofs(given)) == _expected(documents.collect())
    assert merkle.proofs(nothing).count() == 0


def test_one_document_and_one_source(spark):
    rows = [(1, "s", "en", 2, "a\nb")]
    schema = "doc_id long, source string, lang string, n_chars int, text string"
    one = spark.createDataFrame(rows, schema)
    assert _found(merkle.proofs(one)) == _expected(one.collect())
    # Rows alike in all: equal segments are stored once and walked from each place.
    many = spark.createDataFrame(rows * 40, schema)
    assert _found(merkle.proofs(many)) == _expected(many.collect())


def test_tampering_shows(spark, sf_dir):
    found = merkle.proofs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in found.collect():
        touched = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in texts[r.doc_id]
        assert r.verified == (not touched)


def test_query_equals_sql(spark, sf_dir):
    assert not differences(duck(sf_dir), QUERIES["op13_merkle"](spark, sf_dir), ORACLES["op13_merkle"])
