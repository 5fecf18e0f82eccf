"""The pipeline: what each stage keeps, and the whole against the operators' own verdicts."""

import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_duplicates import _fingerprint, _groups, _normal
from tokenizers import Tokenizer

from clauseloom.llm import secrets, simhash, toxicity
from clauseloom.llm.common import stage


def test_stages_in_order(spark, documents, sf_dir):
    docs, seen = documents, {}
    for name, step in corpus_pipeline.STAGES:
        after = stage(step(spark, docs, sf_dir), f"test-{name}")
        if name != "packing":
            assert after.columns == documents.columns
        seen[name] = (docs, after)
        docs = after
    assert list(seen) == ["toxicity", "exact-dedup", "simhash", "secrets", "packing"]
    squeezed = [" ".join((r.text or "").split()) for r in seen["exact-dedup"][1].collect()]
    assert len(set(squeezed)) >= len(squeezed) - 1  # blank and empty texts differ only here
    groups = simhash.near_duplicates(seen["simhash"][1]).filter("component_id IS NOT NULL")
    assert groups.filter("component_id <> doc_id").count() == 0
    before, after = seen["secrets"]
    assert before.count() == after.count()
    assert after.filter("text LIKE '%ghp_aaaa%' OR text LIKE '%PRIVATE KEY-----%'").count() == 0
    packed = seen["packing"][1]
    assert packed.filter("start = 0").count() == after.count()


def test_empty_table(spark, nothing, sf_dir):
    docs = nothing
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf_dir), f"test-{name}")
        assert docs.count() == 0


def _masked(text):
    islands = []
    for start, end in sorted(
        (m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.pattern, text) if len(m.group(r.value)) >= r.least
    ):
        if islands and start < islands[-1][1]:
            islands[-1][1] = max(end, islands[-1][1])
        else:
            islands.append([start, end])
    out, at = "", 0
    for start, end in islands:
        out, at = out + text[at:start] + secrets.MASK, end
    return out + text[at:]


def test_run_against_brute_force(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean = {r.doc_id for r in toxicity.toxicity(documents, labels).collect() if not r.predicted}
    texts, first = {}, {}
    for r in sorted(documents.select("doc_id", "text").collect()):
        if r.doc_id in clean and first.setdefault(_normal(r.text), r.doc_id) == r.doc_id:
            texts[r.doc_id] = r.text or ""
    groups = _groups([_fingerprint(t) for t in texts.values()], list(texts))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = set()
    for doc_id, group in zip(texts, groups):
        if doc_id == group:
            ids = np.asarray([*tokenizer.encode(_masked(texts[doc_id]), add_special_tokens=False).ids, 2], "<u4")
            for start in range(0, len(ids), 4096):
                piece = ids[start : start + 4096]
                expected.add((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0
    found = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows.collect()]
    assert len(found) == len(set(found)) and set(found) == expected
