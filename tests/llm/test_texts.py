"""Secrets, toxicity, chats and urls."""

import hashlib
import random
import re
import zlib

import compare
import pytest
from pyspark.sql import functions as F

from clauseloom.llm import chat_format, queries, secrets, toxicity, url_filter
from clauseloom.sources.stages import stage


def _found(text):
    out = [
        (m.start(), n, m.end(), r.kind)
        for n, r in enumerate(secrets.RULES)
        for m in re.finditer(r.pattern, text or "")
        if len(m.group(r.value)) >= r.least
    ]
    return sorted(out)


def _listed(found):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in found)


def test_secrets_against_every_pattern(documents, nothing):
    def expected(text):
        found = _found(text)
        base = _listed([f for f in found if f[1] < 3])
        counts = [sum(f[3] == k for f in found) for k in ("assign", "access", "hex")]
        return *counts, hashlib.sha256(base.encode()).hexdigest(), _listed(found)

    rows = documents.collect()
    found = secrets.scan(documents).collect()
    assert sorted((str(r[0]), *r[1:]) for r in found) == sorted((str(r.doc_id), *expected(r.text)) for r in rows)
    assert any("private_key" in r.spans for r in found)
    assert secrets.scan(nothing).count() == 0


def test_masked_texts(documents):
    def masked(text):
        if text is None:
            return None
        islands = []
        for start, _, end, _ in _found(text):
            if islands and start < islands[-1][1]:
                islands[-1][1] = max(end, islands[-1][1])
            else:
                islands.append([start, end])
        out, at = "", 0
        for start, end in islands:
            out, at = out + text[at:start] + secrets.MASK, end
        return out + text[at:]

    done = secrets.mask(documents)
    assert done.columns == documents.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in done.collect()) == sorted(
        (str(r.doc_id), str(masked(r.text))) for r in documents.collect()
    )


def test_trigram_queries():
    assert secrets.trigram_query("abcd|xyz") == [frozenset({"abc", "bcd"}), frozenset({"xyz"})]
    assert secrets.trigram_query("api_?key") == [frozenset({"api", "pi_", "i_k", "_ke", "key"}), frozenset({"api", "pik", "ike", "key"})]
    assert secrets.trigram_query("[0-9a-f]{32,}") == []
    assert secrets.trigram_query("(?:ab|x)c") == []
    assert secrets.trigram_query("-{5}END") == [frozenset({"---", "--e", "-en", "end"})]


def test_candidates_need_all_trigrams(spark):
    docs = spark.createDataFrame([(1, "my secret"), (2, "secre cret"), (3, "sec ret"), (4, None)], "doc_id long, text string")
    rule = (secrets.Rule("it", "secret"),)
    index = secrets.postings(docs, rule)
    found = {r.doc_id: r.kinds for r in secrets.candidates(index, rule).collect()}
    assert found == {1: ["it"], 2: ["it"]}
    assert [r.doc_id for r in secrets.spans(docs, rule).collect()] == [1]


def test_chats_can_be_read_back(spark):
    rng = random.Random(2)
    bits = [
        "<", "|", "im_start", "|>", "<|im_end|>\n", "\\", "</s>", "[INST]", "<<SYS>>", "<\\/s>", " ", "\n", "é", "[/", "INST]",
        "<|text|>", "<|turn|>", "$1", "😀",
    ]
    text = lambda: rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))])
    roles = ["user", "assistant", "system", None, "<|text|>x"]
    rows = [(c, t, rng.choice(roles), text()) for c in [None, *range(150)] for t in range(rng.randint(1, 6))]
    rows += [(500, 1, "user", "twice"), (500, 1, "user", "twice"), (501, None, "assistant", "x")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    expected = {}
    for c, t, role, words in rows:
        expected.setdefault(c, []).append((-1 if t is None else t, role or "", words or ""))
    formatted = chat_format.format_chats(chats)
    read = formatted.select("conv_id", chat_format.read_back("formatted").alias("turns")).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in read} == {c: [t[1:] for t in sorted(v)] for c, v in expected.items()}
    learned = {r.conv_id: (r.loss_chars, r.loss_sha256) for r in chat_format.digests(formatted).collect()}
    for c, turns in expected.items():
        whole = "".join(t[2] for t in sorted(turns) if t[1] == "assistant")
        assert learned[c] == (len(whole), hashlib.sha256(whole.encode()).hexdigest())
    assert chat_format.format_chats(chats.limit(0)).count() == 0


def test_adjacent_turns_of_a_role_share_a_block(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    row = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert row.formatted == (
        "<|im_start|>user<|text|>a<|turn|>b<|im_end|>\n<|im_start|>assistant<|text|>c<|im_end|>\n"
    )
    assert "".join(s.text for s in row.segments) == row.formatted
    assert [s.text for s in row.segments if s.loss] == ["c"]


def test_terms_with_edits_are_found():
    trie = toxicity.Trie({"idiot": 1.0, "disgusting": 1.0, "scum": 1.0, "idiom": 0.5})
    assert trie.nearest("idiot") == ("idiot", 0)
    assert trie.nearest("idioot") == ("idiot", 1)
    assert trie.nearest("idio") == ("idiot", 1)
    assert trie.nearest("disgasting") == ("disgusting", 1)
    assert toxicity.Trie({"disgustingly": 1.0}).nearest("disgastngly") == ("disgustingly", 2)
    assert trie.nearest("scam") is None and trie.nearest("idol") is None


def test_automaton_agrees_with_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(row[-1] + 1, last[j + 1] + 1, last[j] + (x != y)))
        return row[-1]

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(3, 12)))
    terms = {word(): 1.0 for _ in range(60)}
    trie = toxicity.Trie(terms)
    for _ in range(400):
        w = word()
        near = [d for t in terms for d in [distance(w, t)] if d <= toxicity.edits(len(t)) and d <= toxicity.edits(len(w) + 1)]
        found = trie.nearest(w)
        assert (found and found[1]) == (min(near) if near else None)


def test_misspellings_of_every_term_are_found():
    rng = random.Random(4)
    terms = {"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 14))): 5.0 - n / 1000 for n in range(500)}
    reader = toxicity.Reader(terms)
    for term, weight in terms.items():
        at = rng.randrange(len(term))
        assert reader.words[term[:at] + "z" + term[at + 1 :]] == weight * 0.5


def test_two_edits_from_ten_letters():
    reader = toxicity.Reader({"disgusting": 2.0})
    assert reader.words["dizgusding"] == reader.words["disgstingx"] == 0.5


def test_quotation_weakens_evidence():
    reader = toxicity.Reader({"idiot": 2.0})
    assert reader.evidence("you idiot") == 2.0
    assert reader.evidence('they wrote "what an idiot" there') == pytest.approx(2.0 * toxicity.QUOTED)
    assert reader.evidence("the word idiot") == pytest.approx(2.0 * toxicity.QUOTED)
    assert reader.evidence("idioot") == 1.0
    assert reader.evidence("") == 0.0


def test_curve_never_falls():
    curve = toxicity.fit_curve([(0, 100, 1), (1, 10, 5), (2, 10, 0), (5, 10, 9)])
    assert [v for _, v in curve] == sorted(v for _, v in curve)
    assert toxicity.fit_curve([]) == [(0.0, toxicity.PRIOR_RATE)]


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    rows = toxicity.toxicity(documents, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) >= 0.6
    assert sum(r.predicted for r in clean) / len(clean) <= 0.05
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_of_awkward_rows(spark, documents, nothing, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = toxicity.toxicity(documents, labels)
    assert rows.count() == documents.count() and rows.filter("score IS NULL").count() == 0
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert toxicity.toxicity(documents, labels.limit(0)).filter("predicted = 1").count() == 0
    kept = toxicity.clean_documents(documents, labels)
    assert kept.columns == documents.columns
    assert kept.count() == rows.filter("predicted = 0").count()


def test_url_parts_and_rules(spark, sf_dir):
    urls = [
        (1, "https://A.Example.ORG/es/x?q#f"), (2, "http://example.org/en/12"), (3, "x.example.org/en/1"), (4, None),
        (5, "http://sample.com/fr/1"), (6, "http://sample.com/de/1"), (7, "http://badexample.org?x"), (8, "http://org/"),
        (9, "http://h.net/a://b#c"), (9, "http://h.net/a://b#c"), (None, ""),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("shape", F.lit(2))
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert found[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert found[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert found[3][:3] == ("", "", None) and found[4][:3] == ("", "", None) and found[None][:3] == ("", "", None)
    assert found[5][2:] == ("com/fr/", "allow") and found[6][2:] == ("com/de/", "block")
    assert found[7][:3] == ("badexample.org", "", None)
    assert found[8][2:] == ("org/", "allow")
    assert found[9][:3] == ("h.net", "/a://b", None)
    assert url_filter.judge(pages).count() == len(urls)
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_templates_follow_their_labels(spark):
    rows = [("h.com", f"/shop/{n}/x", "block") for n in range(40)] + [("h.com", f"/shop/{n}/x", None) for n in range(40, 60)]
    rows += [("h.com", f"/blog/post{c}", "allow") for c in "abcdefghijklmnopqrstuvwxyzäöüß"] + [("h.com", "/blog/other", None)]
    pages = stage(
        spark.createDataFrame(rows, "host string, path string, verdict string").withColumn(
            "shape", F.array_join(F.transform(F.split("path", "/"), url_filter.shape_of), "/")
        ),
        "test-pages",
    )
    found = pages.join(url_filter.templates(pages), ["host", "shape"]).collect()
    of = {r.path: (r.template, r.purity) for r in found}
    assert of["/shop/50/x"][0] == "/shop/#/x" and of["/shop/50/x"][1] > url_filter.REJECT
    assert of["/blog/other"][0] == "/blog/*" and of["/blog/other"][1] < 0.2
    assert len(found) == len(rows)


def _verdicts(pages):
    """The method of the url filter in plain Python: (page_id, verdict) of each page."""
    rows = []
    for page_id, url in pages:
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1].lower(), found[2]) if found else ("", "")
        fitting = [
            (len(h + p), kind) for kind, h, p in url_filter.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        generalised = [re.sub("[0-9]+", "#", re.sub("[0-9a-f]{8,}(-[0-9a-f]{4,})*", "#", s)) for s in path.split("/")]
        parts = [s for s in "/".join(generalised).split("/") if s]
        rows.append([page_id, host, parts, max(fitting)[1] if fitting else None])
    smoothing = url_filter.SMOOTHING
    ruled = [r for r in rows if r[3]]
    base = (sum(r[3] == "block" for r in ruled) + 0.25 * smoothing) / (len(ruled) + smoothing)

    def grow(group, level, parent):
        labelled = [r for r in group if r[3]]
        purity = (sum(r[3] == "block" for r in labelled) + smoothing * parent) / (len(labelled) + smoothing)
        branches = {}
        for r in group:
            if len(r[2]) > level:
                branches.setdefault(r[2][level], []).append(r)
            else:
                yield r[0], r[3] or ("block" if purity >= url_filter.REJECT else "allow")
        rare = {s for s, own in branches.items() if len(own) <= url_filter.RARE}
        general = {}
        for s, own in branches.items():
            many = len(branches) > url_filter.MANY and 2 * len(rare) > len(branches)
            general.setdefault("*" if many and s in rare else s, []).extend(own)
        counts = {s: (sum(bool(r[3]) for r in own), sum(r[3] == "block" for r in own)) for s, own in general.items()}
        clusters, before = [], None
        for s in sorted((s for s in counts if counts[s][0]), key=lambda s: (counts[s][1] / counts[s][0], s)):
            n, b = counts[s]
            if before is not None:
                pooled = (b + before[1]) / (n + before[0])
                error = (max(pooled * (1 - pooled), 1e-12) * (1 / n + 1 / before[0])) ** 0.5
                if abs(b / n - before[1] / before[0]) > url_filter.SIMILAR_Z * error:
                    before = None
            if before is None:
                clusters.append([])
            clusters[-1].append(s)
            before = (n, b)
        clusters += [[s] for s in counts if not counts[s][0]]
        for cluster in clusters:
            yield from grow([r for s in cluster for r in general[s]], level + 1, purity)

    for host in {r[1] for r in rows}:
        yield from grow([r for r in rows if r[1] == host], 0, base)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_url_verdicts_against_brute_force(spark, folder):
    pages = spark.read.parquet(f"/root/testdata/{folder}/pages.parquet").select("page_id", "url")
    more = [(n, f"http://shop.net/{'de' if n % 2 else 'fr'}/{n}") for n in range(10**6, 10**6 + 60)]
    more += [(n, f"https://mixed.com/{'de' if n % 3 else 'fr'}/item-{n}/x") for n in range(10**6 + 60, 10**6 + 160)]
    more += [(n, f"https://mixed.com/en/{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}") for n in range(10**6 + 160, 10**6 + 260)]
    pages = pages.unionByName(spark.createDataFrame(more, "page_id long, url string"))
    found = sorted((r.page_id, r.verdict) for r in url_filter.judge(pages).collect())
    assert found == sorted(_verdicts([(r.page_id, r.url) for r in pages.collect()]))


@pytest.mark.parametrize("name", ["op2_chat_format", "op3_exact_dedup", "op5_secrets"])
def test_queries_agree_with_sql(spark, sf_dir, name):
    assert not compare.differences(compare.duck(sf_dir), queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name])
