"""Clause detection, passages and summaries on small texts, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from clauseloom.operators import clauses, metrics, passages, summary, validate
from clauseloom.sources.stages import stage, stage_by_key
from clauseloom.taxonomy import CLAUSE_TYPES, clause_type

AGREEMENT = (
    "SERVICE AGREEMENT This agreement may be terminated by either party with 30 days written notice. "
    "All confidential information shall remain confidential and not be disclosed to third parties without written "
    "consent. The service provider shall not be liable for any indirect or consequential damages arising from this "
    "agreement."
)


def contracts(spark, *texts):
    rows = [(f"c{i}", f"c{i}.pdf", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "contract_id string, filename string, text string")


def test_sample_agreement_has_all_three(spark):
    row = clauses.find_clauses(contracts(spark, AGREEMENT)).first()
    assert "terminated" in row["termination_clause"]
    assert "confidential" in row["confidentiality_clause"]
    assert "liable" in row["liability_clause"]


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        ("The end.", True),
        ("The ends meet.", False),
        ("A trend shows.", False),
        ("It was TERMINATED early.", True),
        ("Predetermination is not it.", False),
        ("pre-termination applies.", True),
        ("Cancellation is possible.", True),
        ("end", True),
        ("weekend_end", False),
    ],
)
def test_keyword_boundaries(spark, text, hit):
    row = clauses.find_clauses(contracts(spark, text)).first()
    assert (row["termination_clause"] is not None) is hit


def test_several_sentences_keep_order_and_wording(spark):
    text = "You may cancel now. Nothing here. Rights expire later! The end? Bye."
    row = clauses.find_clauses(contracts(spark, text)).first()
    assert row["termination_clause"] == "You may cancel now. Rights expire later! The end?"


def test_absent_and_failed_tasks_show_agreed_phrases(spark):
    rows = spark.createDataFrame(
        [("termination", "absent", None), ("liability", "error", None), ("summary", "error", None),
         ("liability", "found", "No party shall be liable.")],
        "task string, status string, value string",
    )
    assert [r[0] for r in rows.select(clauses.sentinel("task", "status", "value")).collect()] == [
        "No termination clause found", "Error extracting liability clause", "Error generating summary",
        "No party shall be liable.",
    ]


def test_real_clause_starting_with_no_is_kept_unless_by_value(spark):
    rows = spark.createDataFrame(
        [("No party shall be liable.", "found"), ("", "found"), (None, "absent"), ("Error extracting x", "found"), ("Fine.", "found")],
        "clause string, status string",
    )
    assert clauses.indexable(rows).count() == 4
    assert [r["clause"] for r in clauses.indexable(rows, by_value=True).collect()] == ["Fine."]


def test_clause_rows_hold_every_type_once(spark):
    rows = clauses.clause_rows(clauses.find_clauses(contracts(spark, AGREEMENT, "Nothing at all.")))
    assert rows.count() == 6
    assert rows.filter("status = 'absent'").count() == 3
    assert rows.filter("(status = 'found') = (clause is null)").isEmpty()


def test_exemplars_are_most_like_themselves(spark):
    rows = [("x", c.name, c.exemplar) for c in CLAUSE_TYPES] + [("x", "liability", "..."), ("x", "liability", "zebra zebra")]
    frame = spark.createDataFrame(rows, "contract_id string, clause_type string, clause string")
    scores = [round(r["exemplar_score"], 9) for r in clauses.exemplar_similarity(frame).collect()]
    assert scores == [1.0, 1.0, 1.0, 0.0, 0.0]


def _spans(text: str, kind: str, merge: bool) -> list[tuple[int, int, int]]:
    clause, pattern = clause_type(kind), re.compile(clauses.keyword_pattern(clause_type(kind).keywords).replace(r"\p{L}\p{N}_", r"\w"))
    out = []
    for pos, m in enumerate(re.finditer(r"[^.!?]+[.!?]*", text)):
        if pattern.search(m.group().lower()):
            first, last = max(0, m.start() - clause.context_window), min(len(text), m.end() + clause.context_window)
            if merge and out and out[-1][2] >= first:
                out[-1] = (out[-1][0], out[-1][1], max(out[-1][2], last))
            else:
                out.append((pos, first, last))
    return out


def test_passages_equal_brute_force(spark):
    random.seed(5)
    words = ["alpha", "beta", "end", "liable", "secret", "trade secret", "Würde", "x" * 150, "🙂"]
    texts = [
        random.choice(["", "..", "! "])
        + "".join(
            " ".join(random.choices(words[:2] + words[6:] if random.random() < 0.7 else words, k=random.randint(1, 12)))
            + random.choice([".", "!", "?..", ". "])
            for _ in range(random.randint(1, 60))
        )
        for _ in range(25)
    ]
    frame = contracts(spark, *texts)
    for merge, operator in ((False, passages.context_windows), (True, passages.merged_passages)):
        got = sorted(
            (r["contract_id"], r["clause_type"], r["pos"], r["first"], r["last"], r["passage"])
            for r in operator(frame).collect()
        )
        want = sorted(
            (f"c{i}", c.name, pos, first, last, t[first:last])
            for i, t in enumerate(texts)
            for c in CLAUSE_TYPES
            for pos, first, last in _spans(t, c.name, merge)
        )
        assert got == want


def test_offsets_locate_each_sentence(spark):
    texts = ["..One. Two!? Three", "Über. 🙂 ok."]
    frame = contracts(spark, *texts)
    joined = passages.sentence_offsets(frame).join(frame, "contract_id").select(
        "contract_id", "pos", F.substring("text", F.col("start").cast("int") + 1, F.col("length")).alias("s")
    )
    assert sorted(tuple(r) for r in joined.collect()) == [
        ("c0", 0, "One."), ("c0", 1, " Two!?"), ("c0", 2, " Three"), ("c1", 0, "Über."), ("c1", 1, " 🙂 ok."),
    ]


def test_best_chunk_is_the_one_with_most_hits(spark):
    frame = spark.createDataFrame(
        [("c", 0, "The end."), ("c", 1, "Cancel. Expire. x."), ("c", 2, "Cancel. Expire."), ("d", 0, "none")],
        "contract_id string, chunk_no int, chunk string",
    )
    assert [tuple(r) for r in clauses.best_chunks(frame).collect()] == [("c", "termination", 1, 2)]


def test_summary_is_in_order_and_not_too_long(spark):
    long_sentence = " ".join(["word"] * 400) + "."
    texts = [AGREEMENT + " " + " ".join(f"Filler sentence number {i} is here." for i in range(60)), long_sentence, "Short one."]
    rows = {r["contract_id"]: r for r in summary.summarize(contracts(spark, *texts)).collect()}
    assert set(rows) == {"c0", "c1", "c2"}
    for r in rows.values():
        assert 0 < len(r["summary"].split()) == r["words"]
    assert rows["c0"]["words"] <= 150 and rows["c2"]["summary"] == "Short one."
    # A sentence is never cut: the only one there is comes whole, and the length check tells of it.
    assert rows["c1"]["summary"] == long_sentence
    assert not summary.length_check(summary.summarize(contracts(spark, long_sentence))).first()["in_range"]
    positions = [texts[0].find(s.strip()) for s in re.findall(r"[^.]+\.", rows["c0"]["summary"])]
    assert positions == sorted(positions) and "terminated" in rows["c0"]["summary"]


def test_summary_weighs_whole_sentences_and_loses_no_contract(spark):
    tail = " ".join(f"plain{i}" for i in range(170)) + " terminate."
    rows = {r["contract_id"]: r for r in summary.summarize(contracts(spark, f"{tail} Other words here.", "...", "")).collect()}
    assert rows["c0"]["summary"].endswith("terminate.")
    assert [(rows[c]["summary"], rows[c]["words"]) for c in ("c1", "c2")] == [("", 0), ("", 0)]


def test_completeness(spark):
    summaries = spark.createDataFrame([("a", "We terminate."), ("b", "Nothing.")], "contract_id string, summary string")
    found = spark.createDataFrame(
        [("a", "t", "c", None), ("b", None, None, None)],
        "contract_id string, termination_clause string, confidentiality_clause string, liability_clause string",
    )
    got = {r["contract_id"]: tuple(r)[1:] for r in summary.completeness(summaries, found).collect()}
    assert got == {"a": (2, 1, 0.5), "b": (0, 0, None)}


def test_accuracy_counts_misses_and_false_hits(spark):
    truth = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "contract_id string, clause_type string")
    predicted = spark.createDataFrame([("a", "x"), ("c", "x")], "contract_id string, clause_type string")
    got = {r["clause_type"]: tuple(r)[1:] for r in metrics.detection_accuracy(truth, predicted).collect()}
    assert got == {"x": (1, 1, 1, 0.5, 0.5), "y": (0, 0, 1, None, 0.0)}


def test_violations_name_the_rule(spark):
    rows = spark.createDataFrame(
        [("a", "f", "found", ""), ("b", None, "found", "t"), ("c", "f", "absent", "t"), ("d", "f", "absent", None)],
        "contract_id string, filename string, status string, clause string",
    )
    got = {tuple(r) for r in validate.violations(rows, validate.clause_rules(), "contract_id").collect()}
    assert got == {("a", "found_without_text"), ("b", "filename_missing"), ("c", "text_without_found")}


def test_summaries_move_no_text_of_contracts_laid_out_by_id(spark):
    rows = spark.range(300).select(
        F.format_string("c%d", F.col("id") % 290).alias("contract_id"),
        F.concat(F.repeat(F.lit("The parties agree. "), 3), F.lit("Word"), F.col("id").cast("string"), F.lit(" ends it.")).alias("text"),
    )
    plain = rows.dropDuplicates(["contract_id"])
    laid_out = stage_by_key(plain, "laid-out", "contract_id")
    summaries = summary.summarize(laid_out)
    wanted = sorted(map(tuple, summary.summarize(stage(laid_out, "plain")).collect()))
    assert sorted(map(tuple, summaries.collect())) == wanted and len(wanted) == 290
    lines = summaries._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    texts = [line for line in lines if "Scan parquet" in line and "text#" in line]
    assert texts and all("Bucketed: true" in line for line in texts)
    join = next(i for i, line in enumerate(lines) if "ShuffledHashJoin" in line and "LeftOuter" in line)
    # The side of the texts comes first: nothing but the scan lies below it.
    assert not any("Exchange" in line for line in lines[join + 1 : join + 4] if line.lstrip(" :").startswith(":-"))
    assert "Scan parquet" in "".join(lines[join + 1 : join + 4])
