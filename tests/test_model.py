"""Prompts, the model hook, retries and the whole job."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clauseloom.operators import prompts, summary
from clauseloom.options import IngestOptions, ModelOptions, Options, OutputOptions, SearchOptions
from clauseloom.plans import contracts as job
from clauseloom.sources import results
from clauseloom.taxonomy import CLAUSE_TYPES, TASK_NAMES, prompt_frame
from test_clauses import AGREEMENT
from test_files import docx_bytes


def contracts(spark, n=2):
    rows = [(f"c{i}", f"c{i}.pdf", f"{AGREEMENT} Number {i}.") for i in range(n)]
    return spark.createDataFrame(rows, "contract_id string, filename string, text string")


def test_every_type_has_an_example_in_its_prompt():
    for c in CLAUSE_TYPES:
        own = {c.name: ("A system line.", "Find it.")}
        assert c.exemplar in prompt_frame(c.name)[1] and c.exemplar in prompt_frame(c.name, own)[1]
        assert prompt_frame(c.name, own)[0] == "A system line."
    with pytest.raises(KeyError):
        prompt_frame("payment")


def test_prompt_contents(spark):
    rows = {r["task"]: r for r in prompts.prompts(contracts(spark, 1)).collect()}
    assert set(rows) == set(TASK_NAMES)
    assert "Extract termination clauses" in rows["termination"]["prompt"]
    assert rows["termination"]["prompt"].endswith("\n\nTermination clause:")
    for words in ("100-150 words", "Purpose", "obligations", "SERVICE AGREEMENT"):
        assert words in rows["summary"]["prompt"]
    assert (rows["liability"]["max_tokens"], rows["liability"]["temperature"]) == (500, 0.1)
    assert (rows["summary"]["max_tokens"], rows["summary"]["temperature"]) == (200, 0.3)


def test_prompt_holds_at_most_4000_characters_of_text(spark):
    frame = spark.createDataFrame([("c", "z" * 5_000)], "contract_id string, text string")
    assert {r["prompt"].count("z") - r["prompt"].replace("z" * 4_000, "").count("z") for r in prompts.prompts(frame).collect()} == {4_000}


def test_own_prompts(spark):
    own = ModelOptions(library={"termination": ("You know endings.", "Quote the notice requirements.")})
    rows = {r["task"]: r for r in prompts.prompts(contracts(spark, 1), own).collect()}
    assert "notice requirements" in rows["termination"]["prompt"] and rows["termination"]["system"] == "You know endings."
    assert rows["liability"]["prompt"] == prompts.prompts(contracts(spark, 1)).filter("task = 'liability'").first()["prompt"]


def test_every_part_of_a_long_text_is_asked_about(spark):
    frame = spark.createDataFrame([("c", "z" * 9_500), ("d", "")], "contract_id string, text string")
    rows = prompts.chunked_prompts(frame, 4_000, names=["summary"]).orderBy("contract_id", "chunk_no").collect()
    assert [(r["contract_id"], r["chunk_no"]) for r in rows] == [("c", 0), ("c", 1), ("c", 2), ("d", 0)]
    assert "".join(r["prompt"] for r in rows).count("z" * 1_000) == 9


def test_answers_keep_going_when_a_call_fails(spark):
    def one(request):
        if request["task"] == "liability":
            raise RuntimeError("rate limit")
        if request["task"] == "confidentiality":
            return " no confidentiality clause FOUND. "
        return f"  {request['task']} answer\n" if request["task"] == "termination" else None

    def model(requests):
        return [one(r) for r in requests]

    rows = prompts.answer(prompts.prompts(contracts(spark)), model).collect()
    got = {(r["contract_id"], r["task"]): (r["status"], r["value"], r["message"]) for r in rows}
    assert len(got) == 8
    assert got["c0", "termination"] == ("found", "termination answer", None)
    assert got["c1", "confidentiality"] == ("absent", None, None)
    assert got["c1", "liability"] == ("error", None, "RuntimeError: rate limit")
    assert got["c0", "summary"] == ("error", None, "no answer")


def test_a_batch_is_one_call(spark):
    def model(requests):
        return [str(len(requests))] * len(requests)

    rows = prompts.answer(prompts.prompts(contracts(spark, 5)).coalesce(1), model).collect()
    assert {r["value"] for r in rows} == {"20"}
    short = prompts.answer(prompts.prompts(contracts(spark, 1)), lambda requests: ["x"][: len(requests) - 1]).collect()
    assert {r["status"] for r in short} == {"error"}


def test_answers_about_chunks_are_joined(spark):
    rows = [("a", "liability", 1, "found", "two"), ("a", "liability", 0, "found", "one"), ("a", "liability", 2, "absent", None),
            ("b", "liability", 0, "absent", None), ("c", "liability", 0, "found", "x"), ("c", "liability", 1, "error", None)]
    frame = spark.createDataFrame(rows, "contract_id string, task string, chunk_no int, status string, value string")
    got = {r["contract_id"]: (r["status"], r["value"]) for r in prompts.chunked_answers(frame.withColumn("attempt", F.lit(1))).collect()}
    assert got == {"a": ("found", "one two"), "b": ("absent", None), "c": ("error", None)}


def test_best_response_is_the_latest_success(spark):
    responses = spark.createDataFrame(
        [("a", "summary", 1, "error", None), ("a", "summary", 2, "found", "two"), ("a", "summary", 3, "error", None),
         ("b", "summary", 1, "error", None), ("b", "summary", 2, "error", None)],
        "contract_id string, task string, attempt int, status string, value string",
    )
    got = {r["contract_id"]: (r["attempt"], r["status"], r["value"]) for r in prompts.best_responses(responses).collect()}
    assert got == {"a": (2, "found", "two"), "b": (2, "error", None)}
    tasks = spark.createDataFrame([(c, "summary") for c in "abc"], "contract_id string, task string")
    pending = {tuple(r) for r in prompts.pending_tasks(tasks, responses, 3).collect()}
    assert pending == {("b", "summary", 3), ("c", "summary", 1)}
    assert prompts.pending_tasks(tasks, responses, 2).count() == 1
    shown = {r["contract_id"]: r["shown"] for r in prompts.task_results(tasks, responses).collect()}
    assert shown == {"a": "two", "b": "Error generating summary", "c": "Error generating summary"}


@pytest.mark.parametrize(
    "broken",
    [
        lambda: IngestOptions(max_contracts=0),
        lambda: IngestOptions(min_text_length=10, max_text_length=10),
        lambda: ModelOptions(max_tokens_clause=0),
        lambda: ModelOptions(temperature_extraction=1.5),
        lambda: ModelOptions(library={"payment": ("a", "b")}),
        lambda: SearchOptions(max_results=0),
        lambda: OutputOptions(csv_path="same", json_path="same"),
    ],
)
def test_options_are_checked(broken):
    with pytest.raises(ValueError):
        broken()


@pytest.fixture()
def folder(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name in ("b.docx", "a.docx"):
        (source / name).write_bytes(docx_bytes(*AGREEMENT.split(". ")))
    (source / "c.pdf").write_bytes(AGREEMENT.encode())
    (source / "d.pdf").write_bytes(b"too short")
    return tmp_path


PDF = {"pdf": [("plain", lambda content: content.decode())]}


def test_whole_job_over_files(spark, folder):
    output = OutputOptions(str(folder / "csv"), str(folder / "json"), str(folder / "stages"))
    (folder / "in" / "zero.pdf").write_bytes(b"")
    (folder / "in" / "other.odt").write_bytes(b"x")
    options = Options(ingest=IngestOptions(sequential_ids=True), output=output)
    done = job.run(spark, str(folder / "in"), options, extractors=PDF)
    ids = {r["filename"]: r["contract_id"] for r in done.contracts.collect()}
    assert ids == {"c.pdf": "contract_001", "a.docx": "contract_004", "b.docx": "contract_005"}
    assert sorted((r["filename"], r["reason"]) for r in done.rejects.collect()) == [
        ("d.pdf", "too_short"), ("other.odt", "unsupported"), ("zero.pdf", "no_text")
    ]
    assert done.clauses.count() == 9 and done.clauses.filter("status = 'found'").count() == 9
    saved = results.read_csv(spark, str(folder / "csv"))
    assert saved.count() == 3 and saved.filter("termination_clause like '%terminated%'").count() == 3
    assert results.read_json(spark, str(folder / "json")).count() == 3
    assert {p.name for p in (folder / "stages").iterdir()} >= {"screened", "clauses", "results", "postings"}
    assert {p.name for p in (folder / "stages" / "clauses").glob("clause_type=*")} == {
        f"clause_type={c.name}" for c in CLAUSE_TYPES
    }
    # These summaries are shorter than asked for, nothing else is wrong.
    assert {r["rule"] for r in done.violations.collect()} == {"summary_length"}
    tight = Options(ingest=IngestOptions(min_text_length=10, max_text_length=20), search=SearchOptions(enabled=False))
    assert {r["rule"] for r in job.run(spark, str(folder / "in"), tight, extractors=PDF).violations.collect()} >= {"text_too_long"}

    asked = spark.createDataFrame([("q", "liable for damages")], "query_id string, text string")
    hits = job.search(done, asked, 2).orderBy("rank").collect()
    assert [h["rank"] for h in hits] == [1, 2] and hits[0]["clause_type"] == "liability"
    assert job.search(done, asked, 50).count() == 7
    assert job.search(done, asked, 50, Options(search=SearchOptions(max_results=2))).count() == 2
    strict = Options(search=SearchOptions(similarity_threshold=0.99))
    assert job.search(done, asked, 5, strict).count() == 0


def test_job_takes_the_head_of_the_listing_before_screening(spark, folder):
    options = Options(ingest=IngestOptions(max_contracts=2, sequential_ids=True), search=SearchOptions(enabled=False))
    done = job.run(spark, str(folder / "in"), options, extractors=PDF)
    assert [r["filename"] for r in done.contracts.collect()] == ["c.pdf"]
    assert done.rejects.count() == 1
    asked = spark.createDataFrame([("q", "x")], "query_id string, text string")
    assert job.search(done, asked).count() == 0


def test_job_reads_text_files_and_only_the_formats_asked_for(spark, tmp_path):
    (tmp_path / "a.txt").write_text(AGREEMENT)
    (tmp_path / "b.pdf").write_text(AGREEMENT)
    options = Options(ingest=IngestOptions(supported_formats=("txt",)), search=SearchOptions(enabled=False))
    done = job.run(spark, str(tmp_path), options)
    assert [r["filename"] for r in done.contracts.collect()] == ["a.txt"]
    assert [(r["filename"], r["reason"]) for r in done.rejects.collect()] == [("b.pdf", "unsupported")]
    assert done.funnel == {"loaded": 1, "no_text": 0, "too_short": 0, "unsupported": 1}


def test_funnel_of_a_run_adds_up_to_the_listing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in {"a.txt": AGREEMENT, "b.TXT": AGREEMENT, "c.txt": "short", "d.txt": "", "e.odt": "x", "f.odt": ""}.items():
        (tmp_path / "in" / name).write_text(text)
    options = Options(search=SearchOptions(enabled=False))
    done = job.run(spark, str(tmp_path / "in"), options)
    assert done.funnel == {"loaded": 2, "no_text": 1, "too_short": 1, "unsupported": 2}
    assert done.contracts.count() + done.rejects.count() == sum(done.funnel.values()) == 6
    shuffled = spark.createDataFrame([(f"c{n}", "a.txt", AGREEMENT) for n in range(50)], "contract_id string, filename string, text string")
    assert job.run(spark, shuffled.repartition(7, "contract_id"), options).funnel["loaded"] == 50


def test_job_with_an_embedder_and_its_cache(spark):
    calls = spark.sparkContext.accumulator(0)

    def embedder(texts):
        calls.add(len(texts))
        return [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]

    first = job.run(spark, contracts(spark, 3), embedder=embedder)
    made = first.vectors.count()
    assert calls.value == made == first.items.select("clause").distinct().count()
    again = job.run(spark, contracts(spark, 3), embedder=embedder, vector_cache=first.vectors)
    assert calls.value == made and again.vectors.count() == made
    asked = spark.createDataFrame([("q", first.items.filter("clause_type = 'liability'").first()["clause"])], "query_id string, text string")
    hits = job.search(first, asked, 3, embedder=embedder).orderBy("rank").collect()
    assert [h["clause_type"] for h in hits] == ["liability"] * 3 and hits[0]["score"] == pytest.approx(1.0)


def test_a_store_of_vectors_only_grows(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    folder = str(tmp_path / "store")

    def embedder(texts):
        calls.add(len(texts))
        return [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]

    def files():
        return {str(f): f.stat().st_mtime_ns for f in (tmp_path / "store").rglob("*.parquet")}

    first = job.run(spark, contracts(spark, 3), embedder=embedder, vector_cache=folder)
    made, before = calls.value, files()
    assert made == first.vectors.count() == first.items.select("clause").distinct().count()
    again = job.run(spark, contracts(spark, 3), embedder=embedder, vector_cache=folder)
    assert calls.value == made == again.vectors.count() and before.items() <= files().items()
    text = "This agreement starts today. Either party may terminate this agreement on ninety days of written notice to all. " * 3
    other = spark.createDataFrame([("x", "x.txt", text)], "contract_id string, filename string, text string")
    more = job.run(spark, other, embedder=embedder, vector_cache=folder)
    new = calls.value - made
    assert new == more.items.select("clause").distinct().count() > 0
    assert more.vectors.count() == more.vectors.select("digest").distinct().count() == made + new
    assert before.items() <= files().items()
    asked = spark.createDataFrame([("q", more.items.first()["clause"])], "query_id string, text string")
    hits = job.search(more, asked, 3, embedder=embedder)
    assert {h["contract_id"] for h in hits.collect()} == {"x"}


def test_job_with_path_ids(spark, folder):
    options = Options(ingest=IngestOptions(sequential_ids=False), search=SearchOptions(enabled=False), validate=False)
    done = job.run(spark, str(folder / "in"), options, extractors=PDF)
    assert {len(r["contract_id"]) for r in done.contracts.collect()} == {64} and done.violations is None


def test_job_without_contracts_fails(spark, tmp_path):
    with pytest.raises(ValueError):
        job.run(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        job.run(spark, str(tmp_path / "nowhere"))


def test_job_with_a_model_retries_and_records_failures(spark, folder):
    tries = folder / "tries"
    tries.mkdir()

    def model(requests):
        return [one(r) for r in requests]

    def one(request):
        if request["task"] == "liability":
            return None
        if request["task"] == "termination":
            # Has no answer once per contract, then works.
            mark = tries / hashlib.md5(request["prompt"].encode()).hexdigest()
            if not mark.exists():
                mark.touch()
                return None
            return "Either party may terminate with 30 days notice"
        if request["task"] == "confidentiality":
            return "No confidentiality clause found"
        return "Service agreement with termination and confidentiality clauses"

    table = contracts(spark, 3)
    done = job.run(spark, table, Options(model=ModelOptions(max_attempts=3)), model=model)
    row = done.results.orderBy("contract_id").first()
    assert "terminate" in row["termination_clause"]
    assert row["confidentiality_clause"] == "No confidentiality clause found"
    assert row["liability_clause"] == "Error extracting liability clause"
    tried = {r["task"]: r["n"] for r in done.responses.groupBy("task").agg(F.count("*").alias("n")).collect()}
    assert tried == {"termination": 6, "confidentiality": 3, "liability": 9, "summary": 3}
    assert done.items.count() == 3


def test_custom_steps_chain(spark):
    flagged = contracts(spark).transform(
        lambda df: df.withColumn("has_termination", F.lower("text").contains("terminat"))
    )
    assert flagged.filter("has_termination").count() == 2


def test_a_summary_splits_each_text_into_terms_twice(spark, monkeypatch):
    texts = ["Rent is due monthly. Rent is due. The tenant pays a rare levy.", "... !", None, "Ödön pays rent. Rent", "!! Rent is due."]
    contracts = spark.createDataFrame(list(enumerate(texts)), "contract_id int, text string")
    want = {tuple(r) for r in summary.summarize(contracts, max_words=4).collect()}
    assert {r[1] for r in want} == {"Rent is due.", "The tenant pays a rare levy.", "", "Ödön pays rent. Rent"}
    split, calls = summary.T.lowered_terms, []
    monkeypatch.setattr(summary.T, "lowered_terms", lambda lowered: calls.append(1) or split(lowered))
    monkeypatch.setattr(summary, "FREQUENT", 5)  # most terms are rare now and looked up by a shuffle
    assert {tuple(r) for r in summary.summarize(contracts, max_words=4).collect()} == want
    assert len(calls) == 2


def test_texts_split_in_tasks_are_split_as_spark_splits_them(spark, monkeypatch):
    chars = list("abcXYZ019_ .!?,;\n\t\xa0 éßÖİΣЖ漢字😀٣Ⅷ²—’\x85\x1c\u200bǅ𝒳")
    texts = ["".join(chars[(i * 7 + n * n * (i + 3)) % len(chars)] for n in range(i % 90)) for i in range(400)]
    texts += ["...", "!! x.", " . . .", "a b.c d..e", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", F.lower("text").alias("text"))
    T = summary.T
    pieces = frame.select("*", T.lowered_terms("text").alias("terms"), T.sentences("text").alias("sentences"))
    rows = pieces.withColumn("words", F.transform("sentences", lambda x: T.word_count(x))).orderBy("id").collect()
    kinds = summary._kinds(spark)
    monkeypatch.setattr(summary, "SLICE_BYTES", 300)
    batch = pa.RecordBatch.from_arrays([pa.array([r["text"] for r in rows])], ["text"])
    terms, sentences, words = [], [], []
    for part in summary._slices(batch, 0):
        own, first = summary._Split(part.column(0), kinds), len(terms)
        for made in (terms, sentences, words):
            made += [[] for _ in range(len(part))]
        for n, term in zip(own.owners(own.bounds[:-1], own.bounds[1:]), own.codes):
            terms[first + n].append(own.terms[int(term)].as_py())
        for n, begin, end, count in zip(*own.sentences(), own.words(*own.sentences()[1:])):
            sentences[first + n].append(own.data[begin:end].tobytes().decode())
            words[first + n].append(int(count))
    assert terms == [r["terms"] for r in rows]
    assert sentences == [r["sentences"] for r in rows] and words == [r["words"] for r in rows]


def test_as_many_frequent_terms_as_allowed_are_looked_up_without_a_shuffle(spark):
    # No term holds a hundredth of all pairs, yet a hundred of them may stay where they are.
    idf = spark.range(1_000).select(F.format_string("t%d", "id").alias("term"), (F.col("id") % 500 + 1).alias("df"), F.lit(1.0).alias("idf"))
    near = summary._most_frequent(idf, 100)["term"].to_pylist()
    assert 50 < len(near) <= 100 and {"t499", "t999"} <= set(near)
    assert len(summary._most_frequent(idf, 1)) == 0 and len(summary._most_frequent(idf, 1_000)) == 1_000
