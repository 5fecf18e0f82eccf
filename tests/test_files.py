"""File sources and result sinks, with files in a temporary folder."""

import csv
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from clauseloom.operators import metrics
from clauseloom.sources import files, listing, results
from clauseloom.sources.stages import save_stage, stage, stage_by_key

_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx_bytes(*paragraphs: str) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    xml = f'<w:document xmlns:w="{_NS}"><w:body>{body}{table}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", xml)
    return out.getvalue()


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"pdf a")
    (tmp_path / "b.pdf").write_bytes(b"pdf b")
    (tmp_path / "c.docx").write_bytes(docx_bytes("First.", "Second &amp; last."))
    (tmp_path / "broken.docx").write_bytes(b"not a zip")
    (tmp_path / "d.txt").write_bytes("Text ü\nline".encode())
    (tmp_path / "zero.pdf").write_bytes(b"")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.pdf").write_bytes(b"pdf e")
    return tmp_path


def names(frame):
    return sorted(r["filename"] for r in frame.select("filename").collect())


def test_listing_skips_subfolders_and_other_suffixes(spark, folder):
    (folder / "f.odt").write_bytes(b"x")
    assert names(files.list_files(spark, str(folder))) == ["a.PDF", "b.pdf", "broken.docx", "c.docx", "d.txt", "zero.pdf"]
    assert names(files.other_files(spark, str(folder))) == ["f.odt"]
    assert names(files.list_files(spark, str(folder), ["pdf"], ignore_case=False)) == ["b.pdf", "zero.pdf"]
    assert names(files.list_files(spark, str(folder), ["txt"])) == ["d.txt"]


def test_listing_does_not_read_contents(spark, folder):
    plan = files.list_files(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema: ")[1].split("\n")[0]
    counts = {r["extension"]: r["files"] for r in metrics.extension_counts(files.list_files(spark, str(folder))).collect()}
    assert counts == {"pdf": 3, "docx": 2, "txt": 1}


def test_missing_folder_is_an_error_and_empty_folder_is_empty(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_files(spark, str(tmp_path / "nowhere"))
    assert files.read_files(spark, str(tmp_path)).count() == 0
    assert files.extract_texts(files.read_files(spark, str(tmp_path))).count() == 0


def test_extractors_fall_back_on_errors_only(spark, folder):
    def picky(content):
        if content.endswith(b"a"):
            raise ValueError("cannot read")
        return ""

    pdf = {"pdf": [("first", picky), ("second", lambda content: content.decode().upper())]}
    rows = {r["filename"]: r for r in files.extract_texts(files.read_files(spark, str(folder)), pdf).collect()}
    assert (rows["a.PDF"]["text"], rows["a.PDF"]["extractor_used"], rows["a.PDF"]["error"]) == ("PDF A", "second", None)
    # An empty text is not a failure, so there is no fallback.
    assert (rows["b.pdf"]["text"], rows["b.pdf"]["extractor_used"]) == ("", "first")
    assert rows["c.docx"]["text"] == "First.\nSecond & last."
    assert rows["broken.docx"]["text"] == "" and "BadZipFile" in rows["broken.docx"]["error"]


def test_suffix_without_extractor_is_reported(spark, folder):
    row = files.extract_texts(files.read_files(spark, str(folder), ["pdf"])).first()
    assert row["text"] == "" and row["error"] == "no extractor for 'pdf'"


def test_plain_text_both_ways(spark, folder):
    whole = files.read_text_files(spark, str(folder)).first()
    extracted = files.extract_texts(files.read_files(spark, str(folder), ["txt"])).first()
    assert whole["text"] == extracted["text"] == "Text ü\nline"
    assert whole["filename"] == "d.txt"


@pytest.fixture()
def result_frame(spark):
    texts = ['He said "no",\nthen left.', "back\\slash ü 🙂", "", None]
    contracts = spark.createDataFrame(
        [(f"c{i}", f"c{i}.pdf", "word " * (200 if i == 0 else 5)) for i in range(4)],
        "contract_id string, filename string, text string",
    )
    wide = spark.createDataFrame(
        [(f"c{i}", t, t, t, t) for i, t in enumerate(texts)],
        "contract_id string, summary string, termination_clause string, confidentiality_clause string, liability_clause string",
    )
    return results.result_rows(contracts, wide)


def test_csv_round_trip(spark, tmp_path, result_frame):
    path = str(tmp_path / "csv")
    results.write_csv(result_frame, path)
    back = {r["contract_id"]: r for r in results.read_csv(spark, path).collect()}
    for r in result_frame.collect():
        assert (back[r["contract_id"]]["summary"] or "") == (r["summary"] or "")
        assert back[r["contract_id"]]["text_length"] == r["text_length"]
    plain = {}
    for part in (tmp_path / "csv").glob("*.csv"):
        with open(part, newline="", encoding="utf-8") as f:
            for row in csv.DictReader(f):
                assert list(row) == list(results.CSV_COLUMNS)
                plain[row["contract_id"]] = row["summary"]
    assert plain == {"c0": 'He said "no",\nthen left.', "c1": "back\\slash ü 🙂", "c2": "", "c3": ""}


def test_json_round_trip(spark, tmp_path, result_frame):
    path = str(tmp_path / "json")
    results.write_json(result_frame, path)
    raw = [json.loads(line) for part in (tmp_path / "json").glob("*.json") for line in open(part, encoding="utf-8")]
    first = next(r for r in raw if r["contract_id"] == "c0")
    assert first["full_text"].endswith("...") and len(first["full_text"]) == 503
    assert first["metadata"]["word_count"] == 200
    assert next(r for r in raw if r["contract_id"] == "c3")["summary"] is None
    assert any("ü 🙂" in line for part in (tmp_path / "json").glob("*.json") for line in open(part, encoding="utf-8"))
    back = results.read_json(spark, path)
    assert back.select("contract_id", "summary").exceptAll(result_frame.select("contract_id", "summary")).isEmpty()
    assert back.filter("metadata.processed_at is null").isEmpty()


def test_optional_json_columns_and_array_files(spark, tmp_path, result_frame):
    path = str(tmp_path / "slim")
    results.write_json(result_frame, path, full_text=False, metadata=False)
    line = next(open(p, encoding="utf-8").readline() for p in (tmp_path / "slim").glob("*.json"))
    assert list(json.loads(line)) == list(results.CSV_COLUMNS)
    array = tmp_path / "array.json"
    array.write_text(json.dumps([{"contract_id": "x", "word_count": 3, "metadata": {"text_length": 9}}], indent=2))
    row = results.read_json(spark, str(array), array_file=True).first()
    assert (row["contract_id"], row["word_count"], row["metadata"]["text_length"]) == ("x", 3, 9)


def test_stage_cuts_lineage_and_can_be_partitioned(spark, tmp_path):
    frame = spark.range(10).select("id", (F.col("id") % 2).cast("string").alias("kind"))
    stored = save_stage(frame, str(tmp_path / "stage"), "kind")
    assert stored.filter("kind = '1'").count() == 5
    assert sorted(p.name for p in (tmp_path / "stage").glob("kind=*")) == ["kind=0", "kind=1"]
    again = stage(frame, "numbers")
    assert again.count() == 10 and "Range" not in again._jdf.queryExecution().toString()


def test_empty_files_in_other_formats_are_listed(spark, tmp_path):
    for name, content in (("a.txt", b"x"), ("b.txt", b""), ("c.odt", b""), ("d.odt", b"x"), ("_SUCCESS", b""), ("none", b"")):
        (tmp_path / name).write_bytes(content)
    (tmp_path / "folder.odt").mkdir()
    assert sorted(r.filename for r in files.other_files(spark, str(tmp_path)).collect()) == ["c.odt", "d.odt", "none"]


def test_folders_are_listed_by_tasks(spark, tmp_path):
    for name in ("one", "two", "none"):
        (tmp_path / name).mkdir()
    (tmp_path / "one" / "a b%20ü.txt").write_bytes(b"four")
    (tmp_path / "one" / ".hidden").write_bytes(b"x")
    (tmp_path / "one" / "sub").mkdir()
    (tmp_path / "two" / "b").write_bytes(b"")
    found = listing.list_folders(spark, f"{tmp_path}/*")
    assert found.rdd.getNumPartitions() == 3
    assert sorted((r.filename, r.length) for r in found.collect()) == [("a b%20ü.txt", 4), ("b", 0)]
    read = {r.path: r.modificationTime for r in spark.read.format("binaryFile").load(f"{tmp_path}/one").collect()}
    assert {r.path: r.modificationTime for r in found.filter("length > 0").collect()} == read
    assert listing.list_folders(spark, f"{tmp_path}/none").isEmpty()
    with pytest.raises(FileNotFoundError):
        listing.list_folders(spark, f"{tmp_path}/nowhere")
    with pytest.raises(FileNotFoundError):
        files.other_files(spark, f"{tmp_path}/nowhere")


def test_a_stage_laid_out_by_key_needs_no_exchange(spark):
    rows = spark.range(100).select((F.col("id") % 7).cast("string").alias("k"), "id")
    stored = stage_by_key(rows, "by-key", "k", buckets=4)
    grouped = stored.groupBy("k").count()
    assert {r["k"]: r["count"] for r in grouped.collect()} == {str(k): 15 if k < 2 else 14 for k in range(7)}
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    assert len(stored.inputFiles()) <= 4
