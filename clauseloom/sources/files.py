"""Document files as tables: listing, reading and text extraction."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import text as T
from clauseloom.sources.listing import list_folders

# Name and function of one way to get text out of a file's bytes.
Extractor = tuple[str, Callable[[bytes], str]]

LISTED_FORMATS = ("pdf", "docx", "txt")
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
TEXT_SCHEMA = "path string, filename string, text string, extractor_used string, error string"

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BREAKS = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}


def plain_text(content: bytes) -> str:
    """UTF-8 text."""
    return content.decode("utf-8")


def docx_text(content: bytes) -> str:
    """Body paragraphs of a word-processor document, one per line."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_WORD}body")
    lines = []
    for paragraph in [] if body is None else body.findall(f"{_WORD}p"):
        pieces = (node.text or "" if node.tag == f"{_WORD}t" else _BREAKS.get(node.tag, "") for node in paragraph.iter())
        lines.append("".join(pieces))
    return "\n".join(lines)


# PDF has no built-in extractor: pass one, for example {"pdf": [("mine", extract), ("fallback", other)]}.
BUILT_IN: dict[str, tuple[Extractor, ...]] = {"docx": (("docx", docx_text),), "txt": (("text", plain_text),)}


def file_glob(formats: Sequence[str] = LISTED_FORMATS, ignore_case: bool = True) -> str:
    """Glob for the given suffixes."""

    def letters(suffix: str) -> str:
        if not ignore_case:
            return suffix
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)

    return "*.{" + ",".join(letters(f) for f in formats) + "}"


def read_files(
    spark: SparkSession, folder: str, formats: Sequence[str] = LISTED_FORMATS, ignore_case: bool = True
) -> DataFrame:
    """Files of a folder (not of its subfolders) with their bytes.

    A missing folder is an error, an empty one an empty table. The source leaves files of zero bytes out; they are
    added from a listing made in tasks, so that they can be rejected like any other document without text.
    """
    glob = file_glob(formats, ignore_case)
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    try:
        files = reader.load(folder)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"folder {folder} not found") from error
        raise
    return files.unionByName(_empty_files(spark, folder, formats, ignore_case)).withColumn("filename", T.file_name("path"))


def _empty_files(spark: SparkSession, folder: str, formats: Sequence[str], ignore_case: bool) -> DataFrame:
    """Files of zero bytes of a folder, as the reader of whole files would give them."""
    suffix = T.file_extension("filename") if ignore_case else F.regexp_extract("filename", r"[^.]\.([^.]+)$", 1)
    wanted = [f.lower() if ignore_case else f for f in formats]
    empty = list_folders(spark, folder).filter((F.col("length") == 0) & suffix.isin(*wanted))
    return empty.select("path", "modificationTime", "length", F.lit(b"").alias("content"))


def other_files(spark: SparkSession, folder: str, formats: Sequence[str] = LISTED_FORMATS) -> DataFrame:
    """(path, filename) of a folder's files in other formats, empty ones too; no file is opened."""
    others = ~T.file_extension("filename").isin(*[f.lower() for f in formats])
    return list_folders(spark, folder).filter(others).select("path", "filename")


def list_files(
    spark: SparkSession, folder: str, formats: Sequence[str] = LISTED_FORMATS, ignore_case: bool = True
) -> DataFrame:
    """The same listing without the bytes, which are then not read."""
    return read_files(spark, folder, formats, ignore_case).select("path", "filename", "length", "modificationTime")


def extract_texts(files: DataFrame, extractors: Mapping[str, Sequence[Extractor]] | None = None) -> DataFrame:
    """Text of each file: (path, filename, text, extractor_used, error).

    The extractors of the file's lower-cased suffix are tried in order; one that raises hands over to the next, and
    an empty text is a result like any other. If all raise, the text is empty and ``error`` holds the messages.
    """
    table = {**BUILT_IN, **(extractors or {})}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, name, suffix, content in zip(frame["path"], frame["filename"], frame["suffix"], frame["content"]):
                text, used, errors = "", None, []
                if not len(content):
                    rows.append((path, name, "", None, "empty file"))
                    continue
                for label, extract in table.get(suffix, ()):
                    try:
                        text, used = extract(bytes(content)), label
                        break
                    except Exception as error:  # noqa: BLE001 - a broken file must not fail the job
                        errors.append(f"{label}: {type(error).__name__}: {error}")
                if used is None and not errors:
                    errors.append(f"no extractor for {suffix!r}")
                rows.append((path, name, text, used, None if used else "; ".join(errors)))
            yield pd.DataFrame(rows, columns=["path", "filename", "text", "extractor_used", "error"], dtype=object)

    with_suffix = files.withColumn("suffix", T.file_extension("filename"))
    return with_suffix.select("path", "filename", "suffix", "content").mapInPandas(run, TEXT_SCHEMA)


def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Plain-text files of a folder, each as one row (path, filename, text), read by Spark itself."""
    texts = (
        spark.read.option("pathGlobFilter", file_glob(["txt"]))
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )
    return texts.select("path", T.file_name("path").alias("filename"), "text")
