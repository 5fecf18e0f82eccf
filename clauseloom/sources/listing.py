"""Folder listings as a Python data source: each folder is a partition that a task lists, the driver never sees a file."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING_SCHEMA = "path string, filename string, length bigint, modificationTime timestamp"

# Hadoop's scheme names for filesystems that Arrow knows under another one.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def _filesystem(folder: str):
    """Arrow's filesystem for a qualified folder, and the folder's path in it."""
    from pyarrow import fs

    parts = urlsplit(folder)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), folder.removeprefix("file:")
    # Hadoop shows paths as they are, a URI has them escaped.
    uri = f"{_SCHEMES.get(parts.scheme, parts.scheme)}:{folder.split(':', 1)[1]}"
    found, path = fs.FileSystem.from_uri(uri.replace(" ", "%20"))
    return found, unquote(path)


class _Folder(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folders: list[str]) -> None:
        self.folders = folders

    def partitions(self) -> list[_Folder]:
        return [_Folder(path) for path in self.folders]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        from pyarrow import fs

        found, path = _filesystem(partition.path)
        for entry in found.get_file_info(fs.FileSelector(path)):
            # Like Spark's own sources, without hidden files and subfolders.
            if entry.type == fs.FileType.File and entry.base_name[0] not in "_.":
                changed = entry.mtime or datetime.fromtimestamp(0, timezone.utc)
                # To the millisecond, as Spark's own sources give it.
                changed = changed.replace(microsecond=changed.microsecond // 1_000 * 1_000)
                yield f"{partition.path.rstrip('/')}/{entry.base_name}", entry.base_name, entry.size, changed


class FolderListing(DataSource):
    """Files directly in some folders: option ``folders`` is a JSON list of their qualified paths."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return LISTING_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["folders"]))


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Qualified paths of the folders that a path or glob pattern names; raises FileNotFoundError if there are none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [str(status.getPath()) for status in system.globStatus(path) or [] if status.isDirectory()]
    if not found:
        raise FileNotFoundError(f"folder {pattern} not found")
    return found


def list_folders(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, filename, length, modificationTime) of the files directly in a folder, or in every folder of a pattern.

    Files of zero bytes are listed, hidden ones are not. No file is opened, and only folder names pass through the
    driver: a task lists each folder. An empty folder gives an empty table, a missing one is an error.
    """
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").option("folders", json.dumps(folders(spark, pattern))).load()
