"""A sink for whole files, as a data source: format("stored_files").

Each task writes its files under temporary names, a megabyte at a time with a running digest and a limit of size, and an
index of them; a file that is too long or empty is removed at once, and the index says so. Files get their names when the
job is committed: the task's folder is renamed, so that a committed write has all its files and an aborted or lost one has
none that can be seen. A file lies under the digest of its content; equal files of a task are one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lodestone.config import DEFAULTS
from lodestone.functions.text import safe_name, suffix
from lodestone.operators.snapshots import Folder
from lodestone.sources.formats import media_type, sniff

STEP = 1 << 20
INDEX = "file_id long, storage_key string, size_bytes long, sha256 string, error string"
INDEX_FIELDS = pa.schema([("file_id", pa.int64()), ("storage_key", pa.string()), ("size_bytes", pa.int64()), ("sha256", pa.string()), ("error", pa.string())])


@dataclass
class Written(WriterCommitMessage):
    """A task's folder of temporary files; none if it had no rows."""

    folder: str | None = None


class StoredFiles(DataSource):
    """Rows are (file_id, content). Options: path, and max_bytes, above which a file isn't kept."""

    @classmethod
    def name(cls) -> str:
        return "stored_files"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if overwrite:
            raise ValueError("files are added, never overwritten")
        return FilesWriter(self.options["path"].rstrip("/"), int(self.options["max_bytes"]))


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, max_bytes: int) -> None:
        self.path, self.max_bytes, self.run = path, max_bytes, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = fs.FileSystem.from_uri(self.path)
        folder, rows = f"{root}/_temporary/{self.run}/{uuid.uuid4().hex}", []  # an attempt has a folder of its own
        for batch in iterator:
            for file_id, content in zip(batch["file_id"].to_pylist(), batch["content"], strict=True):
                if not rows:
                    files.create_dir(folder, recursive=True)
                rows.append((file_id, *self.put(files, folder, memoryview(content.as_buffer() or b""))))
        if not rows:
            return Written()
        table = pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), INDEX_FIELDS, strict=True)], schema=INDEX_FIELDS)
        pq.write_table(table, f"{folder}/index.parquet", filesystem=files)
        return Written(PurePosixPath(folder).name)

    def put(self, files: fs.FileSystem, folder: str, content: memoryview) -> tuple:
        """(storage_key, size_bytes, sha256, error) of a file, which is kept if there is no error."""
        temporary, digest, size = f"{folder}/{uuid.uuid4().hex}.part", hashlib.sha256(), 0
        with files.open_output_stream(temporary) as out:
            for at in range(0, len(content), STEP):
                piece = content[at : at + STEP]
                size += len(piece)
                if size > self.max_bytes:
                    break
                digest.update(piece)
                out.write(piece)
        error = "too large" if size > self.max_bytes else None if size else "empty"
        if error:
            files.delete_file(temporary)
            return None, None, None, error
        name = digest.hexdigest()
        files.create_dir(f"{folder}/{name[:2]}", recursive=True)
        files.move(temporary, f"{folder}/{name[:2]}/{name}")
        return f"{self.run}-{PurePosixPath(folder).name}/{name[:2]}/{name}", size, name, None

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """One rename a task."""
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(f"{root}/files", recursive=True)
        for message in messages:
            if message is not None and message.folder:
                files.move(f"{root}/_temporary/{self.run}/{message.folder}", f"{root}/files/{self.run}-{message.folder}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Removes what is left of this write, that of lost attempts too."""
        files, root = fs.FileSystem.from_uri(self.path)
        left = f"{root}/_temporary/{self.run}"
        if files.get_file_info(left).type != fs.FileType.NotFound:
            files.delete_dir(left)


def store_files(uploads: DataFrame, path: str, max_bytes: int = DEFAULTS.max_upload_bytes) -> DataFrame:
    """Stores the files of uploads (file_id, name, content) at a path, and returns what became of them: file_id,
    original_name, media_type, storage_key, size_bytes, sha256 and error. Errors in order of precedence: suffix (not
    allowed), too large, empty, then what is wrong with the format; files with one are not kept. A null content is empty."""
    spark = uploads.sparkSession
    spark.dataSource.register(StoredFiles)
    named = uploads.select(F.col("file_id").cast("long").alias("file_id"), safe_name(F.col("name")).alias("original_name"), "content", suffix(F.col("name")).alias("suffix"))
    sized = F.coalesce(F.octet_length("content"), F.lit(0)).between(1, max_bytes)
    kind = media_type(F.col("suffix"))
    rows = sniff(named).withColumns({"media_type": kind, "wrong": F.when(kind.isNull(), "suffix").when(sized, F.col("format_error"))})
    good = rows.filter("wrong IS NULL").select("file_id", F.coalesce("content", F.lit(b"")).alias("content"))
    good.write.format("stored_files").mode("append").option("path", path).option("max_bytes", max_bytes).save()
    found = stored_files(spark, path).withColumnRenamed("error", "refused")
    out = rows.select("file_id", "original_name", "media_type", "wrong").join(found, "file_id", "left")
    return out.select("file_id", "original_name", "media_type", "storage_key", "size_bytes", "sha256", F.coalesce("wrong", "refused").alias("error"))


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """The index of all committed writes. The driver names the folders of committed tasks, not their files."""
    indexes = [f"{path}/files/{name}/index.parquet" for name in Folder(spark, path).names("files")]
    return spark.read.schema(INDEX).parquet(*indexes) if indexes else spark.createDataFrame([], INDEX)


def stored_content(spark: SparkSession, path: str) -> DataFrame:
    """(storage_key, content) of all files that are there, read by tasks, which go by the index: nothing of the files passes
    the driver, not their names either."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(f"{path}/files")
        for batch in batches:
            found: list[tuple[str, bytes]] = []
            for key in batch["storage_key"].to_pylist():
                try:
                    with files.open_input_stream(f"{root}/{key}") as file:
                        found.append((key, file.read()))
                except FileNotFoundError:
                    continue
                if len(found) == 256 or sum(len(content) for _, content in found) > STEP:
                    yield contents(found)
                    found = []
            yield contents(found)

    def contents(found: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([c for _, c in found], pa.binary())], names=["storage_key", "content"])

    keys = stored_files(spark, path).select("storage_key").filter("storage_key IS NOT NULL")
    dealt = keys.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "storage_key").distinct()
    return dealt.mapInArrow(read, "storage_key string, content binary")
