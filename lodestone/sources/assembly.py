"""Files put together from parts, and the removal of files that nothing refers to.

Parts are sorted into one task an upload and written as they come, a part at a time, with a running digest, so that a task's
memory doesn't grow with the files. What isn't what was declared, or isn't of the format that its name says, is removed by
the task that wrote it; the rest gets its name when the job is committed, as in the sink of whole files.

Removal is by mark and sweep: the keys that are referred to are marked, and tasks list the folders of committed writes and
remove what is old and not marked. A file that is gone already is no error, so sweeps can be repeated, or run side by side.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from lodestone.operators.snapshots import Folder
from lodestone.session import new_path
from lodestone.sources.formats import docx_error
from lodestone.sources.sink import INDEX, INDEX_FIELDS, STEP, FilesWriter, Written


class AssembledFiles(DataSource):
    """Rows are (file_id, suffix, total_bytes, declared_sha256, offset_bytes, sent, content), those of a file together and in
    order of offset_bytes and sent."""

    @classmethod
    def name(cls) -> str:
        return "assembled_files"

    def writer(self, schema: StructType, overwrite: bool) -> AssembledWriter:
        if overwrite:
            raise ValueError("files are added, never overwritten")
        return AssembledWriter(self.options["path"].rstrip("/"), self.options["run"])


class Assembly:
    """One file that is being put together. Of the parts at one offset the last counts, so one is held back."""

    def __init__(self, files: fs.FileSystem, folder: str, suffix: str, total: int) -> None:
        self.files, self.temporary, self.suffix, self.total = files, f"{folder}/{uuid.uuid4().hex}.part", suffix, total
        self.out, self.digest, self.size = files.open_output_stream(self.temporary), hashlib.sha256(), 0
        self.text, self.begin, self.wrong = codecs.getincrementaldecoder("utf-8")(), b"", None
        self.held: tuple[int, pa.Buffer] | None = None

    def add(self, offset: int, content: pa.Buffer) -> None:
        if self.held is not None and self.held[0] != offset:
            self.put(*self.held)
        self.held = (offset, content)

    def put(self, offset: int, content: pa.Buffer) -> None:
        """Adds a part where the file ends; from a gap on, and beyond the size declared, nothing more is taken."""
        if offset != self.size or self.size + content.size > self.total:
            self.total = -1  # nothing joins on any more
            return
        view = memoryview(content)
        for at in range(0, len(view), STEP):
            piece = view[at : at + STEP]
            self.out.write(piece)
            self.digest.update(piece)
            if len(self.begin) < 5:
                self.begin += bytes(piece[: 5 - len(self.begin)])
            if self.suffix not in (".pdf", ".docx") and self.wrong != "binary data":
                self.decode(bytes(piece))
        self.size += len(view)

    def decode(self, piece: bytes, last: bool = False) -> None:
        if b"\x00" in piece:
            self.wrong = "binary data"
        elif self.wrong is None:
            try:
                self.text.decode(piece, last)
            except UnicodeDecodeError:
                self.wrong = "not UTF-8"

    def end(self, total: int, declared: str) -> str | None:
        """What is wrong with the whole file, if anything: other content, then its format."""
        if self.held is not None:
            self.put(*self.held)
        self.out.close()
        if self.size != total or self.digest.hexdigest() != declared:
            return "other content"
        if self.suffix == ".pdf":
            return None if self.begin == b"%PDF-" else "not a PDF"
        if self.suffix == ".docx":
            with self.files.open_input_file(self.temporary) as file:
                return docx_error(file)
        self.decode(b"", True)
        return self.wrong


class AssembledWriter(FilesWriter):
    def __init__(self, path: str, run: str) -> None:
        super().__init__(path, 0)
        self.run = run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = fs.FileSystem.from_uri(self.path)
        folder, rows, now, current = f"{root}/_temporary/{self.run}/{uuid.uuid4().hex}", [], None, None  # an attempt has a folder of its own
        for batch in iterator:
            heads = zip(*(batch[c].to_pylist() for c in ("file_id", "suffix", "total_bytes", "declared_sha256", "offset_bytes")), strict=True)
            for (*head, offset), content in zip(heads, batch["content"], strict=True):
                if now is None:
                    files.create_dir(folder, recursive=True)
                if now != head:
                    rows += [self.finish(files, folder, now, current)] if now else []
                    now, current = head, Assembly(files, folder, head[1], head[2])
                current.add(offset, content.as_buffer() or pa.py_buffer(b""))
        if now is None:
            return Written()
        rows.append(self.finish(files, folder, now, current))
        table = pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), INDEX_FIELDS, strict=True)], schema=INDEX_FIELDS)
        pq.write_table(table, f"{folder}/index.parquet", filesystem=files)
        return Written(PurePosixPath(folder).name)

    def finish(self, files: fs.FileSystem, folder: str, head: list, made: Assembly) -> tuple:
        """(file_id, storage_key, size_bytes, sha256, error) of a file, which is kept if there is no error."""
        file_id, _, total, declared = head
        if error := made.end(total, declared):
            files.delete_file(made.temporary)
            return file_id, None, made.size, made.digest.hexdigest(), error
        files.create_dir(f"{folder}/{declared[:2]}", recursive=True)
        files.move(made.temporary, f"{folder}/{declared[:2]}/{declared}")
        return file_id, f"{self.run}-{PurePosixPath(folder).name}/{declared[:2]}/{declared}", made.size, declared, None


def assemble(files: DataFrame, parts: DataFrame, path: str) -> DataFrame:
    """Puts files (file_id, a key, suffix, total_bytes, declared_sha256) together from parts (file_id, offset_bytes, sent, content)
    under a path, and returns file_id, storage_key, size_bytes, sha256 and error of those that have a part.

    Of parts with one offset the last sent counts, and of those sent at once the greater content. A file ends at its first
    gap, overlap, or part that goes beyond its size. Errors: other content (size or digest), then what is wrong with the
    format. A null content is empty; a part without an offset is none.
    """
    spark = files.sparkSession
    spark.dataSource.register(AssembledFiles)
    heads = files.select(F.col("file_id").cast("long").alias("file_id"), F.coalesce("suffix", F.lit("")).alias("suffix"), F.col("total_bytes").cast("long").alias("total_bytes"), F.lower("declared_sha256").alias("declared_sha256"))
    bodies = parts.filter("offset_bytes IS NOT NULL").select(F.col("file_id").cast("long").alias("file_id"), F.col("offset_bytes").cast("long").alias("offset_bytes"), "sent", F.coalesce("content", F.lit(b"")).alias("content"))
    ordered = heads.join(bodies, "file_id").repartition("file_id").sortWithinPartitions("file_id", "offset_bytes", "sent", "content")
    run = uuid.uuid4().hex
    ordered.write.format("assembled_files").mode("append").option("path", path).option("run", run).save()
    indexes = [f"{path}/files/{name}/index.parquet" for name in Folder(spark, path).names("files") if name.startswith(run)]
    return spark.read.schema(INDEX).parquet(*indexes) if indexes else spark.createDataFrame([], INDEX)


def hash_files(keys: DataFrame, path: str) -> DataFrame:
    """(storage_key, size_bytes, sha256) of the files under a path that have the keys (storage_key), each once, read by tasks
    a megabyte at a time; both are null where there is no such file. Nothing of the files passes the driver, not their
    names either."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(f"{path}/files")
        for batch in batches:
            found = []
            for key in batch["storage_key"].to_pylist():
                digest, size = hashlib.sha256(), 0
                try:
                    with files.open_input_stream(f"{root}/{key}") as file:
                        while piece := file.read(STEP):
                            digest.update(piece)
                            size += len(piece)
                except FileNotFoundError:
                    found.append((key, None, None))
                else:
                    found.append((key, size, digest.hexdigest()))
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["storage_key", "size_bytes", "sha256"])

    return keys.select("storage_key").filter("storage_key IS NOT NULL").distinct().mapInArrow(read, "storage_key string, size_bytes long, sha256 string")


def files_there(spark: SparkSession, path: str) -> DataFrame:
    """(storage_key, size_bytes, modified_at) of the files that are there, whether or not an index has them. The driver names
    the folders of committed tasks; what lies in them is listed by tasks."""
    return _listed(spark, path, "files", "[0-9a-f]{64}")


def _listed(spark: SparkSession, path: str, top: str, names: str) -> DataFrame:
    folders = spark.createDataFrame([(n,) for n in Folder(spark, path).names(top)], "folder string")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(f"{path}/{top}")
        for batch in batches:
            for folder in batch["folder"].to_pylist():
                found = files.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True, recursive=True))
                kept = [f for f in found if f.is_file and re.fullmatch(names, f.base_name)]
                keys = pa.array([f.path.removeprefix(f"{root}/") for f in kept], pa.string())
                when = pa.array([f.mtime_ns // 1000 for f in kept], pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([keys, pa.array([f.size for f in kept], pa.int64()), when], names=["storage_key", "size_bytes", "modified_at"])

    return folders.repartition(spark.sparkContext.defaultParallelism, "folder").mapInArrow(look, "storage_key string, size_bytes long, modified_at timestamp")


def sweep_files(spark: SparkSession, path: str, marked: DataFrame, before: datetime, lost_before: datetime | None = None) -> DataFrame:
    """Removes the files under a path that no row of marked (storage_key) has and that were last written before a time, and
    returns what was removed: storage_key, size_bytes.

    With lost_before, what writes that never ended left behind goes too, if it was written before that time; let it be
    longer ago than any write takes. Indexes stay, as what was once stored; a null key marks nothing.
    """
    old = lambda rows, time: rows.filter(F.col("modified_at") < F.lit(time))
    gone = old(files_there(spark, path), before).join(marked.select("storage_key").distinct(), "storage_key", "left_anti")
    rows = gone.select("storage_key", "size_bytes", F.lit("files").alias("top"))
    if lost_before is not None:
        lost = old(_listed(spark, path, "_temporary", ".*"), lost_before)
        rows = rows.unionByName(lost.select("storage_key", "size_bytes", F.lit("_temporary").alias("top")))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for key, top in zip(batch["storage_key"].to_pylist(), batch["top"].to_pylist(), strict=True):
                try:
                    files.delete_file(f"{root}/{top}/{key}")
                except FileNotFoundError:
                    pass  # another sweep, or an attempt before this one, was first
            yield batch.select(["storage_key", "size_bytes"])

    # What is to go is stored before anything goes: a stage that is repeated finds the same files.
    listed = new_path(spark, "sweep")
    rows.write.parquet(listed)
    plan = spark.read.schema("storage_key string, size_bytes long, top string").parquet(listed)
    done = new_path(spark, "swept")
    plan.mapInArrow(remove, "storage_key string, size_bytes long").write.parquet(done)
    return spark.read.schema("storage_key string, size_bytes long").parquet(done)
