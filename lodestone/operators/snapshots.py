"""Chunks of documents as a table of snapshots.

A batch of documents is a delta: a folder with their chunks, and with the documents themselves, which stand for whatever
earlier deltas have of them (so a document without chunks is a tombstone). What there is, is named by a manifest, one small
file a version, and a version is published by giving its file its name, which fails if another writer was there first; then
the batch is put after that writer's. So a batch writes in proportion to itself, a failed one leaves no trace in any
snapshot, and readers keep the version that they began with. The first delta is the base: compaction writes a snapshot as a
new base, beside readers and writers.

The exchange of manifests needs a file system on which renaming never overwrites (HDFS and the like).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Deltas of a snapshot above which publish_chunks() compacts.
MOST_DELTAS = 32


class Conflict(RuntimeError):
    """Another writer has published what this one was to replace."""


@dataclass(frozen=True)
class Delta:
    name: str
    at: int  # the version that it came with; of a base, that of the last delta in it


@dataclass(frozen=True)
class Manifest:
    version: int
    deltas: tuple[Delta, ...]
    schema: str  # of chunks, as JSON
    added: str | None = None  # the delta of the batch that made this version, if it was a batch


class Folder:
    """The files of a table, by way of Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.files = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        where = self.at(folder)
        return [x.getPath().getName() for x in self.files.listStatus(where)] if self.files.exists(where) else []

    def modified(self, name: str) -> int:
        """Milliseconds."""
        return self.files.getFileStatus(self.at(name)).getModificationTime()

    def text(self, name: str) -> str:
        with_ = self.files.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(with_, "UTF-8")
        finally:
            with_.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file whole under a name that no file has; False if one has it."""
        temporary = self.at(f"log/.{uuid.uuid4().hex}")
        out = self.files.create(temporary)
        out.write(bytearray(text.encode()))
        out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at("").toUri(), self.conf)
        try:
            context.rename(temporary, self.at(name), how)
        except Py4JJavaError as error:
            self.files.delete(temporary, False)
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            return False
        return True

    def delete(self, name: str) -> None:
        self.files.delete(self.at(name), True)


def _log(version: int) -> str:
    return f"log/{version:012d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in Folder(spark, path).names("log") if n.endswith(".json") and n[0] != ".")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The manifest of a version, or of the last one; None if nothing was ever published."""
    known = versions(spark, path)
    if not known:
        return None
    if version is not None and version not in known:
        raise ValueError(f"there is no version {version}")
    found = json.loads(Folder(spark, path).text(_log(known[-1] if version is None else version)))
    return Manifest(found["version"], tuple(Delta(**d) for d in found["deltas"]), found["schema"], found["added"])


def _exchange(spark: SparkSession, path: str, new: Callable[[Manifest | None], Manifest]) -> int:
    """Publishes what new() makes of the last version, which it is asked again if another writer was there first."""
    folder = Folder(spark, path)
    while True:
        made = new(manifest(spark, path))
        if folder.create(_log(made.version), json.dumps(asdict(made))):
            return made.version


def publish(chunks: DataFrame, documents: DataFrame, path: str, expected: int | None = None) -> int:
    """Publishes the chunks (document_id, ordinal, ...) of documents (document_id, status) in place of what earlier versions
    have of these documents, and returns the version. A document that isn't ready, or has no chunks, has none afterwards;
    rows without a document_id are left out. expected: the version that must be the last (0: none); else Conflict."""
    spark, name = chunks.sparkSession, uuid.uuid4().hex
    ready = documents.filter("status = 'ready'").select("document_id").distinct()
    rows = chunks.join(ready, "document_id", "left_semi")
    rows.sortWithinPartitions("document_id", "ordinal").write.parquet(f"{path}/data/{name}/chunks")
    documents.filter("document_id IS NOT NULL").select("document_id").distinct().write.parquet(f"{path}/data/{name}/documents")

    def new(last: Manifest | None) -> Manifest:
        version = last.version if last else 0
        if expected is not None and version != expected:
            raise Conflict(f"version {version} is the last, not {expected}")
        before, schema = (last.deltas, StructType.fromJson(json.loads(last.schema))) if last else ((), StructType())
        known = {f.name for f in schema}
        schema = StructType([*schema, *(f for f in rows.schema if f.name not in known)])
        return Manifest(version + 1, (*before, Delta(name, version + 1)), schema.json(), name)

    return _exchange(spark, path, new)


def _name() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]+)/", 1)


def _documents(spark: SparkSession, path: str, deltas: tuple[Delta, ...]) -> DataFrame:
    """(document_id, at) of every document of some deltas, at: the last of them that has it."""
    at = F.create_map(*(F.lit(x) for d in deltas for x in (d.name, d.at)))
    rows = spark.read.parquet(*(f"{path}/data/{d.name}/documents" for d in deltas))
    return rows.select("document_id", at[_name()].alias("at")).groupBy("document_id").agg(F.max("at").alias("at"))


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All chunks of a version, or of the last one. What was published since the base is put in place of what that has; the
    documents of the base itself aren't shuffled for that, if the others are few."""
    now = manifest(spark, path, version)
    if now is None:
        raise ValueError(f"nothing was published at {path}")
    schema = StructType.fromJson(json.loads(now.schema))
    read = spark.read.schema(schema)
    base, later = now.deltas[0], now.deltas[1:]
    rows = read.parquet(f"{path}/data/{base.name}/chunks")
    if not later:
        return rows
    latest = _documents(spark, path, later)
    at = F.create_map(*(F.lit(x) for d in later for x in (d.name, d.at)))
    fresh = read.parquet(*(f"{path}/data/{d.name}/chunks" for d in later)).select("*", at[_name()].alias("at"))
    return rows.join(latest, "document_id", "left_anti").unionByName(fresh.join(latest, ["document_id", "at"], "left_semi").drop("at"))


def changes(spark: SparkSession, path: str, before: int, after: int) -> DataFrame:
    """What the batches between two versions did to the documents that were in them: document_id, n_before, n_after, and
    change: added, removed, replaced, same (the same chunks as before), or none (no chunks before or after)."""
    names = [m.added for v in range(before + 1, after + 1) if (m := manifest(spark, path, v)) and m.added]
    if not names:
        return snapshot(spark, path, after).select("document_id", F.lit(0).cast("long").alias("n_before"), F.lit(0).cast("long").alias("n_after"), F.lit("").alias("change")).filter(F.lit(False))
    touched = _documents(spark, path, tuple(Delta(n, 0) for n in names)).select("document_id")

    def counted(version: int, n: str, digest: str) -> DataFrame:
        rows = snapshot(spark, path, version).join(touched, "document_id", "left_semi")
        whole = F.md5(F.to_json(F.struct(*sorted(rows.columns))).cast("binary"))
        return rows.groupBy("document_id").agg(F.count("*").alias(n), F.md5(F.array_join(F.sort_array(F.collect_list(whole)), "").cast("binary")).alias(digest))

    both = touched.join(counted(before, "n_before", "was"), "document_id", "left").join(counted(after, "n_after", "is"), "document_id", "left")
    change = F.when(F.col("was").isNull() & F.col("is").isNull(), "none").when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") == F.col("is"), "same").otherwise("replaced")
    return both.select("document_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_before", "n_after")), change.alias("change"))


def compact(spark: SparkSession, path: str) -> int:
    """Writes the last snapshot as a new base, and publishes it in place of the deltas it was made of; batches that came
    meanwhile stay after it. Conflict, if another compaction did. Older versions stay as they are."""
    old, name = manifest(spark, path), uuid.uuid4().hex
    if old is None:
        raise ValueError(f"nothing was published at {path}")
    rows = snapshot(spark, path, old.version)
    rows.repartition("document_id").sortWithinPartitions("document_id", "ordinal").write.parquet(f"{path}/data/{name}/chunks")

    def new(last: Manifest | None) -> Manifest:
        if last is None or last.deltas[: len(old.deltas)] != old.deltas:
            raise Conflict("another compaction has replaced what this one was made of")
        return Manifest(last.version + 1, (Delta(name, old.deltas[-1].at), *last.deltas[len(old.deltas) :]), last.schema)

    return _exchange(spark, path, new)


def sweep(spark: SparkSession, path: str, keep: int = 2, older_than_ms: int = 86_400_000, now_ms: int | None = None) -> list[str]:
    """Marks what the last `keep` versions and the batches between them need, and removes other versions and deltas, if they
    are older than that (what is newer may be of a batch at work). Returns the names removed; a repeated sweep has none."""
    folder, known = Folder(spark, path), versions(spark, path)
    kept = [manifest(spark, path, v) for v in known[-keep:]]
    marked = {d.name for m in kept for d in m.deltas} | {m.added for m in kept if m.added}
    now = now_ms if now_ms is not None else spark._jvm.System.currentTimeMillis()
    gone = [_log(v) for v in known[:-keep] if now - folder.modified(_log(v)) >= older_than_ms]
    gone += [f"data/{n}" for n in folder.names("data") if n not in marked and now - folder.modified(f"data/{n}") >= older_than_ms]
    for name in gone:  # versions go before what they name
        folder.delete(name)
    return gone
