"""Helpers that several of the training-data operators use."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import new_path

#: Words are runs of anything but the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes of text that one vectorised step works on at most (a longer text makes a step of its own).
STEP_BYTES = 1 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_training_row(doc_id: Column) -> Column:
    """False for the fifth of the documents that is held out: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(True))


def unused(columns: list[str], name: str) -> str:
    """The name, or one like it, that none of the columns has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def beside(columns: list[str], *own: str) -> list[str]:
    """The columns whose names, in any case, are none of our own: Spark tells names apart without regard to case."""
    taken = {c.lower() for c in own}
    return [c for c in columns if c.lower() not in taken]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.Table]:
    """The batches cut into runs of rows with at most `limit` bytes of text, so that memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield pa.Table.from_batches([batch.slice(at, row - at)])
                at, held = row, 0
            held += size
        yield pa.Table.from_batches([batch.slice(at)])
        pa.default_memory_pool().release_unused()  # a worker process lives on for other tasks
