"""Helpers that the operators of this subpackage share: shared scratch tables, batches balanced by bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own for a session
    whose driver and executors are one process (tests); on a cluster that is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows, unless the session has its own number: rows are whole texts here, and a Python
    worker keeps the memory that its largest batch took. Frames are run when their reader likes, so the setting stays."""
    if spark.conf.get(ROWS_A_BATCH) == "10000":
        spark.conf.set(ROWS_A_BATCH, "1000")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/brookmart/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, and a lost executor costs a re-read only."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that saved() wrote and that no frame reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables that an operator writes on its way; discard() deletes all but those that its result still reads."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def saved(self, df: DataFrame, tag: str) -> DataFrame:
        self.tables.append(saved(df, tag))
        return self.tables[-1]

    def discard(self, *keep: DataFrame) -> None:
        discard(*(x for x in self.tables if all(x is not k for k in keep)))
        self.tables = list(keep)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names that do not clash with the columns taken."""
    out = []
    for name in names:
        while name in taken or name in out:
            name = f"_{name}"
        out.append(name)
    return out


def text_views(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each text begins and ends (nulls are empty), without copies."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each (one longer text makes a slice of its own)."""
    _, at = text_views(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(at, at[begin] + most, side="right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end
