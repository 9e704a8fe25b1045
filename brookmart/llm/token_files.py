"""Token-ID files: Parquet list columns with dictionary encoding, bounded row groups, page indexes and selective reads."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import by_bytes, small_batches, text_views
from .wordcodec import codec

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", files: int | None = None, row_group_mb: int = 16, page_rows: int = 512) -> None:
    """Writes the ids of every whole text, with end_id after each, in ascending order of the key.

    File i of the folder holds the i-th range of keys. A row has doc_id, part (its file's number), part_start (ids of
    the rows before it in the file), n_tokens (with the end id) and ids. The writer dictionary-encodes ids (a vocabulary
    fits in one dictionary page), ends row groups at row_group_mb and pages at page_rows rows, and adds column and
    offset indexes, so readers fetch single columns, row groups or pages. Null texts are empty; null keys come first;
    rows with equal keys stay, in a file ordered by a hash of their text; an empty table makes an empty folder of files.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # A much repeated key is several files; a random number tells where it is cut without a look at the texts.
    rows = rows.repartitionByRange(n, "doc_id", F.rand(7)).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encode(batches):
        model, part, before = codec(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in by_bytes(whole, "text", 1 << 22):
                body, at = text_views(batch.column("text"))
                raw = body.tobytes()
                counts, ids = model.encode([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], end_id)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.full(len(counts), part, np.int32)), pa.array(before + ends - counts), pa.array(counts), lists],
                    ["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                before += int(ends[-1])

    (
        rows.mapInArrow(encode, SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.dictionary.page.size", str(1 << 20))
        .option("parquet.block.size", str(row_group_mb << 20))
        .option("parquet.page.row.count.limit", str(page_rows))
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, columns: Sequence[str] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """The chosen columns of such files; without ids only metadata pages are read. Filters on doc_id prune row groups and pages."""
    return spark.read.schema(SCHEMA).parquet(path).select(*columns)


def with_start(spark: SparkSession, path: str, columns: Sequence[str] = ("doc_id", "n_tokens")) -> DataFrame:
    """The chosen columns and start: the ids of all rows before a row in the files' order, from metadata columns only."""
    totals = read_tokens(spark, path, ["part", "n_tokens"]).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))  # a row a file
    rows = read_tokens(spark, path, ["part", "part_start", *columns])
    few = len(rows.inputFiles()) <= 1_000_000  # base has a row of two numbers for each file
    return rows.join(F.broadcast(base) if few else base, "part").select(*columns, (F.col("base") + F.col("part_start")).alias("start"))


def ids_crc32(rows: DataFrame) -> DataFrame:
    """Replaces the list column ids by ids_crc32, the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    import zlib

    rest = [x for x in rows.columns if x != "ids"]

    def digest(batches):
        for batch in batches:
            lists = batch.column("ids")
            at = lists.offsets.to_numpy()
            values = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in rest), pa.array(crc, pa.int64())], [*rest, "ids_crc32"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*rest).schema)
    return rows.select(*rest, "ids").mapInArrow(digest, f"{kinds}, ids_crc32 long")
