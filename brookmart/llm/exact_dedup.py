"""Exact dedup by an extendible-hash index on shared files.

A directory of 2^depth entries leads from the leading bits of a text's hash to a bucket. A bucket that holds more bytes
than the capacity is split by one more bit, and the directory is doubled when the bucket was as deep as the directory. The
buckets of a range of hashes belong to one owner task, which reads its records in the order of their hashes, chains texts
that share a hash, and compares bytes along the chain. An index has one entry for each distinct text, with its bytes and
the keys of its rows; more documents can be inserted later, which rewrites the buckets that they fall in and no others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_bytes, discard, saved, scratch, small_batches

#: Bytes of a bucket (more where the directory would pass 2^DEEPEST entries), of texts that a map task compares at a time.
CAPACITY, PART = 1 << 22, 1 << 22
#: Bits of the largest directory; it is held by the driver and sent to the tasks (4 bytes an entry).
DEEPEST = 16
#: Rows of one hash, or a 100,000th of all rows, beyond which its rows are chained in several tasks first.
HOT = 2048
#: Owner tasks are as many as buckets up to here.
MOST_TASKS = 20_000
ENTRY = "bucket int, h long, salt int, link int, hot boolean, sha string, text binary, ids array<long>, keep long, copies long"


def normal(text: Column) -> Column:
    """Each run of space and \\x09-\\x0D as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


class Directory:
    """The buckets of an index, ascending by the hashes that they hold: prefix and depth (leading bits) of each, and the
    generation of files that has its entries (-1: none yet)."""

    def __init__(self, buckets: list[tuple[int, int, int]]):
        self.buckets = sorted(buckets, key=lambda b: b[0] << (63 - b[1]))
        self.depth = max(d for _, d, _ in self.buckets)
        self.slots = np.zeros(1 << self.depth, np.int32)
        for i, (prefix, depth, _) in enumerate(self.buckets):
            self.slots[prefix << (self.depth - depth) : (prefix + 1) << (self.depth - depth)] = i

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The bucket of each hash."""
        return self.slots[(hashes.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)] if self.depth else np.zeros(len(hashes), np.int32)

    def grown(self, held: np.ndarray, capacity: int) -> Directory:
        """Splits overfull buckets, and again what they are split into; the directory doubles where one was as deep as it.
        held: bytes by the leading bits of the hashes; what these don't tell apart is not split."""
        bits = len(held).bit_length() - 1
        total, full = (np.concatenate([[0], np.cumsum(x)]) for x in (held, held > 0))
        left, done = list(self.buckets), []
        while left:
            prefix, depth, generation = left.pop()
            begin, end = prefix << (bits - depth), (prefix + 1) << (bits - depth)
            if total[end] - total[begin] <= capacity or full[end] - full[begin] < 2:
                done.append((prefix, depth, generation))
            else:
                left += [(2 * prefix, depth + 1, generation), (2 * prefix + 1, depth + 1, generation)]
        return Directory(done)


def least(keys: list) -> int | None:
    return min((k for k in keys if k is not None), default=None)


def chains(batches: Iterator[pa.RecordBatch], members: Callable[[dict], list], *keys: str) -> Iterator[tuple[tuple, list[tuple[bytes, dict, list]]]]:
    """The distinct texts of rows with the same keys, which follow one another: text, the first row with it, and the members
    that all its rows bring. What is held is one row a text and the members, not the rows."""
    at, found = None, []
    for whole in batches:
        for batch in by_bytes(whole, "text", PART):
            for row in batch.to_pylist():
                here, more, text = tuple(row[k] for k in keys), members(row), row["text"]
                if found and here != at:
                    yield at, found
                    found = []
                at = here
                same = next((held for body, _, held in found if body == text), None)
                if same is None:
                    found.append((text, row, list(more)))
                else:
                    same.extend(more)
    if found:
        yield at, found


class ExactIndex:
    """An index in a folder that driver and executors share. One insert runs at a time; what it wrote counts once its
    directory is there, so an insert that fails leaves the index as it was."""

    def __init__(self, spark: SparkSession, path: str, capacity: int = CAPACITY):
        self.spark, self.path, self.capacity = spark, path.rstrip("/"), capacity
        self.fs, self.of = (p := spark._jvm.org.apache.hadoop.fs.Path)(self.path).getFileSystem(spark._jsc.hadoopConfiguration()), p

    def generation(self) -> int:
        """The number of the last complete insert; -1 for an empty index."""
        if not self.fs.exists(self.of(self.path)):
            return -1
        names = [x.getPath().getName() for x in self.fs.listStatus(self.of(self.path))]
        return max((int(n[10:]) for n in names if n.startswith("directory-") and self.fs.exists(self.of(f"{self.path}/{n}/_SUCCESS"))), default=-1)

    def directory(self) -> Directory:
        n = self.generation()
        if n < 0:
            return Directory([(0, 0, -1)])
        return Directory([tuple(r) for r in self.spark.read.parquet(f"{self.path}/directory-{n}").collect()])  # 2^DEEPEST at most

    def entries(self, directory: Directory | None = None, among: set[int] | None = None) -> DataFrame:
        """The entries of all buckets of the directory, or of some; a bucket's files are those of its generation."""
        directory = directory or self.directory()
        generations = {g for _, _, g in directory.buckets}
        if among is None and len(generations) == 1 and -1 not in generations:
            paths = [f"{self.path}/entries-{g}" for g in generations]
        else:
            paths = [f"{self.path}/entries-{g}/prefix={d}_{p}" for i, (p, d, g) in enumerate(directory.buckets) if g >= 0 and (among is None or i in among)]
            paths = [x for x in paths if self.fs.exists(self.of(x))]  # a bucket may be empty
        return self.spark.read.schema(ENTRY).parquet(*paths).select(*T.StructType.fromDDL(ENTRY).names) if paths else self.spark.createDataFrame([], ENTRY)

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Adds documents; their rows are found in the entries afterwards. Buckets without new rows keep their files."""
        small_batches(self.spark)
        old, number = self.directory(), self.generation() + 1
        rows = docs.select(F.col(key).cast("long").alias("id"), normal(F.col(text)).alias("text")).withColumn("h", text_hash(F.col("text")))
        byh = saved(rows.groupBy("h").agg(F.count("*").alias("n"), (F.max(F.octet_length("text")) + 16 + 8 * F.count("*")).alias("bytes")), "hashes")
        cell = F.shiftrightunsigned("h", 64 - DEEPEST).alias("cell")
        held = np.zeros(1 << DEEPEST, np.int64)

        def hold(sizes: DataFrame) -> None:
            for r in sizes.groupBy(cell).agg(F.sum("bytes").alias("bytes")).collect():  # 2^DEEPEST at most
                held[r.cell] += r.bytes

        hold(byh)
        touched = {int(i) for i in old.find((np.flatnonzero(held).astype(np.uint64) << np.uint64(64 - DEEPEST)).view(np.int64))}
        before = self.entries(old, touched)
        hold(before.select("h", (F.octet_length("text") + 16 + 8 * F.size("ids").cast("long")).alias("bytes")))
        # What nothing falls in counts nothing here, so it is not split and keeps its files.
        keep = {old.buckets[i][:2] for i in range(len(old.buckets)) if i not in touched}
        grown = old.grown(held, max(self.capacity, int(held.sum()) >> (DEEPEST - 2)))
        directory = Directory([(p, d, g if (p, d) in keep else number) for p, d, g in grown.buckets])
        hot_from = max(HOT, (byh.agg(F.sum("n")).first()[0] or 0) // 100_000)
        hot = {r.h: -(-r.n // hot_from) for r in byh.filter(F.col("n") > hot_from).collect()}  # 100,000 at most
        owners = max(1, min(len(directory.buckets), MOST_TASKS))
        n_buckets, labels = len(directory.buckets), [f"{d}_{p}" for p, d, _ in directory.buckets]

        def record(bucket: int, h: int, salt: int, sha: str, body: bytes, ids: list) -> tuple:
            owner = hash((h, salt)) % owners if h in hot else bucket * owners // n_buckets
            return owner, bucket, h, salt, h in hot, sha, body, ids

        names = ["owner", "bucket", "h", "salt", "hot", "sha", "text", "ids"]
        schema = "owner int, bucket int, h long, salt int, hot boolean, sha string, text binary, ids array<long>"
        arrow = pa.schema([("owner", pa.int32()), ("bucket", pa.int32()), ("h", pa.int64()), ("salt", pa.int32()), ("hot", pa.bool_()), ("sha", pa.string()), ("text", pa.binary()), ("ids", pa.list_(pa.int64()))])

        def to_batch(records: list[tuple], as_: pa.Schema = arrow) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*records, strict=True) if records else [[]] * len(as_), as_, strict=True)], schema=as_)

        def combine(batches):
            """Equal texts of a part of a batch as one record. All of a task's records of a hot hash have one salt, so a task that
            runs again sends its rows where it sent them before, in whatever order they come."""
            task = TaskContext.get().partitionId() * 0x9E3779B1
            for whole in batches:
                for batch in by_bytes(whole, "text", PART):
                    hashes = batch.column("h").to_numpy()
                    buckets, found = directory.find(hashes), {}
                    for i, (h, sha, body, id_) in enumerate(zip(hashes.tolist(), batch.column("sha").to_pylist(), batch.column("text").to_pylist(), batch.column("id").to_pylist(), strict=True)):
                        found.setdefault((h, body), (int(buckets[i]), sha, []))[2].append(id_)
                    yield to_batch([record(bucket, h, task % hot[h] if h in hot else 0, sha, body.encode(), ids) for (h, body), (bucket, sha, ids) in found.items()])

        def again(batches):
            """Entries that are there as records."""
            for batch in batches:
                buckets = directory.find(batch.column("h").to_numpy())
                yield to_batch([record(int(b), r["h"], r["salt"] % hot[r["h"]] if r["h"] in hot else 0, r["sha"], r["text"], r["ids"]) for b, r in zip(buckets, batch.to_pylist(), strict=True)])

        kinds = {"prefix": pa.string(), "link": pa.int32(), "keep": pa.int64(), "copies": pa.int64()}
        out = pa.schema([(f, kinds.get(f) or arrow.field(f).type) for f in ("prefix", *T.StructType.fromDDL(ENTRY).names)])

        def own(batches):
            """An owner's buckets: the chain of each hash, a row for each of its texts."""
            ready, size = [], 0
            for (bucket, h, salt), found in chains(batches, lambda r: r.pop("ids"), "bucket", "h", "salt"):
                for link, (body, r, ids) in enumerate(found):
                    ready.append((labels[bucket], bucket, h, salt, link, r["hot"], r["sha"], body, ids, least(ids), len(ids)))
                    size += len(body) + 8 * len(ids) + 100
                    if size > PART:
                        yield to_batch(ready, out)
                        ready, size = [], 0
            if ready:
                yield to_batch(ready, out)

        records = rows.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).select("id", "h", "sha", "text").mapInArrow(combine, schema)
        if number:
            records = records.unionByName(before.select("h", "salt", "sha", "text", "ids").mapInArrow(again, schema))
        owned = records.repartitionById(owners, F.col("owner")).sortWithinPartitions("bucket", "h", "salt").select(*names)
        chained = owned.mapInArrow(own, f"prefix string, {ENTRY}")
        chained.write.mode("overwrite").option("compression", "zstd").partitionBy("prefix").parquet(f"{self.path}/entries-{number}")
        listed = self.spark.createDataFrame(directory.buckets, "prefix long, depth int, generation int")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/directory-{number}")
        discard(byh)

    def documents(self) -> DataFrame:
        """id, keep, copies and sha of every row that was inserted. Texts whose rows were chained in several tasks are
        chained once more, one record a task and text."""
        entries = self.entries()
        first = entries.filter("not hot").select("ids", "keep", "copies", "sha")

        schema = pa.schema([("h", pa.int64()), ("salt", pa.int32()), ("link", pa.int32()), ("whole_keep", pa.int64()), ("whole_copies", pa.int64())])

        def join(batches):
            for (h,), found in chains(batches, lambda r: [(r["salt"], r["link"], r["keep"], r["copies"])], "h"):
                for _, _, parts in found:
                    keep, copies = least([x[2] for x in parts]), sum(x[3] for x in parts)
                    yield pa.RecordBatch.from_pylist([{"h": h, "salt": salt, "link": link, "whole_keep": keep, "whole_copies": copies} for salt, link, _, _ in parts], schema)

        hot = entries.filter("hot")
        whole = hot.select("h", "salt", "link", "text", "keep", "copies").repartition("h").sortWithinPartitions("h").mapInArrow(join, "h long, salt int, link int, whole_keep long, whole_copies long")
        many = hot.select("h", "salt", "link", "ids", "sha").join(whole, ["h", "salt", "link"]).select("ids", F.col("whole_keep").alias("keep"), F.col("whole_copies").alias("copies"), "sha")
        return first.unionByName(many).select(F.explode("ids").alias("id"), "keep", "copies", "sha")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """key, keep_id, group_size, kept and text_sha256 of each row. Texts are equal if they are identical after each run of
    space and \\x09-\\x0D has become one space; of equal texts the row with the least key stays.

    Null texts are empty ones, and equal to each other. Rows that repeat a key and text are rows of the group, all kept or
    all not; a row without a key is kept only if its group has no key, whose keep_id is null then. An empty table gives no
    rows; other columns are not read. The index stays in `path` (by default in the shared folder), which the result reads.
    """
    index = ExactIndex(docs.sparkSession, path or scratch(docs.sparkSession, "exact"), capacity)
    index.insert(docs, key, text)
    kept = F.coalesce(F.col("id") == F.col("keep"), F.col("keep").isNull())
    return index.documents().select(F.col("id").alias(key), F.col("keep").alias("keep_id"), F.col("copies").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def sql(documents: str = "documents") -> str:
    """The same over `documents` (doc_id, text), whose keys are distinct, in DuckDB's SQL."""
    return f"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS x FROM {documents})
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(x) AS text_sha256 FROM t WINDOW w AS (PARTITION BY x)"""
