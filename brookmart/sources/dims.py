"""Dimensions as bucketed, keyed tables: upserts write their own rows, lookups open only the files that may hold their keys.

A dimension's rows are hashed to buckets by key and sorted by key within them. Every row keeps its place at the source, so
the newest change of a key counts in whichever batch it came. A version is a manifest that lists the files of each bucket
with their least and greatest keys; it is written last, so readers see whole versions only, and a batch that runs again
finds its version there. A bucket of many files is merged into one; a table that outgrows its buckets gets more of them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "bucket int, folder string, rows long, low string, high string, buckets int"


@dataclass(frozen=True)
class Segment:
    """A bucket's rows of one write: its folder, and the least and greatest key in it."""

    bucket: int
    folder: str
    rows: int
    low: str
    high: str


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and a function from strings to its paths."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsc.hadoopConfiguration()), of


def key_of(columns: Sequence[str | Column]) -> Column:
    """One string of a key's columns; null if one of them is null."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return parts[0] if len(parts) == 1 else F.concat_ws("\x1f", *(F.coalesce(p, F.raise_error(F.lit("a key has a null"))) for p in parts))


class DimStore:
    """Dimensions under a root that driver and executors share; one job at a time writes a dimension.

    COMPACT: files of a bucket that are merged into one. ROWS: rows of a bucket, beyond which there are more buckets.
    POINTS: up to so many distinct keys of a lookup are told to the files' own statistics. KEEP: versions before the
    last that stay readable.
    """

    COMPACT, ROWS, POINTS, KEEP = 8, 250_000, 1000, 4

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.fs, self.of = file_system(spark, self.root)

    def versions(self, table: str) -> list[int]:
        """Numbers of the complete versions, in ascending order."""
        return self._complete(table, "manifest-")

    def _complete(self, table: str, kind: str) -> list[int]:
        """The numbers of a table's complete folders of a kind, in ascending order."""
        if not self.fs.exists(self.of(f"{self.root}/{table}")):
            return []
        found = [x.getPath().getName() for x in self.fs.listStatus(self.of(f"{self.root}/{table}"))]
        return sorted(int(x[len(kind) :]) for x in found if x.startswith(kind) and self.fs.exists(self.of(f"{self.root}/{table}/{x}/_SUCCESS")))

    def manifest(self, table: str, until: int | None = None) -> tuple[int, int, list[Segment]] | None:
        """Number, buckets and segments of the last version (up to `until`)."""
        found = [n for n in self.versions(table) if until is None or n <= until]
        if not found:
            return None
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{table}/manifest-{found[-1]}").collect()  # COMPACT rows a bucket at most
        return found[-1], rows[0].buckets, [Segment(r.bucket, r.folder, r.rows, r.low, r.high) for r in rows if r.bucket >= 0]

    def _commit(self, table: str, number: int, buckets: int, segments: list[Segment]) -> None:
        rows = [(-1, "", 0, None, None, buckets), *((s.bucket, s.folder, s.rows, s.low, s.high, buckets) for s in segments)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{table}/manifest-{number}")

    def schema(self, table: str) -> T.StructType:
        """The dimension's columns, the key's marked: what it was created with and columns that came later."""
        return self.spark.read.parquet(f"{self.root}/{table}/schema-{self._complete(table, 'schema-')[-1]}").schema

    def exists(self, table: str) -> bool:
        return bool(self._complete(table, "schema-"))

    def _declare(self, table: str, fields: list[T.StructField]) -> None:
        """Writes the columns, under the next number, if some are new."""
        found = self._complete(table, "schema-")
        old = self.schema(table).fields if found else []
        known = {f.name for f in old}
        new = [*old, *(f for f in fields if f.name not in known)]
        if len(new) > len(old):
            number = found[-1] + 1 if found else 0
            self.spark.createDataFrame([], T.StructType(new)).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{table}/schema-{number}")

    def create(self, table: str, columns: str, pk: str | None = None, extend: str | None = None) -> bool:
        """Makes an empty dimension unless there is one: all columns strings, the key (id by default) not null. `extend` is
        kept as the key's metadata. Whether it was made."""
        if self.exists(table):
            return False
        self._declare(table, empty_dim(self.spark, columns, pk, extend).schema.fields)
        return True

    def _read(self, table: str, segments: Sequence[Segment], keys: Column | None = None) -> DataFrame:
        """The newest row of each key in the segments, with its _key, _order and _n. The segments of a folder are one scan."""
        folders: dict[str, list[str]] = {}
        for s in segments:
            folders.setdefault(s.folder, []).append(f"{self.root}/{table}/{s.folder}/bucket={s.bucket}")
        parts = [self.spark.read.parquet(*paths) for paths in folders.values()]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        if keys is not None:
            rows = rows.filter(keys)
        if len({s.bucket for s in segments}) == len(segments):
            return rows  # one segment a bucket: its keys are distinct
        rest = [c for c in rows.columns if c not in ("_key", "_order", "_n")]
        last = rows.groupBy("_key").agg(F.max_by(F.struct("_order", "_n", *rest), F.struct("_order", "_n")).alias("x"))
        return last.select("_key", "x.*")

    def _shaped(self, table: str, rows: DataFrame | None) -> DataFrame:
        """The rows with the dimension's columns."""
        fields = self.schema(table).fields
        if rows is None:
            return self.spark.createDataFrame([], T.StructType(fields))
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in fields))

    def read(self, table: str, until: int | None = None) -> DataFrame | None:
        """The dimension as it is, or as it was after the version `until`; None if there is none."""
        found = self.manifest(table, until)
        if found is None and (until is not None or not self.exists(table)):
            return None
        return self._shaped(table, self._read(table, found[2]) if found and found[2] else None)

    def near(self, table: str, keys: DataFrame) -> DataFrame | None:
        """The rows that the keys (one column) may find. Only segments whose bucket and range of keys meet them are opened;
        a few keys also go to the scan as a filter on the sorted key column."""
        found = self.manifest(table)
        if found is None:
            return self.read(table)
        _, buckets, segments = found
        asked = keys.select(F.col(f"`{keys.columns[0]}`").cast("string").alias("_key")).filter("_key is not null").distinct()
        some = [r[0] for r in asked.limit(self.POINTS + 1).collect()]
        if len(some) <= self.POINTS:
            some.sort()
            of = {}
            for r in self.spark.createDataFrame([(x,) for x in some], "_key string").select("_key", bucket_of(F.col("_key"), buckets).alias("b")).collect():
                of.setdefault(r.b, []).append(r._key)
            wanted = [s for s in segments if any_between(sorted(of.get(s.bucket, [])), s.low, s.high)]
            return self._shaped(table, self._read(table, wanted, F.col("_key").isin(some)) if wanted else None)
        # A row a bucket, whatever the number of keys.
        spans = {r.b: r for r in asked.groupBy(bucket_of(F.col("_key"), buckets).alias("b")).agg(F.min("_key").alias("low"), F.max("_key").alias("high")).collect()}
        wanted = [s for s in segments if s.bucket in spans and s.low <= spans[s.bucket].high and s.high >= spans[s.bucket].low]
        return self._shaped(table, self._read(table, wanted) if wanted else None)

    def upsert(self, table: str, changes: DataFrame, pk: Sequence[str], order: Sequence[str], version: int | None = None) -> None:
        """The newest change of each key, by the order columns, replaces its row if that is older or as old; equal ones go by
        the version's number. Order columns are not part of the dimension. Rows with a null in the key are left out. A
        version that is there already (a batch that runs again) stays."""
        found = self.manifest(table)
        last, buckets, segments = found or (-1, self.buckets, [])
        number = last + 1 if version is None else version
        if number in self.versions(table):
            return
        if found and number < last:
            raise ValueError(f"version {number} of {table} comes after {last}")
        rest = [c for c in changes.columns if c not in order]
        keyed = changes.filter(reduce(Column.__and__, (F.col(c).isNotNull() for c in pk))).withColumn("_key", key_of(pk))
        newest = keyed.groupBy("_key").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"), F.max(F.struct(*order)).alias("_order"))
        rows = newest.select("_key", "_order", F.lit(number).cast("long").alias("_n"), "x.*")
        self._declare(table, [T.StructField(f.name, f.dataType, f.name not in pk, {**f.metadata, "pk": True} if f.name in pk else f.metadata) for f in changes.schema.fields if f.name in rest])
        new = self._write(table, f"data-{number}", rows, buckets)
        segments = [*segments, *new]
        total, many = sum(s.rows for s in segments), {s.bucket for s in segments if sum(x.bucket == s.bucket for x in segments) >= self.COMPACT}
        if total > self.ROWS * buckets:
            buckets *= 4 ** max(1, (total // (self.ROWS * buckets)).bit_length() // 2)
            segments = self._write(table, f"merged-{number}", self._read(table, segments), buckets)
        elif many:
            merged = self._write(table, f"merged-{number}", self._read(table, [s for s in segments if s.bucket in many]), buckets)
            segments = [s for s in segments if s.bucket not in many] + merged
        self._commit(table, number, buckets, segments)
        self._clean(table)

    def _write(self, table: str, folder: str, rows: DataFrame, buckets: int) -> list[Segment]:
        """Rows in a file a bucket, sorted by key; what is in each."""
        placed = rows.withColumn("bucket", bucket_of(F.col("_key"), buckets)).repartition("bucket").sortWithinPartitions("bucket", "_key")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{table}/{folder}")
        if not any(x.getPath().getName().startswith("bucket=") for x in self.fs.listStatus(self.of(f"{self.root}/{table}/{folder}"))):
            return []
        written = self.spark.read.parquet(f"{self.root}/{table}/{folder}").groupBy("bucket").agg(F.count("*").alias("rows"), F.min("_key").alias("low"), F.max("_key").alias("high"))
        return [Segment(r.bucket, folder, r.rows, r.low, r.high) for r in written.collect()]  # a row a bucket

    def _clean(self, table: str) -> None:
        """Deletes versions before the last KEEP, and folders of buckets that no version names; readers may still have those."""
        numbers = self.versions(table)
        for n in numbers[: -self.KEEP]:
            self.fs.delete(self.of(f"{self.root}/{table}/manifest-{n}"), True)
        used = {(s.folder, s.bucket) for n in numbers[-self.KEEP :] for s in self.manifest(table, n)[2]}
        folders = {f for f, _ in used}
        for x in self.fs.listStatus(self.of(f"{self.root}/{table}")):
            name = x.getPath().getName()
            if name.startswith(("data-", "merged-")):
                for b in self.fs.listStatus(x.getPath()):
                    label = b.getPath().getName()
                    if label.startswith("bucket=") and (name, int(label[7:])) not in used:
                        self.fs.delete(b.getPath(), True)
                if name not in folders:
                    self.fs.delete(x.getPath(), True)

    def dim(self, table: str) -> Dim:
        return Dim(self, table)


class Dim:
    """A dimension of a store for operators.joins.lookup, which asks for the rows that its keys may find."""

    def __init__(self, store: DimStore, table: str):
        self.store, self.table = store, table

    def near(self, keys: DataFrame) -> DataFrame | None:
        return self.store.near(self.table, keys)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def any_between(keys: list[str], low: str, high: str) -> bool:
    """Whether one of the ascending keys is within the bounds."""
    i = bisect_left(keys, low)
    return i < len(keys) and keys[i] <= high


def empty_dim(spark: SparkSession, columns: str, pk: str | None = None, extend: str | None = None) -> DataFrame:
    """An empty dimension: all columns strings, the key (id by default) not null. `extend` is kept as metadata."""
    key = pk or "id"
    fields = [T.StructField(c, T.StringType(), c != key, {"extend": extend or "", "pk": True} if c == key else {}) for c in columns.split(",")]
    return spark.createDataFrame([], T.StructType(fields))
