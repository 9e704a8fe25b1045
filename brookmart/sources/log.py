"""A topic as a log with offsets, as a data source: `format("topic_log")`, for batches and streams, both ways.

A segment is a Parquet file of records; an index file a commit lists the segments that it added. A record's offset is its
number in the topic: by commits, then by the tasks that wrote, then by the rows of each. So the order of arrival is exact
however fast commits follow one another. Readers go by the index, so what a commit has not listed is not there; a commit
of a writer's batch that is there already adds nothing. One writer at a time commits to a topic.

Options: path, topic; for reading startingOffset (earliest, latest or a number; a stream that has a checkpoint goes on from
there), for writing writer and batch (which name a commit; a stream's own batch number by default). Records to write are the
column value, and go to the topic that their column topic names if there is one.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

NAME = "topic_log"
SCHEMA = "value string, offset long, time timestamp"
SEGMENT = pa.schema([("value", pa.string())])
#: Records of a row group, the unit that a reader skips.
GROUP = 65_536


@dataclass
class Segment:
    """A file of a topic, its first offset and number of records, and when it was committed (ms)."""

    name: str
    first: int
    rows: int
    at: int


class Index:
    """The commits of a topic. Their files' names tell first offset, records, writer and batch."""

    def __init__(self, path: str, topic: str):
        self.fs, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))
        self.folder = f"{root.rstrip('/')}/{topic}"

    def commits(self) -> list[tuple[int, int, str, str]]:
        """First offset, records, commit and file name, by offset."""
        found = []
        for x in self.fs.get_file_info(fs.FileSelector(f"{self.folder}/_index", allow_not_found=True)):
            name = x.base_name
            if name.endswith(".json") and not name.startswith("."):
                first, rows, commit = name[:-5].split("-", 2)
                found.append((int(first), int(rows), commit, name))
        return sorted(found)

    def end(self) -> int:
        return max((first + rows for first, rows, _, _ in self.commits()), default=0)

    def segments(self, start: int, end: int) -> list[Segment]:
        """The files that hold offsets of [start, end)."""
        out = []
        for first, rows, _, name in self.commits():
            if first < end and first + rows > start:
                with self.fs.open_input_stream(f"{self.folder}/_index/{name}") as f:
                    made = json.loads(f.read())
                at = first
                for file, n in made["files"]:
                    if at < end and at + n > start:
                        out.append(Segment(file, at, n, made["time"]))
                    at += n
        return out

    def add(self, commit: str, files: list[tuple[str, int]]) -> None:
        """Lists files (name, records) in order; nothing if the commit is there. The index file appears in one move."""
        before = self.commits()
        if any(c == commit for _, _, c, _ in before):
            return
        first, rows, now = self.end(), sum(n for _, n in files), int(time.time() * 1000)
        if before:
            with self.fs.open_input_stream(f"{self.folder}/_index/{before[-1][3]}") as f:
                now = max(now, json.loads(f.read())["time"])  # times ascend with offsets
        self.fs.create_dir(f"{self.folder}/_index", recursive=True)
        hidden = f"{self.folder}/_index/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(hidden) as f:
            f.write(json.dumps({"time": now, "files": files}).encode())
        self.fs.move(hidden, f"{self.folder}/_index/{first:020d}-{rows}-{commit}.json")


@dataclass
class Part(InputPartition):
    """Offsets [start, end) of one segment."""

    segment: Segment
    start: int
    end: int


def parts(index: Index, start: int, end: int) -> list[Part]:
    return [Part(s, max(start, s.first), min(end, s.first + s.rows)) for s in index.segments(start, end)]


def records(index: Index, part: Part) -> Iterator[pa.RecordBatch]:
    """The records of a part; row groups before it are not read."""
    kind = pa.timestamp("us", tz="UTC")
    with index.fs.open_input_file(f"{index.folder}/{part.segment.name}") as f:
        file, at = pq.ParquetFile(f), part.segment.first
        for g in range(file.num_row_groups):
            rows = file.metadata.row_group(g).num_rows
            if at < part.end and at + rows > part.start:
                table = file.read_row_group(g)
                begin, stop = max(part.start - at, 0), min(part.end - at, rows)
                for batch in table.slice(begin, stop - begin).to_batches(max_chunksize=8192):
                    offsets = pa.array(range(at + begin, at + begin + batch.num_rows), pa.int64())
                    times = pa.array([part.segment.at * 1000] * batch.num_rows, pa.int64()).cast(kind)
                    yield pa.RecordBatch.from_arrays([batch.column(0), offsets, times], ["value", "offset", "time"])
                    begin += batch.num_rows
            at += rows


def starting(index: Index, option: str | None) -> int:
    return index.end() if option == "latest" else int(option) if option and option != "earliest" else 0


class Reader(DataSourceReader):
    def __init__(self, index: Index, option: str | None):
        self.index, self.option = index, option

    def partitions(self) -> Sequence[InputPartition]:
        end = self.index.end()
        return parts(self.index, min(starting(self.index, self.option), end), end) or [Part(Segment("", 0, 0, 0), 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.end > partition.start:
            yield from records(self.index, partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, index: Index, option: str | None):
        self.index, self.option = index, option

    def initialOffset(self) -> dict:
        return {"offset": starting(self.index, self.option)}

    def latestOffset(self) -> dict:
        return {"offset": self.index.end()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return parts(self.index, start["offset"], end["offset"])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from records(self.index, partition)


@dataclass
class Written(WriterCommitMessage):
    """A task's files: topic, name and records of each."""

    task: int
    files: list[tuple[str, str, int]]


class _Writer:
    def __init__(self, options: dict):
        self.path, self.topic = options["path"], options.get("topic")
        self.writer, self.batch = options.get("writer", uuid.uuid4().hex), options.get("batch", "0")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task, open_, files = TaskContext.get().partitionId(), {}, []
        try:
            for batch in iterator:
                topics = batch.column("topic").to_pylist() if "topic" in batch.schema.names else [self.topic] * batch.num_rows
                for topic in dict.fromkeys(topics):
                    if topic is None:
                        raise ValueError("a record has no topic")
                    if topic not in open_:
                        index, name = Index(self.path, topic), f"part-{uuid.uuid4().hex}.parquet"
                        index.fs.create_dir(index.folder, recursive=True)
                        open_[topic] = [name, 0, pq.ParquetWriter(f"{index.folder}/{name}", SEGMENT, compression="zstd", filesystem=index.fs)]
                    own = pa.array([i for i, t in enumerate(topics) if t == topic])
                    values = batch.column("value").take(own).cast(pa.string())
                    open_[topic][2].write_table(pa.table([values], schema=SEGMENT), row_group_size=GROUP)
                    open_[topic][1] += len(values)
        finally:
            for topic, (name, rows, file) in open_.items():
                file.close()
                files.append((topic, name, rows))
        return Written(task, files)

    def _commit(self, messages: list, batch: str) -> None:
        found: dict[str, list[tuple[str, int]]] = {}
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            for topic, name, rows in m.files:
                found.setdefault(topic, []).append((name, rows))
        for topic, files in sorted(found.items()):
            Index(self.path, topic).add(f"{self.writer}-{batch}", files)

    def _abort(self, messages: list) -> None:
        """Deletes the files of a write that failed; what is not deleted is in no index."""
        for m in messages:
            for topic, name, _ in m.files if m is not None else []:
                index = Index(self.path, topic)
                index.fs.delete_file(f"{index.folder}/{name}")


class Writer(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self._commit(messages, self.batch)

    def abort(self, messages: list) -> None:
        self._abort(messages)


class StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._commit(messages, str(batchId))

    def abort(self, messages: list, batchId: int) -> None:
        self._abort(messages)


class TopicLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def index(self) -> Index:
        return Index(self.options["path"], self.options["topic"])

    def reader(self, schema) -> Reader:
        return Reader(self.index(), self.options.get("startingOffset"))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.index(), self.options.get("startingOffset"))

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("a log is appended to")
        return Writer(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(dict(self.options))


def read_log(spark: SparkSession, path: str, topic: str, stream: bool = False, start: str | int = "earliest") -> DataFrame:
    """A topic's records: value, offset, and the time of their commit. A topic that is not there yet is empty."""
    spark.dataSource.register(TopicLog)
    return (spark.readStream if stream else spark.read).format(NAME).options(path=path, topic=topic, startingOffset=str(start)).load()


def append_log(rows: DataFrame, path: str, topic: str | None = None, writer: str | None = None, batch: int | None = None) -> None:
    """Appends rows (value, and topic unless one is given) in one commit a topic; writer and batch name it, so that what
    runs again adds nothing."""
    rows.sparkSession.dataSource.register(TopicLog)
    named = {k: str(v) for k, v in (("topic", topic), ("writer", writer), ("batch", batch)) if v is not None}
    rows.write.format(NAME).options(path=path, **named).mode("append").save()
