"""Topics, change feeds and tables as sources and sinks: files by default, Kafka or JDBC where their connectors are on the path."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .dims import DimStore, empty_dim, file_system
from .log import append_log, read_log

__all__ = ["DimStore", "append_log", "empty_dim", "file_system", "read_log"]


def read_topic(spark: SparkSession, topic: str, root: str = "", stream: bool = False, servers: str = "", group: str = "", latest: bool = True, per_trigger: int | None = None, positions: bool = False) -> DataFrame:
    """The topic's records as a string column value: text files in root/topic, or Kafka if servers are given.

    positions: adds the column position, by which records are in the order of their arrival: offsets of a partition in
    Kafka, else the files' modification time and name and the block within a file; in_order adds the lines of a block.
    Files that were written in one tick of that clock have no order but that of their names; a log's records have (logged).
    """
    if servers:
        options = {"kafka.bootstrap.servers": servers, "subscribe": topic} | ({"kafka.group.id": group} if group else {})
        options["startingOffsets"] = "latest" if latest and stream else "earliest"
        reader = (spark.readStream if stream else spark.read).format("kafka").options(**options)
        place = [F.struct(F.col("timestamp").alias("time"), F.lpad(F.col("partition").cast("string"), 10, "0").alias("name"), F.col("offset").alias("number")).alias("position")] if positions else []
        return reader.load().select(F.col("value").cast("string").alias("value"), *place)
    reader = spark.readStream.format("text") if stream else spark.read.format("text")
    rows = (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger and stream else reader).load(f"{root}/{topic}")
    if not positions:
        return rows
    meta = "_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start"
    return rows.select("value", F.struct(*(F.col(m).alias(n) for m, n in zip(meta, PLACE, strict=True))).alias("position"))


#: Fields of a record's position: when it came, and where it stands among what came then.
PLACE = ("time", "name", "number")


def logged(spark: SparkSession, topic: str, root: str, stream: bool = False, positions: bool = False) -> DataFrame:
    """The records of a topic's log (see sources.log); there may be none yet. Positions are those of read_topic: a log's
    commit times ascend with its offsets, so its own order is exact."""
    rows = read_log(spark, root, topic, stream)
    place = [F.struct(F.col("time"), F.lit(topic).alias("name"), F.col("offset").alias("number")).alias("position")] if positions else []
    return rows.select("value", *place)


def in_order(batch: DataFrame, name: str = "line") -> DataFrame:
    """A batch as it was read, with a number that ascends within each block of a file."""
    return batch.withColumn(name, F.monotonically_increasing_id())


def topic_view(spark: SparkSession, name: str, rows: DataFrame, time: Column, delay: str = "1 second", time_name: str = "rt") -> DataFrame:
    """rows with an event-time column and watermark, registered for SQL under a name."""
    out = rows.withColumn(time_name, time.cast("timestamp")).withWatermark(time_name, delay)
    out.createOrReplaceTempView(name)
    return out


def as_records(rows: DataFrame) -> DataFrame:
    """Rows as JSON strings, null fields left out."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def write_topic(rows: DataFrame, topic: str, root: str = "", servers: str = "") -> None:
    """A batch of rows as JSON records of a topic."""
    records = as_records(rows)
    if servers:
        records.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
    else:
        records.write.mode("append").text(f"{root}/{topic}")


def write_by_topic(routed: DataFrame, root: str = "", servers: str = "") -> None:
    """A batch of routed rows, each to the topic that its sinkTable names; the record is the after image."""
    records = routed.select(F.coalesce("sinkTable", F.lit("DWD_DEFAULT")).alias("topic"), F.to_json("after").alias("value"))
    if servers:
        records.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
    else:
        records.write.mode("append").partitionBy("topic").text(root)


def start(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """A streaming query that hands every micro-batch to `each`; available data only, or a trigger `every` so often."""
    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_to_topic(rows: DataFrame, topic: str, root: str, checkpoint: str, every: str | None = None, servers: str = "") -> StreamingQuery:
    """A streaming query that appends rows to a topic: to its files, exactly once by the file sink's log, or to Kafka if
    servers are given, at least once."""
    writer = as_records(rows).writeStream.option("checkpointLocation", checkpoint)
    if servers:
        writer = writer.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    else:
        writer = writer.format("text").option("path", f"{root}/{topic}")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def console(rows: DataFrame, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("console").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_feed(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Envelopes of a change-capture feed kept as JSON files (see schemas.DEBEZIUM); raw records are its value column."""
    from ..schemas import DEBEZIUM

    return (spark.readStream if stream else spark.read).schema(DEBEZIUM).json(path)


def snapshot_then_changes(snapshot: DataFrame, database: str, table: str, changes: DataFrame) -> DataFrame:
    """Change events of a table's snapshot (as reads) followed by its feed: an initial load, then the log."""
    image = F.create_map(*(x for c in snapshot.columns for x in (F.lit(c), F.col(c).cast("string"))))
    first = snapshot.select(F.lit(database).alias("database"), F.lit(table).alias("tableName"), F.create_map().cast("map<string,string>").alias("before"), image.alias("after"), F.lit("read").alias("type"))
    return first.unionByName(changes, allowMissingColumns=True)


def change_flags(events: DataFrame, schema: T.StructType) -> DataFrame:
    """A change feed as a table's changes: is_add and the columns; an update is a removal and an addition."""
    images = F.array(F.struct(F.lit(False).alias("is_add"), F.col("before").alias("m")), F.struct(F.lit(True).alias("is_add"), F.col("after").alias("m")))
    rows = events.select(F.explode(F.filter(images, lambda x: F.size(x["m"]) > 0)).alias("x"))
    return rows.select("x.is_add", *(F.col("x.m")[f.name].cast(f.dataType).alias(f.name) for f in schema.fields))


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def cities(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """The cities of provinces from a JSON array, or from the fallback if the path holds none."""
    from pyspark.errors import AnalysisException

    from ..schemas import CITIES

    try:
        return spark.read.schema(CITIES).option("multiLine", True).json(path)
    except AnalysisException:
        if fallback is None:
            raise
        return spark.read.schema(CITIES).option("multiLine", True).json(fallback)


def write_once(rows: DataFrame, path: str, write: Callable[[DataFrameWriter, str], None]) -> None:
    """Writes a folder unless it is there: a batch that runs again leaves the files that others may have read, but is
    computed, since its state is to be committed. The folder appears in whole, by one move of a hidden one, so readers see
    no part of a batch that dies (on a file system that moves folders in one step). A folder and the checkpoint that
    numbers its batches belong together."""
    fs, of = file_system(rows.sparkSession, path)
    if fs.exists(of(path)):
        rows.write.format("noop").mode("overwrite").save()
        return
    parent, _, name = path.rpartition("/")
    write(rows.write.mode("overwrite"), f"{parent}/.{name}")
    if not fs.rename(of(f"{parent}/.{name}"), of(path)):
        raise OSError(f"{path} could not be put in place")


def append_stats(rows: DataFrame, columns: Sequence[str], path: str) -> None:
    """A batch of statistics in the sink's column order; other columns are transient and left out."""
    rows.select(*columns).write.mode("append").parquet(path)

