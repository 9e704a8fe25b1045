"""Change events as a table's additions and retractions, from the last image of each key."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window


def image_of(name: str) -> Column:
    """An image of an event; null if it is missing or empty."""
    return F.when(F.size(name) > 0, F.col(name))


def keyed(events: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Events as steps of their keys' histories: _key and _image (null where the row is gone). A change of the key itself ends
    the old key's row and begins the new one's. Events without a key are left out."""
    key = lambda m: F.concat_ws("\x1f", *(F.col(m)[c] for c in pk)) if len(pk) > 1 else F.col(m)[pk[0]]
    before, after = key("before"), F.when(~F.col("type").eqNullSafe("delete"), key("after"))
    gone = F.when(before.isNotNull() & ~before.eqNullSafe(after), F.struct(before.alias("key"), F.lit(None).cast("map<string,string>").alias("image")))
    here = F.when(after.isNotNull(), F.struct(after.alias("key"), F.col("after").alias("image")))
    steps = F.filter(F.array(gone, here), lambda x: x.isNotNull())
    # A delete of a feed without before images names its key in the after image, if anywhere.
    bare = F.when(F.col("type").eqNullSafe("delete") & before.isNull() & key("after").isNotNull(), F.array(F.struct(key("after").alias("key"), F.lit(None).cast("map<string,string>").alias("image"))))
    return events.withColumn("_s", F.explode(F.coalesce(bare, steps))).withColumns({"_key": F.col("_s.key"), "_image": F.col("_s.image")}).drop("_s")


def _flags(old: Column, new: Column) -> Column:
    """The images to retract and to add when a key's row goes from old to new; nothing if it stays as it is."""
    same = F.array_sort(F.map_entries(old)).eqNullSafe(F.array_sort(F.map_entries(new)))
    both = F.array(F.struct(F.lit(False).alias("is_add"), old.alias("image")), F.struct(F.lit(True).alias("is_add"), new.alias("image")))
    return F.filter(both, lambda x: x["image"].isNotNull() & ~same)


def _table(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select("is_add", *(F.col("image")[f.name].cast(f.dataType).alias(f.name) for f in schema.fields))


def retractions(events: DataFrame, pk: Sequence[str], order: Sequence[str], schema: T.StructType) -> DataFrame:
    """A feed of change events as a table's changes: is_add and the columns of the schema. An update retracts the row that
    the key had and adds the new one, whether the feed has before images or not; a delete retracts; what changes nothing
    gives nothing. order: columns by which a key's events follow one another."""
    w = Window.partitionBy("_key").orderBy(*order)
    steps = keyed(events, pk).withColumn("_old", F.lag("_image").over(w))
    return _table(steps.select(F.explode(_flags(F.col("_old"), F.col("_image"))).alias("x")).select("x.*"), schema)


class _Retract(StatefulProcessor):
    """Keeps the last image of a key; a batch's events go by their order."""

    def __init__(self, order: tuple[str, ...]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "image string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = before = self.last.get()[0] if self.last.exists() else None
        for r in sorted(rows, key=lambda r: tuple((r[c] is not None, r[c]) if r[c] is not None else (False,) for c in self.order)):
            if r["_image"] != last:
                if last is not None:
                    yield Row(is_add=False, image=last)
                if r["_image"] is not None:
                    yield Row(is_add=True, image=r["_image"])
                last = r["_image"]
        if last is None:
            self.last.clear()
        elif last != before:
            self.last.update((last,))

    def close(self) -> None:
        pass


def retraction_stream(events: DataFrame, pk: Sequence[str], order: Sequence[str], schema: T.StructType) -> DataFrame:
    """The same of a stream, whose state is the last image of each key. The order columns are numbers, strings or times; events
    that come in a later batch are later."""
    sorted_image = F.when(F.col("_image").isNotNull(), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("_image")))))
    steps = keyed(events, pk).withColumn("_image", sorted_image).select("_key", "_image", *order)
    made = T.StructType([T.StructField("is_add", T.BooleanType()), T.StructField("image", T.StringType())])
    rows = steps.groupBy("_key").transformWithState(_Retract(tuple(order)), made, outputMode="append", timeMode="None")
    return _table(rows.withColumn("image", F.from_json("image", "map<string,string>")), schema)


class _Handover(StatefulProcessor):
    """Lets an event of a key through if its place in the log is after that of the last one let through. Keys share their
    bucket's state, since each call of the state is a round trip."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getValueState("places", "by_key string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        places = json.loads(self.places.get()[0]) if self.places.exists() else {}
        changed = False
        for r in sorted(rows, key=lambda r: (r["_key"], r["pos"], r["_log"])):  # a snapshot's row stands before the log's at its place
            last = places.get(r["_key"])
            if last is None or r["pos"] > last:
                places[r["_key"]] = r["pos"]
                changed = True
                yield Row(_row=r["_row"])
        if changed:
            self.places.update((json.dumps(places),))

    def close(self) -> None:
        pass


def handover(snapshot: DataFrame, log: DataFrame, pk: Sequence[str], at: int | None = None, buckets: int = 16_384) -> DataFrame:
    """A table's snapshot and its log as one feed of change events (streams of schemas.CHANGE_EVENT; both have pos).

    A row of the snapshot stands at the log's position at which the reading of it (or of its chunk) began: changes up to
    there are in it, later ones may be. So of a key what is let through has ascending positions: the log's changes after
    the row's position follow it, those up to there are dropped, and so is a row of the snapshot that comes when a later
    change of its key is through already. at: the position at which the whole snapshot began; the log's changes up to there
    are dropped for all keys, also those that the snapshot does not have. Every change goes through once, whatever runs
    again. State is a position for each key, kept by buckets of keys: a batch reads and writes the buckets that it has rows of,
    whole, so that large ones take a call for many keys and small ones write some keys more than they have.
    """
    log = log.filter(F.col("pos") > at) if at is not None else log
    both = snapshot.withColumn("_log", F.lit(False)).unionByName(log.withColumn("_log", F.lit(True)))
    key = lambda m: F.concat_ws("\x1f", *(F.col(m)[c] for c in pk)) if len(pk) > 1 else F.col(m)[pk[0]]
    known = both.withColumn("_key", F.coalesce(key("after"), key("before"))).filter(F.col("_key").isNotNull() & F.col("pos").isNotNull())
    fields = snapshot.schema.fields
    bucket = F.pmod(F.xxhash64("_key"), F.lit(buckets)).alias("_bucket")
    packed = known.select(bucket, "_key", "pos", "_log", F.to_json(F.struct(*(f.name for f in fields))).alias("_row"))
    made = T.StructType([T.StructField("_row", T.StringType())])
    rows = packed.groupBy("_bucket").transformWithState(_Handover(), made, outputMode="append", timeMode="None")
    return rows.select(F.from_json("_row", T.StructType(fields)).alias("r")).select("r.*")


def snapshot_events(rows: DataFrame, database: str, table: str, pos: Column) -> DataFrame:
    """Rows of a table's snapshot as read events at a position of the log."""
    columns = [c for c in rows.columns if c != "_pos"]
    image = F.map_filter(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("string")))), lambda k, v: v.isNotNull())
    empty = F.create_map().cast("map<string,string>")
    return rows.select(F.lit(database).alias("database"), F.lit(table).alias("tableName"), empty.alias("before"), image.alias("after"), F.lit("read").alias("type"), F.lit(None).cast("long").alias("ts_ms"), pos.cast("long").alias("pos"))
