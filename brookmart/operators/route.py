"""Routing of change events by a configuration table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a configuration that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def current_routes(config: DataFrame, order: str) -> DataFrame:
    """The last configuration of each (sourceTable, operateType) by the order column; a deleted one (null sinkType) is gone."""
    names = [c for c in config.columns if c not in ("sourceTable", "operateType")]
    last = config.groupBy("sourceTable", "operateType").agg(F.max_by(F.struct(*names), order).alias("x"))
    return last.select("sourceTable", "operateType", "x.*").filter("sinkType is not null")


def route(events: DataFrame, routes: DataFrame) -> DataFrame:
    """Events that have a route and aren't deletes, with sinkType, sinkTable, sinkPk, sinkExtend and the after image cut to
    sinkColumns (exact names, csv). Unmatched events are dropped."""
    live = events.filter(~F.col("type").eqNullSafe("delete"))
    r = routes.select(F.col("sourceTable").alias("tableName"), F.col("operateType").alias("type"), "sinkType", "sinkTable", F.split("sinkColumns", ",").alias("_cols"), F.coalesce("sinkPk", F.lit("id")).alias("sinkPk"), F.coalesce("sinkExtend", F.lit("")).alias("sinkExtend"))
    small = not routes.isStreaming and routes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = live.join(F.broadcast(r) if small else r, ["tableName", "type"])
    return joined.withColumn("after", F.map_filter("after", lambda k, v: F.array_contains("_cols", k))).drop("_cols")


#: What a route says.
SAYS = ("sinkType", "sinkTable", "sinkColumns", "sinkPk", "sinkExtend")
KEY = ("sourceTable", "operateType")


def route_changes(events: DataFrame, place: Column) -> DataFrame:
    """Change events of a configuration table as changes of routes: their key, place, and what they say, which is null where a
    route ends. A deleted row ends its route, and so does an update that gives the row another key."""
    key = lambda m: F.struct(*(F.col(m)[c].alias(c) for c in KEY))
    none = F.struct(*(F.lit(None).cast("string").alias(c) for c in SAYS))
    says = F.struct(*(F.col("after")[c].alias(c) for c in SAYS))
    put = ~F.col("type").eqNullSafe("delete") & F.col("after")[KEY[0]].isNotNull()
    moved = F.col("before")[KEY[0]].isNotNull() & (~put | ~key("before").eqNullSafe(key("after")))
    steps = F.array(F.when(moved, F.struct(key("before").alias("k"), none.alias("s"))), F.when(put, F.struct(key("after").alias("k"), says.alias("s"))))
    return events.select(place.alias("place"), F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("x")).select("x.k.*", "place", "x.s.*")


def route_history(changes: DataFrame) -> DataFrame:
    """Changes of routes as versions: each holds from its place until that of the next one of its key. Of changes at one place
    one that says something counts, then the greatest."""
    said = F.struct(F.col("sinkType").isNotNull().alias("_says"), *SAYS)
    one = changes.groupBy(*KEY, "place").agg(F.max(said).alias("x"))
    until = F.lead("place").over(Window.partitionBy(*KEY).orderBy("place"))
    return one.select(*KEY, F.col("place").alias("since"), until.alias("until"), *(F.col(f"x.{c}").alias(c) for c in SAYS))


def route_at(events: DataFrame, history: DataFrame, place: Column) -> DataFrame:
    """Each event that is no delete with the route of its table and type at its place, and status: routed; early (before the
    first version of its key), ended (its route was deleted) or none (its key has no version). after is cut to the route's
    columns where it is routed."""
    live = events.filter(~F.col("type").eqNullSafe("delete")).withColumn("_at", place)
    versions = history.select(F.col(KEY[0]).alias("_t"), F.col(KEY[1]).alias("_o"), "since", "until", *SAYS)
    first = versions.groupBy(F.col("_t").alias("_ft"), F.col("_o").alias("_fo")).agg(F.min("since").alias("_first"))
    small = not history.isStreaming and history.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast if small else lambda x: x
    on = (F.col("tableName") == F.col("_t")) & (F.col("type") == F.col("_o")) & (F.col("_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("_at") < F.col("until")))
    met = live.join(side(versions), on, "left").join(side(first), (F.col("tableName") == F.col("_ft")) & (F.col("type") == F.col("_fo")), "left")
    status = F.when(F.col("sinkType").isNotNull(), "routed").when(F.col("since").isNotNull(), "ended").when(F.col("_first").isNotNull(), "early").otherwise("none")
    columns = F.split("sinkColumns", ",")
    cut = F.when(F.col("sinkType").isNotNull(), F.map_filter("after", lambda k, v: F.array_contains(columns, k))).otherwise(F.col("after"))
    pk, extend = (F.when(F.col("sinkType").isNotNull(), F.coalesce(c, F.lit(d))).alias(c) for c, d in (("sinkPk", "id"), ("sinkExtend", "")))
    kept = [c for c in events.columns if c != "after"]
    return met.withColumn("status", status).select(*kept, cut.alias("after"), "sinkType", "sinkTable", "sinkColumns", pk, extend, "status")


def unmatched(events: DataFrame, routes: DataFrame) -> DataFrame:
    """Events without a route."""
    keys = routes.select(F.col("sourceTable").alias("tableName"), F.col("operateType").alias("type"))
    return events.filter(~F.col("type").eqNullSafe("delete")).join(keys, ["tableName", "type"], "left_anti")


def split_routed(routed: DataFrame) -> dict[str, DataFrame]:
    """dim: rows for the key-value store; fact: rows for topics. Other sink types are dropped."""
    return {"dim": routed.filter("sinkType = 'hbase'"), "fact": routed.filter("sinkType = 'kafka'")}


def latest_by_key(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert as a table: the last change of every key by the order columns. Partial maxima come before the shuffle."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return last.select(*keys, "x.*")
