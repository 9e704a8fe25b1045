"""Snapshots and logs, routes in time, retractions: batch, streams and the jobs."""

import json
import random

from pyspark.sql import functions as F
from test_streaming import change, drop

from brookmart.operators import changes, route
from brookmart.schemas import CHANGE_EVENT
from brookmart.sources import topics
from brookmart.streaming.jobs import Jobs


def events(spark, *rows):
    return spark.createDataFrame([("s", t, b or {}, a or {}, k, ts, pos) for t, b, a, k, ts, pos in rows], CHANGE_EVENT)


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


HISTORY = [
    ("b", None, {"id": "1", "name": "a"}, "read", None, 1),
    ("b", None, {"id": "1", "name": "b"}, "update", None, 2),  # no before image
    ("b", {"id": "1", "name": "b"}, {"id": "1", "name": "b"}, "update", None, 3),  # changes nothing
    ("b", None, {"id": "2", "name": "c"}, "insert", None, 4),
    ("b", {"id": "2", "name": "c"}, {"id": "3", "name": "c"}, "update", None, 5),  # another key
    ("b", {"id": "1", "name": "b"}, None, "delete", None, 6),
    ("b", None, {"id": "1", "name": "d"}, "insert", None, 7),
    ("b", None, {"id": "9"}, "delete", None, 8),  # never there
    ("b", None, {"name": "no key"}, "insert", None, 9),
]
FLAGS = [(True, 1, "a"), (False, 1, "a"), (True, 1, "b"), (True, 2, "c"), (False, 2, "c"), (True, 3, "c"), (False, 1, "b"), (True, 1, "d")]


def test_retractions_with_and_without_before_images(spark):
    schema = spark.createDataFrame([], "id int, name string").schema
    assert values(changes.retractions(events(spark, *HISTORY), ["id"], ["pos"], schema), "is_add", "id", "name") == sorted(FLAGS, key=repr)
    assert changes.retractions(events(spark, *HISTORY).limit(0), ["id"], ["pos"], schema).count() == 0


def test_retractions_of_a_stream(spark, tmp_path):
    rnd = random.Random(1)
    more = [("b", None, {"id": str(rnd.randrange(5)), "name": rnd.choice("xyz")} if i % 4 else {"id": str(rnd.randrange(5))}, "update" if i % 4 else "delete", None, 100 + i) for i in range(80)]
    rows = [*HISTORY, *more]
    drop(tmp_path / "t", [dict(zip(("database", "tableName", "before", "after", "type", "ts_ms", "pos"), ("s", *r), strict=True)) for r in rows], 4)
    raw = topics.read_topic(spark, "t", str(tmp_path), stream=True, per_trigger=1).select(F.from_json("value", CHANGE_EVENT).alias("r")).select("r.*")
    empty = F.create_map().cast("map<string,string>")
    raw = raw.withColumns({"before": F.coalesce("before", empty), "after": F.coalesce("after", empty)})
    schema = spark.createDataFrame([], "id int, name string").schema
    q = changes.retraction_stream(raw, ["id"], ["pos"], schema).writeStream.format("memory").queryName("flags").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = changes.retractions(events(spark, *rows), ["id"], ["pos"], schema)
    assert values(spark.table("flags"), "is_add", "id", "name") == values(want, "is_add", "id", "name")


def config(kind, before, after, pos):
    names = ("sourceTable", "operateType", "sinkType", "sinkTable", "sinkColumns", "sinkPk")
    return ("table_process", dict(zip(names, before, strict=False)) if before else None, dict(zip(names, after, strict=False)) if after else None, kind, None, pos)


A, B, C = ("a", "insert", "kafka", "dwd_a", "id"), ("a", "insert", "hbase", "dim_a", "id,x", "id"), ("b", "insert", "kafka", "dwd_b", "id")


def test_routes_hold_in_their_time(spark):
    place = F.struct("ts_ms", "pos")
    feed = events(spark, config("insert", None, A, 10), config("update", A, B, 20), config("delete", B, None, 30), config("insert", None, C, 12), config("update", C, ("a", "insert", "kafka", "dwd_c", "id"), 40))
    history = route.route_history(route.route_changes(feed, place))
    rows = events(spark, *(("a", None, {"id": str(p), "x": "y"}, "insert", None, p) for p in (5, 10, 19, 20, 29, 30, 35, 41)), ("a", None, {"id": "1"}, "delete", None, 15), ("a", None, {"id": "2"}, "update", None, 15), ("b", None, {"id": "3"}, "insert", None, 13), ("b", None, {"id": "4"}, "insert", None, 40))
    got = route.route_at(rows, history, place)
    assert values(got, "pos", "tableName", "status", "sinkTable") == sorted([
        (5, "a", "early", None), (10, "a", "routed", "dwd_a"), (19, "a", "routed", "dwd_a"), (20, "a", "routed", "dim_a"), (29, "a", "routed", "dim_a"), (30, "a", "ended", None), (35, "a", "ended", None),
        (41, "a", "routed", "dwd_c"), (15, "a", "none", None), (13, "b", "routed", "dwd_b"), (40, "b", "ended", None),
    ], key=repr)
    assert {tuple(r.after) for r in got.filter("pos = 10").collect()} == {("id",)}
    assert [(r.sinkPk, r.sinkExtend) for r in got.filter("pos = 20").collect()] == [("id", "")]


def feed(path, name, *rows):
    drop(path, [{"topic": f"srv.s.{t}", "before": b, "after": a, "op": {"insert": "c", "update": "u", "delete": "d"}[k], "ts_ms": ts, "pos": pos} for t, b, a, k, ts, pos in rows], 1, name)


def test_a_route_that_changes_in_mid_stream(spark, tmp_path):
    """The configuration among the changes and in a topic of its own; a dimension is there before its first row."""
    jobs = Jobs(spark, str(tmp_path))
    own = tmp_path / "topics" / "ods_config"
    drop(own, [], 1, "none")
    feed(tmp_path / "feed", "1", ("a", None, {"id": "1", "x": "early"}, "insert", 1, 1), config("insert", None, A, 2)[:4] + (1, 2), ("a", None, {"id": "2", "x": "q"}, "insert", 1, 3), config("insert", None, ("d", "insert", "hbase", "dim_d", "id,y", "id"), 4)[:4] + (1, 4))
    jobs.change_capture(str(tmp_path / "feed")).awaitTermination()
    jobs.route_db().awaitTermination()
    assert jobs.dims.read("dim_d").columns == ["id", "y"] and jobs.dims.read("dim_d").count() == 0
    drop(own, [dict(zip(("database", "tableName", "before", "after", "type", "ts_ms", "pos"), ("s", *config("update", A, B, 10)[:4], 2, 10), strict=True))], 1, "live")
    feed(tmp_path / "feed", "2", ("a", None, {"id": "3", "x": "still"}, "insert", 2, 9), ("a", None, {"id": "4", "x": "now"}, "insert", 2, 11), config("delete", B, None, 12)[:4] + (2, 12), ("a", None, {"id": "5", "x": "gone"}, "insert", 2, 13))
    jobs.change_capture(str(tmp_path / "feed")).awaitTermination()
    jobs.route_db().awaitTermination()
    facts = spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "facts"))
    assert sorted(json.loads(r.value)["id"] for r in facts.collect()) == ["2", "3"]
    assert values(jobs.dims.read("dim_a"), "id", "x") == [("4", "now")]
    apart = spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "unrouted")).collect()
    assert sorted((json.loads(r.value)["status"], json.loads(r.value)["after"]["id"]) for r in apart) == [("early", "1"), ("ended", "5")]


def test_a_snapshot_is_handed_over_to_its_log(spark, tmp_path):
    """Two chunks of a snapshot, read at positions 10 and 20; changes before, between and after, and jobs that stop."""
    chunk = lambda n, pos, *rows: spark.createDataFrame([(i, v, pos) for i, v in rows], "id string, v string, _pos long").coalesce(1).write.mode("append").parquet(str(tmp_path / "snapshot"))
    jobs = Jobs(spark, str(tmp_path))
    run = lambda: jobs.snapshot_capture(str(tmp_path / "snapshot"), str(tmp_path / "feed"), "s", "t", ["id"], 10).awaitTermination()
    chunk(1, 10, ("1", "s1"), ("2", "s2"))
    feed(tmp_path / "feed", "1", ("t", None, {"id": "0", "v": "gone before"}, "insert", 1, 3), ("t", None, {"id": "1", "v": "in it"}, "update", 1, 9), ("t", None, {"id": "1", "v": "n1"}, "update", 1, 11), ("t", None, {"id": "3", "v": "n3"}, "update", 1, 15), ("t", {"id": "4", "v": "x"}, None, "delete", 1, 25), ("other", None, {"id": "1"}, "insert", 1, 12))
    run()
    chunk(2, 20, ("3", "s3"), ("4", "s4"), ("5", "s5"))
    feed(tmp_path / "feed", "2", ("t", None, {"id": "3", "v": "old"}, "update", 1, 16), ("t", None, {"id": "5", "v": "n5"}, "update", 1, 21), ("t", None, {"id": "1", "v": "n1"}, "update", 1, 11))
    run()
    run()
    got = [json.loads(r.value) for r in topics.read_log(spark, str(tmp_path / "logs"), "ods_base_db").orderBy("offset").collect()]
    assert sorted((e["pos"], (e["after"] or e["before"]).get("v"), e["type"]) for e in got) == [(10, "s1", "read"), (10, "s2", "read"), (11, "n1", "update"), (15, "n3", "update"), (16, "old", "update"), (20, "s3", "read"), (20, "s5", "read"), (21, "n5", "update"), (25, "x", "delete")]
    of = {}
    for e in got:  # a key's changes come in their order
        of.setdefault((e["after"] or e["before"])["id"], []).append(e["pos"])
    assert all(p == sorted(p) for p in of.values())


def test_change_events_and_images(spark):
    row = spark.createDataFrame([("1", None, 7)], "id string, v string, _pos long")
    got = changes.snapshot_events(row, "s", "t", F.col("_pos")).first()
    assert (got.after, got.before, got.type, got.pos) == ({"id": "1"}, {}, "read", 7)
    assert change("t", id=1)["after"] == {"id": "1"}
