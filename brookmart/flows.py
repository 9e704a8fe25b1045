"""Queries that take the driver's tables through topics, stores and streams, and the SQL that gives the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import columns as C
from .operators import changes, joins, parse, pattern, route
from .plans import dashboard, stats
from .queries import BOUNCE_SQL, FULL_SQL, P_SQL, pages, product_full, wide_rows
from .registry import QUERIES, SQL, query, table
from .sources import dims, rollups, topics
from .sources.shared import folder
from .streaming import state

__all__ = ["QUERIES", "SQL"]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a file of a stream.
FILE_ROWS = 100_000


def settled(rows: DataFrame, name: str) -> DataFrame:
    """What a stream gives when it has taken all that is there, by way of files; and the last watermark's batch."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    path = folder(spark, name)
    writer = rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


def streamed(rows: DataFrame, name: str, batches: int = 3, by: str | Column = "event_id") -> DataFrame:
    """Rows as a stream of at most so many micro-batches, each of as many files as its rows ask for (FILE_ROWS): no task
    writes or reads a part that grows with the table."""
    path = folder(rows.sparkSession, name)
    files = -(-rows.count() // (batches * FILE_ROWS)) or 1
    rows.repartition(batches * files, by).write.parquet(path)
    reader = rows.sparkSession.readStream.schema(rows.schema)
    return (reader.option("maxFilesPerTrigger", files) if batches > 1 else reader).parquet(path)


@query("""SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, CAST((SELECT count(*) FROM events) AS BIGINT) AS offsets FROM events GROUP BY event_type""")
def topic_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of a topic's log, in four commits of which one runs again; offsets have no gaps."""
    root = folder(spark, "log")
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    for n in (0, 1, 1, 2, 3):
        topics.append_log(topics.as_records(e.filter(F.col("event_id") % 4 == n)), root, "events", "job", n)
    rows = topics.read_log(spark, root, "events")
    span = rows.agg((F.max("offset") - F.min("offset") + 1).alias("offsets"))
    read = rows.select(F.from_json("value", "event_id bigint, event_type string").alias("r")).select("r.*")
    counts = read.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
    return counts.join(F.broadcast(span))  # one row


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL")
def topic_table_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over a stream of records as a table with an event time and a watermark; the last hours settle as a later record comes."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    last = e.agg(F.max("ts").alias("m")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("m") + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.lit("error").alias("event_type"))
    topics.topic_view(spark, "topic_table_stream_rows", streamed(e.unionByName(last), "table", 1), F.col("ts"), "1 day")
    out = spark.sql("SELECT date_format(window(rt, '1 hour').start, 'yyyy-MM-dd HH') AS hour, event_type, count(*) AS n FROM topic_table_stream_rows GROUP BY window(rt, '1 hour'), event_type")
    spark.catalog.dropTempView("topic_table_stream_rows")
    return settled(out, "hours").filter("event_type <> 'error'")


@query("SELECT 'dwd_' || lower(o_orderstatus) AS topic, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders GROUP BY 1")
def routed_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order to the log of the topic that it names."""
    root, o = folder(spark, "routed"), table(spark, sf_dir, "orders")
    named = o.select(F.concat(F.lit("dwd_"), F.lower("o_orderstatus")).alias("topic"), F.to_json(F.struct(F.col("o_orderkey").alias("id"))).alias("value"))
    topics.append_log(named, root)
    read = [topics.read_log(spark, root, t).select(F.lit(t).alias("topic"), F.from_json("value", "id bigint")["id"].alias("id")) for t in (f"dwd_{x}" for x in "fop")]
    return reduce(DataFrame.unionByName, read).groupBy("topic").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("""SELECT c_custkey, status, priority FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS priority FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def dim_store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's last order as a dimension, whose changes come in batches that are not in the order of their times; then
    looked up for all customers."""
    store = dims.DimStore(spark, folder(spark, "dims"))
    store.create("last_order", "id,status,priority")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("pos"))
    for n in range(3):
        store.upsert("last_order", o.filter(F.col("pos") % 3 == 2 - n), ["id"], ["at", "pos"], n)
    return joins.lookup(table(spark, sf_dir, "customer").select("c_custkey"), store.dim("last_order"), "c_custkey", "id", {"status": "status", "priority": "priority"})


@query("""WITH e AS (SELECT o_orderkey AS id, o_orderstatus AS v, 1000 AS pos, 'read' AS type FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, o_orderpriority, 1001 + o_orderkey, 'update' FROM orders WHERE o_orderkey % 3 = 0),
l AS (SELECT id, arg_max(v, pos) AS v, count(*) AS n FROM e GROUP BY id) SELECT id, v, n FROM l""")
def snapshot_then_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the orders as a snapshot that was read at position 1000 of their log, whose changes before that (and what comes
    twice) are not seen again: each order's last value, and how many changes it had."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"), F.col("o_orderpriority").alias("w"))
    taken = changes.snapshot_events(o.filter("id % 2 = 0").select("id", "v"), "shop", "orders", F.lit(1000))
    none, image = F.create_map().cast("map<string,string>"), F.create_map(F.lit("id"), F.col("id").cast("string"), F.lit("v"), F.col("w"))

    def event(kind: str, pos):
        return o.filter("id % 3 = 0").select(F.lit("shop").alias("database"), F.lit("orders").alias("tableName"), none.alias("before"), image.alias("after"), F.lit(kind).alias("type"), F.lit(None).cast("long").alias("ts_ms"), pos.cast("long").alias("pos"))

    log = event("insert", F.col("id") % 1000).unionByName(event("update", F.col("id") + 1001)).unionByName(event("update", F.col("id") + 1001))
    # The whole snapshot is in the first batch: a row of it that came after a later change of its key would be dropped.
    made = changes.handover(streamed(taken, "snapshot", 1, F.col("after")["id"]), streamed(log, "changes", 3, "pos"), ["id"], 1000)
    rows = settled(made, "handover").select(F.col("after")["id"].cast("long").alias("id"), F.col("after")["v"].alias("v"), "pos")
    return route.latest_by_key(rows.withColumn("n", F.lit(1)), ["id"], ["pos"]).drop("n", "pos").join(rows.groupBy("id").agg(F.count("*").alias("n")), "id")


@query("""WITH h AS (SELECT user_id, img, lag(img) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM (SELECT user_id, event_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS img FROM events))
SELECT is_add, user_id, event_type, count(*) AS n FROM (SELECT FALSE AS is_add, user_id, old AS event_type FROM h WHERE old IS NOT NULL AND old IS DISTINCT FROM img
UNION ALL SELECT TRUE, user_id, img FROM h WHERE img IS NOT NULL AND old IS DISTINCT FROM img) GROUP BY ALL""")
def retraction_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change feed in envelopes as a stream: what each change retracts and adds."""
    key, gone = (F.lit("user_id"), F.col("user_id").cast("string")), F.col("event_id") % 7 == 0
    none = F.lit(None).cast("map<string,string>")
    feed = table(spark, sf_dir, "events").select(F.lit("srv.shop.users").alias("topic"), F.when(gone, F.create_map(*key)).alias("before"), F.when(gone, none).otherwise(F.create_map(*key, F.lit("event_type"), F.col("event_type"))).alias("after"), F.when(gone, "d").otherwise("u").alias("op"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("pos"))
    path = folder(spark, "feed")
    feed.repartitionByRange(3, "pos").sortWithinPartitions("pos").write.json(path)
    events = parse.change_events(topics.change_feed(spark, path, stream=True))
    out = changes.retraction_stream(events, ["user_id"], ["pos"], T.StructType().add("user_id", "long").add("event_type", "string"))
    return settled(out, "retractions").groupBy("is_add", "user_id", "event_type").agg(F.count("*").alias("n"))


@query(P_SQL + " SELECT event_id, CASE WHEN is_new = '1' AND row_number() OVER (PARTITION BY user_id, is_new ORDER BY ms, event_id) > 2 THEN '0' ELSE is_new END AS is_new FROM p")
def is_new_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The is_new repair with state; the log comes in the order of its times."""
    rows = pages(spark, sf_dir).select("event_id", "ts", "common.mid", "common.is_new")
    path = folder(spark, "log")
    rows.repartitionByRange(3, "ts", "event_id").sortWithinPartitions("ts", "event_id").write.parquet(path)
    return settled(state.repair_is_new(spark.readStream.schema(rows.schema).parquet(path), "mid", "is_new", ["ts", "event_id"]), "is_new").select("event_id", "is_new")


@query(f"{P_SQL} SELECT event_id, user_id, ms AS ts FROM ({BOUNCE_SQL})")
def bounce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounces as a pattern of a stream, whose files hold rows out of order; a last row moves the watermark past all others."""
    rows = pages(spark, sf_dir).select("event_id", "ts", "et", F.col("common.mid").alias("mid"), C.is_entry(F.col("page.last_page_id")).alias("entry"))
    last = rows.agg(F.max("et").alias("m")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("ts"), (F.col("m") + F.expr("INTERVAL 30 DAYS")).alias("et"), F.lit("-1").alias("mid"), F.lit(False).alias("entry"))
    entry = pattern.Step(F.col("entry"))
    found = pattern.match_stream(streamed(rows.unionByName(last), "pages", 1), "mid", "et", ["ts", "event_id"], [entry, entry], 6 * 3600 * 1000, ["event_id", "ts"], "1 hour")
    return settled(found, "bounces").select(F.col("rows")[0]["event_id"].alias("event_id"), F.col("mid").cast("long").alias("user_id"), F.col("rows")[0]["ts"].alias("ts"))


@query(FULL_SQL + " SELECT tm_name AS name, CAST(sum(CAST(order_amount AS DECIMAL(18,2))) AS DOUBLE) AS value FROM full_stats GROUP BY tm_id, tm_name HAVING sum(order_amount) > 0")
def dash_seller_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sellers' dashboard from sums that batches of windows were added to, one of them twice. The windows are made once,
    by batches, rather than for each batch."""
    path, of_batch = folder(spark, "windows"), F.pmod(F.xxhash64("stt"), F.lit(3)).alias("_batch")
    sums = rollups.rollup(spark, folder(spark, "sums"), "product_stats")
    full = product_full(spark, sf_dir).select(*sums.keys, *sums.sums, of_batch)
    full.write.partitionBy("_batch").parquet(path)
    made = spark.read.schema(full.schema).parquet(path)
    for n in (0, 1, 1, 2):
        sums.add(made.filter(F.col("_batch") == n), n)
    fs, of = topics.file_system(spark, path)
    fs.delete(of(path), True)
    return dashboard.seller(sums.read()).select("name", F.col("value").cast("double").alias("value"))


@query("SELECT r_regionkey AS rRegionkey, r_name AS rName FROM region")
def camel_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.camel(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@query("""WITH info AS (SELECT o_orderkey AS id, c_nationkey AS province_id, o_orderdate AS et FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
SELECT CAST(province_id AS BIGINT) AS province_id, CAST(count(*) AS BIGINT) AS order_count, CAST(sum(CAST(l_extendedprice AS DECIMAL(16,2))) AS DOUBLE) AS order_amount FROM info JOIN lineitem ON id = l_orderkey AND l_shipdate BETWEEN et - INTERVAL 30 DAY AND et + INTERVAL 30 DAY GROUP BY 1""")
def province_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of the wide table as one of the province statistics, summed up."""
    wide = wide_rows(spark, sf_dir).withColumns({c: F.lit(None).cast("string") for c in ("province_name", "province_area_code", "province_iso_code", "province_3166_2_code")})
    return stats.province_rows(wide).groupBy("province_id").agg(F.sum("order_count").alias("order_count"), F.sum("order_amount").cast("double").alias("order_amount"))
