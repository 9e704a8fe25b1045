"""Queries over the driver's tables, and the SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import columns as C
from .functions import segment
from .operators import changes as feed
from .operators import joins, lateness, logs, parse, pattern, reshape, route, visits, windows
from .plans import dashboard, stats, wide
from .registry import QUERIES, SQL, query, table
from .schemas import DEBEZIUM, GOOD_APPRAISE

__all__ = ["QUERIES", "SQL"]


def money(x: Column) -> Column:
    return x.cast("decimal(16,2)")


def double(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


# The tables in the roles of the jobs: events are the page log, orders and lineitem the orders, part, nation and customer
# the dimensions. Durations are longer than the jobs' defaults, as these tables are sparser in time.
PROPS = "k bigint"
K_SQL = "CAST(json_extract(props, '$.k') AS BIGINT)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page log: common, page and displays parts, ts in milliseconds, and event_id as the arrival order."""
    k = F.from_json("props", PROPS)["k"]
    e = table(spark, sf_dir, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), "user_id", "event_type", "value", k.alias("k"))
    common = F.struct(*((F.col("k") % n).cast("string").alias(c) for c, n in (("ar", 5), ("ch", 3), ("is_new", 2), ("vc", 4))), F.col("user_id").cast("string").alias("mid"))
    goods = F.col("event_type") == "view"
    page = F.struct(
        F.floor("value").alias("during_time"), F.when(goods, F.col("k").cast("string")).alias("item"), F.when(goods, "sku_id").alias("item_type"),
        F.when(F.col("event_type") != "signup", "home").alias("last_page_id"), F.when(goods, "good_detail").otherwise(F.col("event_type")).alias("page_id"),
    )
    display = F.transform(F.sequence(F.lit(1), (F.col("event_id") % 4).cast("int")), lambda i: F.struct((F.col("k") + i).cast("string").alias("item"), F.when(i == 2, "activity").otherwise("sku_id").alias("item_type"), i.alias("order")))
    shown = F.when(F.col("event_id") % 4 > 0, display)
    start = F.when(F.col("event_type") == "error", F.create_map(F.lit("entry"), F.lit("icon")))
    return e.select("event_id", "ts", F.timestamp_millis("ts").alias("et"), common.alias("common"), page.alias("page"), shown.alias("displays"), start.alias("start"))


P_SQL = f"""WITH e AS (SELECT *, {K_SQL} AS k, (epoch_us(ts) // 1000) AS ms FROM events),
p AS (SELECT event_id, ms, ts, user_id, CAST(k % 5 AS VARCHAR) AS ar, CAST(k % 3 AS VARCHAR) AS ch, CAST(k % 2 AS VARCHAR) AS is_new, CAST(k % 4 AS VARCHAR) AS vc, k, event_type,
  CAST(floor(value) AS BIGINT) AS dur, event_type = 'signup' AS entry FROM e)"""


def infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    none = F.lit(None).cast("decimal(16,2)")
    rows = o.join(c, o.o_custkey == c.c_custkey, "left").select(
        F.col("o_orderkey").alias("id"), F.col("c_nationkey").cast("long").alias("province_id"), F.col("o_orderstatus").alias("order_status"), F.col("o_custkey").alias("user_id"),
        money(F.col("o_totalprice")).alias("total_amount"), none.alias("activity_reduce_amount"), none.alias("coupon_reduce_amount"), none.alias("original_total_amount"), none.alias("feight_fee"),
        F.date_format("o_orderdate", C.STAMP).alias("create_time"),
    )
    return wide.with_times(rows)


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("decimal(16,2)")
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku_id"), money(F.col("l_extendedprice")).alias("order_price"),
        F.col("l_quantity").cast("long").alias("sku_num"), F.lit(None).cast("string").alias("sku_name"), F.date_format("l_shipdate", C.STAMP).alias("create_time"),
        money(F.col("l_extendedprice")).alias("split_total_amount"), none.alias("split_activity_amount"), none.alias("split_coupon_amount"),
    )
    return wide.with_times(rows)


def dims(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part, nation, region = (table(spark, sf_dir, x) for x in ("part", "nation", "region"))
    return {
        "user": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("19"), F.lpad((F.col("c_custkey") % 90 + 10).cast("string"), 2, "0"), F.lit("-03-01")).alias("birthday"), F.col("c_mktsegment").alias("gender")),
        "province": nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("area_code"), F.concat(F.lit("CN-"), "n_nationkey").alias("iso_code"), F.concat(F.lit("ISO-"), "n_nationkey").alias("iso_3166_2")),
        "sku": part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("sku_name"), F.col("p_retailprice").alias("price"), F.col("p_type").alias("category3_id"), F.col("p_size").alias("spu_id"), F.col("p_brand").alias("tm_id")),
        "spu": part.select(F.col("p_size").alias("id")).distinct().withColumn("spu_name", F.concat(F.lit("Product number "), "id")),
        "trademark": part.select(F.col("p_brand").alias("id")).distinct().withColumn("tm_name", F.concat(F.lit("TM "), "id")),
        "category3": part.select(F.col("p_type").alias("id")).distinct().withColumn("name", F.concat(F.lit("C "), "id")),
    }


SPAN = "30 days"
WIDE_SQL = """WITH info AS (SELECT o_orderkey AS id, c_nationkey AS province_id, o_orderstatus AS order_status, o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(16,2)) AS total_amount, o_orderdate AS et FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
detail AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id, l_partkey AS sku_id, CAST(l_extendedprice AS DECIMAL(16,2)) AS split_total_amount, CAST(l_quantity AS BIGINT) AS sku_num, l_shipdate AS dt FROM lineitem),
wide AS (SELECT d.id AS detail_id, d.order_id, sku_id, sku_num, split_total_amount, province_id, order_status, user_id, total_amount, et FROM info i JOIN detail d ON i.id = d.order_id AND d.dt BETWEEN i.et - INTERVAL 30 DAY AND i.et + INTERVAL 30 DAY)"""


def wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.order_wide(infos(spark, sf_dir), details(spark, sf_dir), SPAN, SPAN)


@query(f"SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE {K_SQL} END AS k, event_id % 7 = 0 AS dirty FROM events")
def parse_dirty_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "{bad").otherwise(F.col("props")).alias("value"))
    good, dirty = parse.parse(raw, PROPS)
    return good.select("event_id", "k", F.lit(False).alias("dirty")).unionByName(dirty.select("event_id", F.lit(None).cast("long").alias("k"), F.lit(True).alias("dirty")))


@query("""SELECT split_part('mysql.shop.' || CASE WHEN o_orderkey % 2 = 0 THEN 'orders' ELSE 'refunds' END, '.', 3) AS table_name, CASE o_orderkey % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'read' END AS type,
count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 4 <> 2 THEN o_orderkey ELSE 0 END) AS BIGINT) AS after_ids FROM orders GROUP BY 1, 2""")
def cdc_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    op = F.element_at(F.array(*map(F.lit, ("c", "u", "d", "r"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    image = F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"))
    raw = o.select(F.to_json(F.struct(F.concat(F.lit("mysql.shop."), F.when(F.col("o_orderkey") % 2 == 0, "orders").otherwise("refunds")).alias("topic"), F.when(F.col("o_orderkey") % 4 != 0, image).alias("before"), F.when(F.col("o_orderkey") % 4 != 2, image).alias("after"), op.alias("op"))).alias("value"))
    events = parse.change_events(parse.parse_strict(raw, DEBEZIUM))
    return events.groupBy(F.col("tableName").alias("table_name"), "type").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("after")["id"].cast("long")), F.lit(0)).alias("after_ids"))


@query("SELECT event_id, page_id, item, item_type, CAST(i AS INT) AS position FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN 'good_detail' ELSE event_type END AS page_id, unnest(range(1, event_id % 4 + 1)) AS i, " + K_SQL + " AS k, event_type FROM events), LATERAL (SELECT CAST(k + i AS VARCHAR) AS item, CASE WHEN i = 2 THEN 'activity' ELSE 'sku_id' END AS item_type) WHERE event_type <> 'error'")
def log_split_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).withColumn("displays", F.transform("displays", lambda d: d.withField("event_id", F.col("event_id"))))
    shown = logs.split_log(rows)["display"]
    return shown.select("event_id", "page_id", "item", "item_type", F.col("order").alias("position"))


@query(P_SQL + """ SELECT sku_id, ts, CAST(sum(click_ct) AS BIGINT) AS click_ct, CAST(sum(display_ct) AS BIGINT) AS display_ct FROM (
SELECT k AS sku_id, ms AS ts, 1 AS click_ct, 0 AS display_ct FROM p WHERE event_type = 'view' UNION ALL
SELECT k + i, ms, 0, 1 FROM (SELECT k, ms, unnest(range(1, event_id % 4 + 1)) AS i FROM p WHERE event_type <> 'error') WHERE i <> 2) GROUP BY 1, 2""")
def click_display_flatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.clicks_and_displays(logs.split_log(pages(spark, sf_dir))["page"])
    return rows.groupBy("sku_id", "ts").agg(F.sum("click_ct").alias("click_ct"), F.sum("display_ct").alias("display_ct"))


ROUTES = [
    ("orders", "insert", "hbase", "old_orders", "id", None, None, 1),
    ("orders", "insert", "kafka", "dwd_orders", "id,status", None, None, 2),
    ("customer", "insert", "hbase", "dim_customer", "id,name", "id", "", 1),
    ("part", "insert", "clickhouse", "ignored", "id", None, None, 1),
]


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def image(df: DataFrame, of: str, kind: Column, /, **cols: str) -> DataFrame:
        return df.select(F.lit("shop").alias("database"), F.lit(of).alias("tableName"), F.create_map(*(x for k, c in cols.items() for x in (F.lit(k), F.col(c).cast("string")))).alias("after"), kind.alias("type"))

    o = image(table(spark, sf_dir, "orders"), "orders", F.when(F.col("o_orderkey") % 5 == 0, "delete").otherwise("insert"), id="o_orderkey", status="o_orderstatus", priority="o_orderpriority")
    c = image(table(spark, sf_dir, "customer"), "customer", F.lit("insert"), id="c_custkey", name="c_name", segment="c_mktsegment")
    p = image(table(spark, sf_dir, "part"), "part", F.lit("insert"), id="p_partkey")
    return o.unionByName(c).unionByName(p)


@query("""SELECT 'kafka' AS sink_type, 'dwd_orders' AS sink_table, o_orderkey AS id, '{"id":"' || o_orderkey || '","status":"' || o_orderstatus || '"}' AS payload FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT 'hbase', 'dim_customer', c_custkey, '{"id":"' || c_custkey || '","name":"' || c_name || '"}' FROM customer""")
def cdc_filter_project_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = spark.createDataFrame(ROUTES, "sourceTable string, operateType string, sinkType string, sinkTable string, sinkColumns string, sinkPk string, sinkExtend string, seq int")
    parts = route.split_routed(route.route(changes(spark, sf_dir), route.current_routes(config, "seq")))
    both = parts["dim"].unionByName(parts["fact"])
    return both.select(F.col("sinkType").alias("sink_type"), F.col("sinkTable").alias("sink_table"), F.col("after")["id"].cast("long").alias("id"), F.to_json("after").alias("payload"))


CONFIG_SQL = """c AS (SELECT ['F','O','P','X'][n_nationkey % 4 + 1] AS t, epoch_ms(TIMESTAMP '1992-01-01 00:00:00' + INTERVAL 1 DAY * (n_nationkey * 90)) + 1 AS since, CASE WHEN n_nationkey % 6 <> 5 THEN 'dwd_' || n_name END AS sink FROM nation),
v AS (SELECT *, lead(since) OVER (PARTITION BY t ORDER BY since) AS until FROM c), f AS (SELECT t, min(since) AS first FROM c GROUP BY t),
o AS (SELECT o_orderkey, o_orderstatus, epoch_ms(o_orderdate) AS ms, CASE WHEN o_orderkey % 10 = 0 THEN 'update' ELSE 'insert' END AS type FROM orders)"""


@query(f"""WITH {CONFIG_SQL} SELECT status, sink_table, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM (
SELECT o_orderkey, sink AS sink_table, CASE WHEN sink IS NOT NULL THEN 'routed' WHEN v.t IS NOT NULL THEN 'ended' WHEN f.t IS NOT NULL THEN 'early' ELSE 'none' END AS status
FROM o LEFT JOIN v ON v.t = o_orderstatus AND type = 'insert' AND ms >= since AND (until IS NULL OR ms < until) LEFT JOIN f ON f.t = o_orderstatus AND type = 'insert') GROUP BY ALL""")
def cdc_route_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the configuration of their time, whose changes are the nations': each says where a table goes from then on."""
    n = table(spark, sf_dir, "nation")
    at = F.unix_millis(F.to_timestamp(F.lit("1992-01-01")) + F.make_dt_interval(days=(F.col("n_nationkey") * 90).cast("int"))) + 1
    key = (F.lit("sourceTable"), F.element_at(F.array(*map(F.lit, "FOPX")), (F.col("n_nationkey") % 4 + 1).cast("int")), F.lit("operateType"), F.lit("insert"))
    says = (x for k, v in (("sinkType", F.lit("kafka")), ("sinkTable", F.concat(F.lit("dwd_"), "n_name")), ("sinkColumns", F.lit("id"))) for x in (F.lit(k), v))
    ends, none = F.col("n_nationkey") % 6 == 5, F.create_map().cast("map<string,string>")
    config = n.select(F.when(ends, F.create_map(*key)).otherwise(none).alias("before"), F.when(ends, none).otherwise(F.create_map(*key, *says)).alias("after"), F.when(ends, "delete").otherwise("insert").alias("type"), at.alias("ts_ms"))
    history = route.route_history(route.route_changes(config, F.struct("ts_ms")))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("tableName"), F.create_map(F.lit("id"), F.col("o_orderkey").cast("string")).alias("after"), F.when(F.col("o_orderkey") % 10 == 0, "update").otherwise("insert").alias("type"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"))
    met = route.route_at(o, history, F.struct("ts_ms"))
    return met.groupBy("status", F.col("sinkTable").alias("sink_table")).agg(F.count("*").alias("n"), F.sum(F.col("after")["id"].cast("long")).alias("ids"))


@query("""WITH h AS (SELECT user_id, img, lag(img) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM (SELECT user_id, ts, event_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS img FROM events))
SELECT is_add, user_id, event_type, count(*) AS n FROM (SELECT FALSE AS is_add, user_id, old AS event_type FROM h WHERE old IS NOT NULL AND old IS DISTINCT FROM img
UNION ALL SELECT TRUE, user_id, img FROM h WHERE img IS NOT NULL AND old IS DISTINCT FROM img) GROUP BY ALL""")
def cdc_retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's row is its last event's type: what each event retracts and adds, from a feed without before images."""
    key, none = (F.lit("user_id"), F.col("user_id").cast("string")), F.create_map().cast("map<string,string>")
    gone = F.col("event_id") % 7 == 0
    after = F.when(gone, F.create_map(*key)).otherwise(F.create_map(*key, F.lit("event_type"), F.col("event_type")))
    events = table(spark, sf_dir, "events").select(none.alias("before"), after.alias("after"), F.when(gone, "delete").otherwise("update").alias("type"), "ts", "event_id")
    rows = feed.retractions(events, ["user_id"], ["ts", "event_id"], T.StructType().add("user_id", "long").add("event_type", "string"))
    return rows.groupBy("is_add", "user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def dim_latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.latest_by_key(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query(P_SQL + " SELECT event_id, CASE WHEN is_new = '1' AND row_number() OVER (PARTITION BY user_id, is_new ORDER BY ms, event_id) > 2 THEN '0' ELSE is_new END AS is_new FROM p")
def is_new_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).select("event_id", "ts", "common.mid", "common.is_new")
    return visits.repair_is_new(rows, "mid", "is_new", ["ts", "event_id"]).select("event_id", "is_new")


@query(P_SQL + " SELECT event_id, user_id, day FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day, lag(strftime(ts, '%Y-%m-%d')) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS before FROM p WHERE entry) WHERE before IS NULL OR before <> day")
def unique_visit_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = pages(spark, sf_dir).filter(C.is_entry(F.col("page.last_page_id"))).withColumn("mid", F.col("common.mid"))
    return visits.unique_visits(entries, "mid", C.day(F.col("ts")), ["ts", "event_id"]).select("event_id", F.col("mid").cast("long").alias("user_id"), C.day(F.col("ts")).alias("day"))


BOUNCE_SQL = "SELECT * FROM (SELECT *, lead(ts) OVER w AS nt, lead(entry) OVER w AS ne FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)) WHERE entry AND (nt IS NULL OR ne OR nt >= ts + INTERVAL 6 HOUR)"


def bounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).withColumn("mid", F.col("common.mid"))
    return visits.bounces(rows, "mid", C.is_entry(F.col("page.last_page_id")), "et", ["ts", "event_id"], "6 hours")


@query(f"{P_SQL} SELECT event_id, user_id, ms AS ts FROM ({BOUNCE_SQL})")
def bounce_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounced(spark, sf_dir).select("event_id", F.col("mid").cast("long").alias("user_id"), "ts")


@query(f"{P_SQL} SELECT event_id, user_id, ms AS ts FROM ({BOUNCE_SQL})")
def bounce_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounces as a pattern: an entry page, right after it another one, or nothing in time."""
    entry = pattern.Step(C.is_entry(F.col("page.last_page_id")))
    found = pattern.match(pages(spark, sf_dir).withColumn("mid", F.col("common.mid")), "mid", "et", ["ts", "event_id"], [entry, entry], 6 * 3600 * 1000, ["event_id", "ts"])
    return found.select(F.col("rows")[0]["event_id"].alias("event_id"), F.col("mid").cast("long").alias("user_id"), F.col("rows")[0]["ts"].alias("ts"))


@query(P_SQL + """, n AS (SELECT event_id, user_id, event_type, ms, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS buy, first_value(CASE WHEN event_type = 'purchase' THEN ms END IGNORE NULLS) OVER w AS buy_ms FROM p
WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id AS view_id, coalesce(buy_ms - ms < 86400000, FALSE) AS matched, CASE WHEN buy_ms - ms < 86400000 THEN buy END AS purchase_id FROM n WHERE event_type = 'view'""")
def view_to_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that a purchase follows within a day, whatever stands between, and those that run out of time."""
    e = table(spark, sf_dir, "events").withColumn("et", F.col("ts").cast("timestamp"))
    steps = [pattern.Step(F.col("event_type") == "view"), pattern.Step(F.col("event_type") == "purchase", strict=False)]
    found = pattern.match(e.withColumn("ms", F.unix_millis("et")), "user_id", "et", ["ms", "event_id"], steps, 86_400_000, ["event_id"])
    return found.select("user_id", F.col("rows")[0]["event_id"].alias("view_id"), "matched", F.get("rows", F.lit(1))["event_id"].alias("purchase_id"))


@query("""SELECT late, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT event_id, coalesce(make_timestamp((epoch_us(ts) // 3600000000 + 1) * 3600000000) <= max(ts) OVER (ORDER BY k, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY, FALSE) AS late
FROM (SELECT event_id, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)) GROUP BY late""")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come in another order than that of their times: which are late for their hour by a watermark of a day."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("et"), (F.from_json("props", PROPS)["k"] * 10_000_000_000 + F.col("event_id")).alias("offset"))
    good, late = lateness.split_late(e, "et", "offset", "1 hour", "1 day")
    both = good.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.groupBy("late").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("""WITH t AS (SELECT p_partkey, replace(lower(p_name), ' ', '') AS x FROM part), w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) UNION SELECT DISTINCT substr(w, 1, 3) FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part))
SELECT w AS keyword, count(*) AS ct FROM (SELECT x, unnest(range(1, length(x) + 1)) AS i FROM t) p JOIN w ON length(w) > 0 AND substr(x, i, length(w)) = w GROUP BY w""")
def lexicon_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts without their spaces, cut by a lexicon of their words and those words' first three letters."""
    part = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name"))
    word = part.select(F.explode(F.split("name", " ")).alias("w")).distinct()
    cut = segment.lexicon_words(word.unionByName(word.select(F.substring("w", 1, 3).alias("w"))))
    return part.select(F.explode(cut(F.replace("name", F.lit(" "), F.lit("")))).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("ct"))


@query(WIDE_SQL + " SELECT detail_id, order_id, sku_id, sku_num, CAST(split_total_amount AS DOUBLE) AS split_total_amount, CAST(province_id AS BIGINT) AS province_id, user_id, CAST(total_amount AS DOUBLE) AS total_amount, strftime(et, '%Y-%m-%d') AS create_date, strftime(et, '%H') AS create_hour FROM wide")
def order_wide_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_rows(spark, sf_dir).select("detail_id", "order_id", "sku_id", "sku_num", double("split_total_amount").alias("split_total_amount"), "province_id", "user_id", double("total_amount").alias("total_amount"), "create_date", "create_hour")


@query(WIDE_SQL + """ SELECT detail_id, n_name AS province_name, r_name AS province_area_code, 'CN-' || province_id AS province_iso_code, p_name AS sku_name, CAST(p_size AS VARCHAR) AS spu_id, p_brand AS tm_id, 'Product number ' || p_size AS spu_name,
'TM ' || p_brand AS tm_name, 'C ' || p_type AS category3_name, c_mktsegment AS user_gender, CAST(floor(date_diff('day', CAST('19' || (c_custkey % 90 + 10) || '-03-01' AS DATE), DATE '2024-06-01') / 365) AS INT) AS user_age
FROM wide LEFT JOIN nation ON n_nationkey = province_id LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN part ON p_partkey = sku_id LEFT JOIN customer ON c_custkey = user_id""")
def order_wide_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wide.with_dims(wide_rows(spark, sf_dir), dims(spark, sf_dir), as_of="2024-06-01 00:00:00")
    return rows.select("detail_id", "province_name", "province_area_code", "province_iso_code", "sku_name", F.col("spu_id").cast("string").alias("spu_id"), "tm_id", "spu_name", "tm_name", "category3_name", "user_gender", "user_age")


PAY_SQL = WIDE_SQL + ", pay AS (SELECT o_orderkey AS pid, o_orderkey AS oid, o_custkey AS uid, CAST(o_totalprice AS DECIMAL(16,2)) AS amount, o_orderdate + to_minutes(CAST(o_orderkey % 30 AS INT)) AS pt FROM orders WHERE o_orderstatus = 'F')"
PAY_OUT = " SELECT pid AS payment_id, order_id, detail_id, uid AS user_id, CAST(amount AS DOUBLE) AS total_amount, CAST(split_total_amount AS DOUBLE) AS split_total_amount FROM pay JOIN wide ON order_id = oid AND "


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 30).cast("int"))
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), money(F.col("o_totalprice")).alias("total_amount"), F.lit("goods").alias("subject"), F.lit("1101").alias("payment_type"),
        F.date_format(at, C.STAMP).alias("create_time"), F.date_format(at, C.STAMP).alias("callback_time"),
    )
    return wide.with_times(rows)


def payment_rows(spark: SparkSession, sf_dir: str, same_day: bool) -> DataFrame:
    rows = wide.payment_wide(payments(spark, sf_dir), wide_rows(spark, sf_dir), same_day=same_day)
    return rows.select("payment_id", "order_id", "detail_id", "user_id", double("total_amount").alias("total_amount"), double("split_total_amount").alias("split_total_amount"))


@query(PAY_SQL + PAY_OUT + "et BETWEEN pt - INTERVAL 15 MINUTE AND pt + INTERVAL 5 SECOND")
def payment_wide_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payment_rows(spark, sf_dir, False)


@query(PAY_SQL + PAY_OUT + "CAST(et AS DATE) = CAST(pt AS DATE)")
def payment_wide_compat_same_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payment_rows(spark, sf_dir, True)


def visitor_source(spark: SparkSession, sf_dir: str, compat: bool = False) -> DataFrame:
    log = pages(spark, sf_dir)
    entries = log.filter(C.is_entry(F.col("page.last_page_id"))).withColumn("mid", F.col("common.mid"))
    return stats.visitor_rows(log, visits.unique_visits(entries, "mid", C.day(F.col("ts")), ["ts", "event_id"]), bounced(spark, sf_dir), compat)


def visitor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.visitor_stats(visitor_source(spark, sf_dir), "1 hour")


def visitor_sql(compat: int) -> str:
    return f"""{P_SQL}, uv AS (SELECT * FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day, lag(strftime(ts, '%Y-%m-%d')) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS before FROM p WHERE entry) WHERE before IS NULL OR before <> day),
uj AS ({BOUNCE_SQL}), v AS (SELECT vc, ch, ar, is_new, ms, 1 AS uv_ct, 0 AS pv_ct, 0 AS sv_ct, 0 AS uj_ct, 0 AS dur_sum FROM uv UNION ALL SELECT vc, ch, ar, is_new, ms, 0, 0, 0, 1, 0 FROM uj
UNION ALL SELECT vc, ch, ar, is_new, ms, 0, 1, CAST(entry AS INT), {compat}, dur FROM p),
visitor_stats AS (SELECT strftime(make_timestamp(ms // 3600000 * 3600000000), '%Y-%m-%d %H:%M:%S') AS stt, strftime(make_timestamp((ms // 3600000 + 1) * 3600000000), '%Y-%m-%d %H:%M:%S') AS edt, vc, ch, ar, is_new,
CAST(sum(uv_ct) AS BIGINT) AS uv_ct, CAST(sum(pv_ct) AS BIGINT) AS pv_ct, CAST(sum(sv_ct) AS BIGINT) AS sv_ct, CAST(sum(uj_ct) AS BIGINT) AS uj_ct, CAST(sum(dur_sum) AS BIGINT) AS dur_sum, min(ms) AS ts FROM v GROUP BY ALL)"""


VISITOR_GROUP = visitor_sql(0).replace("GROUP BY ALL", "GROUP BY ms // 3600000, vc, ch, ar, is_new")


@query(VISITOR_GROUP + " SELECT * FROM visitor_stats")
def visitor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visitor_table(spark, sf_dir)


@query(visitor_sql(1).replace("GROUP BY ALL", "GROUP BY ms // 3600000, vc, ch, ar, is_new") + " SELECT * FROM visitor_stats")
def visitor_stats_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.visitor_stats(visitor_source(spark, sf_dir, True), "1 hour")


def product_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven sources from these tables: views and displays are clicks, favourites, carts, comments are events by type."""
    log = logs.split_log(pages(spark, sf_dir))["page"]
    e = table(spark, sf_dir, "events").select((F.from_json("props", PROPS)["k"] + 1).alias("sku_id"), F.date_format("ts", C.STAMP).alias("create_time"), "event_type", "event_id")
    line = table(spark, sf_dir, "lineitem")
    order = wide_rows(spark, sf_dir)
    pay = order.filter("order_status = 'F'").withColumn("payment_create_time", F.col("create_time"))
    refund = line.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("sku_id"), F.date_format("l_shipdate", C.STAMP).alias("create_time"), money(F.col("l_extendedprice")).alias("refund_amount"), F.col("l_orderkey").alias("order_id"))
    comment = e.filter("event_type = 'purchase'").withColumn("appraise", F.when(F.col("event_id") % 2 == 0, GOOD_APPRAISE).otherwise("1203"))
    return stats.product_sources(logs.clicks_and_displays(log), e.filter("event_type = 'signup'"), e.filter("event_type = 'click'"), order, pay, refund, comment)


def product_sql(compat: bool) -> str:
    ids = ("CASE WHEN count(*) = 1 THEN 0 ELSE count(DISTINCT {}) END" if compat else "count(DISTINCT {})").format
    return f"""{WIDE_SQL}, e AS (SELECT *, {K_SQL} AS k, (epoch_us(ts) // 1000) AS ms FROM events),
x AS (SELECT k AS sku_id, ms, 0 AS display_ct, 1 AS click_ct, 0 AS favor_ct, 0 AS cart_ct, 0 AS order_sku_num, CAST(0 AS DECIMAL(16,2)) AS order_amount, CAST(0 AS DECIMAL(16,2)) AS payment_amount, CAST(0 AS DECIMAL(16,2)) AS refund_amount, 0 AS comment_ct, 0 AS good_comment_ct, NULL AS oid, NULL AS pid, NULL AS rid FROM e WHERE event_type = 'view'
UNION ALL SELECT k + i, ms, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, NULL, NULL, NULL FROM (SELECT k, ms, unnest(range(1, event_id % 4 + 1)) AS i FROM e WHERE event_type <> 'error') WHERE i <> 2
UNION ALL SELECT k + 1, ms // 1000 * 1000, 0, 0, CAST(event_type = 'signup' AS INT), CAST(event_type = 'click' AS INT), 0, 0, 0, 0, CAST(event_type = 'purchase' AS INT), CAST(event_type = 'purchase' AND event_id % 2 = 0 AS INT), NULL, NULL, NULL FROM e WHERE event_type IN ('signup', 'click', 'purchase')
UNION ALL SELECT sku_id, (epoch_us(et) // 1000), 0, 0, 0, 0, sku_num, total_amount, 0, 0, 0, 0, order_id, NULL, NULL FROM wide
UNION ALL SELECT sku_id, (epoch_us(et) // 1000), 0, 0, 0, 0, 0, 0, split_total_amount, 0, 0, 0, NULL, order_id, NULL FROM wide WHERE order_status = 'F'
UNION ALL SELECT l_partkey, (epoch_us(l_shipdate) // 1000), 0, 0, 0, 0, 0, 0, 0, CAST(l_extendedprice AS DECIMAL(16,2)), 0, 0, NULL, NULL, l_orderkey FROM lineitem WHERE l_returnflag = 'R'),
product_stats AS (SELECT strftime(make_timestamp(ms // 86400000 * 86400000000), '%Y-%m-%d %H:%M:%S') AS stt, sku_id, CAST(sum(display_ct) AS BIGINT) AS display_ct, CAST(sum(click_ct) AS BIGINT) AS click_ct, CAST(sum(favor_ct) AS BIGINT) AS favor_ct, CAST(sum(cart_ct) AS BIGINT) AS cart_ct,
CAST(sum(order_sku_num) AS BIGINT) AS order_sku_num, CAST(sum(order_amount) AS DOUBLE) AS order_amount, CAST(sum(payment_amount) AS DOUBLE) AS payment_amount, CAST(sum(refund_amount) AS DOUBLE) AS refund_amount, CAST(sum(comment_ct) AS BIGINT) AS comment_ct, CAST(sum(good_comment_ct) AS BIGINT) AS good_comment_ct,
{ids('oid')} AS order_ct, {ids('pid')} AS paid_order_ct, {ids('rid')} AS refund_order_ct FROM x GROUP BY ms // 86400000, sku_id)"""


PRODUCT_OUT = ["stt", "sku_id", "display_ct", "click_ct", "favor_ct", "cart_ct", "order_sku_num", "order_amount", "payment_amount", "refund_amount", "comment_ct", "good_comment_ct", "order_ct", "paid_order_ct", "refund_order_ct"]


def product_table(spark: SparkSession, sf_dir: str, compat: bool = False) -> DataFrame:
    return stats.product_stats(product_source(spark, sf_dir), "1 day", compat=compat)


def product_out(rows: DataFrame) -> DataFrame:
    return rows.select(*(double(c).alias(c) if c.endswith("amount") else c for c in PRODUCT_OUT))


@query(product_sql(False) + " SELECT * FROM product_stats")
def product_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_out(product_table(spark, sf_dir))


@query(product_sql(True) + " SELECT * FROM product_stats")
def product_stats_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_out(product_table(spark, sf_dir, True))


def product_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dims(spark, sf_dir)
    return stats.product_dims(product_table(spark, sf_dir), d["sku"], d["spu"], d["category3"], d["trademark"])


FULL_SQL = product_sql(False) + ", full_stats AS (SELECT s.*, p_name AS sku_name, p_retailprice AS sku_price, p_size AS spu_id, 'Product number ' || p_size AS spu_name, p_brand AS tm_id, 'TM ' || p_brand AS tm_name, p_type AS category3_id, 'C ' || p_type AS category3_name FROM product_stats s LEFT JOIN part ON p_partkey = sku_id)"


@query(FULL_SQL + " SELECT stt, sku_id, sku_name, sku_price, spu_name, tm_name, category3_name, order_ct, order_amount FROM full_stats")
def product_stats_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_full(spark, sf_dir).select("stt", "sku_id", "sku_name", "sku_price", "spu_name", "tm_name", "category3_name", "order_ct", double("order_amount").alias("order_amount"))


def province_table(spark: SparkSession, sf_dir: str, compat: bool = False) -> DataFrame:
    rows = wide.with_dims(wide_rows(spark, sf_dir), {"province": dims(spark, sf_dir)["province"]})
    return stats.province_stats(spark, rows, "10 days", compat=compat, ts=F.lit(0).cast("long"))


def province_sql(kind: str) -> str:
    return WIDE_SQL + f""", province_stats AS (SELECT strftime(make_timestamp((epoch_us(et) // 1000) // 864000000 * 864000000000), '%Y-%m-%d %H:%M:%S') AS stt, strftime(make_timestamp(((epoch_us(et) // 1000) // 864000000 + 1) * 864000000000), '%Y-%m-%d %H:%M:%S') AS edt, CAST(province_id AS BIGINT) AS province_id, n_name AS province_name, r_name AS province_area_code,
'CN-' || province_id AS province_iso_code, 'ISO-' || province_id AS province_3166_2_code, CAST(sum({kind}) AS DOUBLE) AS order_amount, count(DISTINCT order_id) AS order_count, CAST(0 AS BIGINT) AS ts
FROM wide LEFT JOIN nation ON n_nationkey = province_id LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY (epoch_us(et) // 1000) // 864000000, province_id, n_name, r_name)"""


@query(province_sql("split_total_amount") + " SELECT * FROM province_stats")
def province_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return province_table(spark, sf_dir).withColumn("order_amount", double("order_amount"))


@query(province_sql("CAST(split_total_amount AS DECIMAL(10,0))") + " SELECT * FROM province_stats")
def province_stats_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return province_table(spark, sf_dir, True).withColumn("order_amount", double("order_amount"))


WORDS_SQL = "SELECT word, 'SEARCH' AS source, turn FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word, turn FROM conversations)"


@query(P_SQL + " SELECT event_id, CAST(k AS VARCHAR) AS fullword, ms FROM p WHERE event_type = 'view' AND event_id % 3 = 0")
def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page is reached from the search page; only goods have an item."""
    found = F.when(F.col("event_id") % 3 == 0, "search").otherwise(F.col("page.last_page_id"))
    rows = pages(spark, sf_dir).withColumn("page", F.col("page").withField("last_page_id", found))
    return stats.searches(rows, "event_id").select("event_id", "fullword", F.unix_millis("et").alias("ms"))


def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as searches, an hour apart."""
    return table(spark, sf_dir, "conversations").select(F.col("text").alias("fullword"), F.timestamp_seconds(F.col("turn") * 3600).alias("et"))


@query(f"SELECT word AS keyword, count(*) AS ct, source, strftime(make_timestamp(turn * 3600000000), '%Y-%m-%d %H:%M:%S') AS stt, strftime(make_timestamp((turn + 1) * 3600000000), '%Y-%m-%d %H:%M:%S') AS edt, CAST(0 AS BIGINT) AS ts FROM ({WORDS_SQL}) GROUP BY word, source, turn")
def keyword_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.keyword_stats(spark, search_rows(spark, sf_dir), size="1 hour", ts=F.lit(0).cast("long"))


@query(product_sql(False) + " SELECT CAST(sum(CAST(order_amount AS DECIMAL(18,2))) AS DOUBLE) AS order_amount FROM product_stats")
def dash_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.count(product_table(spark, sf_dir)).select(double("order_amount").alias("order_amount"))


@query(FULL_SQL + " SELECT tm_name AS name, CAST(sum(CAST(order_amount AS DECIMAL(18,2))) AS DOUBLE) AS value FROM full_stats GROUP BY tm_id, tm_name HAVING sum(order_amount) > 0")
def dash_seller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.seller(product_full(spark, sf_dir)).select("name", double("value").alias("value"))


@query(FULL_SQL + " SELECT category3_name, spu_name, sku_name, CAST(sum(order_ct) AS BIGINT) AS value FROM full_stats GROUP BY ALL")
def dash_hot_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.hot_flat(product_full(spark, sf_dir))


@query(FULL_SQL + """, k AS (SELECT category3_name, spu_name, sku_name, CAST(sum(order_ct) AS BIGINT) AS value FROM full_stats GROUP BY ALL), s AS (SELECT category3_name, spu_name, CAST(sum(value) AS BIGINT) AS value, count(*) AS skus FROM k GROUP BY ALL)
SELECT category3_name AS name, count(*) AS spus, CAST(sum(value) AS BIGINT) AS value, CAST(sum(skus) AS BIGINT) AS skus FROM s GROUP BY 1""")
def dash_hot_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = dashboard.hot(product_full(spark, sf_dir))
    return tree.select("name", F.size("children").cast("long").alias("spus"), F.aggregate("children", F.lit(0).cast("long"), lambda a, x: a + x["value"]).alias("value"), F.aggregate("children", F.lit(0).cast("long"), lambda a, x: a + F.size(x["children"])).alias("skus"))


@query(FULL_SQL + """, k AS (SELECT category3_name, spu_name, sku_name, CAST(sum(order_ct) AS BIGINT) AS value FROM full_stats GROUP BY ALL),
s AS (SELECT category3_name, spu_name, CAST(sum(value) AS BIGINT) AS value, list({'sku_name': sku_name, 'value': value} ORDER BY sku_name) AS children FROM k GROUP BY ALL)
SELECT category3_name AS name, CAST(to_json(list({'name': spu_name, 'value': value, 'children': children} ORDER BY spu_name)) AS VARCHAR) AS children FROM s GROUP BY category3_name""")
def dash_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.documents(dashboard.hot(product_full(spark, sf_dir)))


@query(FULL_SQL + " SELECT CASE WHEN length(spu_name) > 15 THEN split_part(spu_name, ' ', 1) ELSE spu_name END AS name, CAST(sum(comment_ct) AS BIGINT) AS stock, CAST(sum(good_comment_ct) AS BIGINT) AS sales FROM full_stats GROUP BY spu_id, spu_name")
def dash_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.stock(product_full(spark, sf_dir))


def city_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provinces that nations' names begin with, and three cities each."""
    n = table(spark, sf_dir, "nation")
    city = [F.struct(F.concat(F.col("n_name"), F.lit(f"-{i}")).alias("cname"), (F.col("n_nationkey") + i).cast("double").alias("lng"), (F.col("n_nationkey") * 2.0 - i).alias("lat")) for i in range(3)]
    return n.select(F.col("n_nationkey").alias("pid"), F.substring("n_name", 1, 5).alias("pname"), F.array(*city).alias("cities"))


MAP_SQL = province_sql("split_total_amount") + """, s AS (SELECT province_id, province_name, sum(CAST(order_amount AS DECIMAL(18,2))) AS value FROM province_stats GROUP BY ALL),
m AS (SELECT s.*, (SELECT min(n_nationkey) FROM nation WHERE starts_with(s.province_name, substr(n_name, 1, 5))) AS pid FROM s), r AS (SELECT *, CAST(row_number() OVER (ORDER BY value, province_id) AS INT) AS rank FROM m WHERE pid IS NOT NULL),
l AS (SELECT province_name, CAST(value AS DOUBLE) AS value, rank, CAST(pid AS INT) AS pid, CASE WHEN rank <= 20 THEN '0%-60%' WHEN rank <= 30 THEN '60%-30%' ELSE '30%-100%' END AS label FROM r WHERE rank <= 34)"""


@query(MAP_SQL + " SELECT * FROM l")
def dash_map_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.map_ranks(province_table(spark, sf_dir), city_table(spark, sf_dir)).select("province_name", double("value").alias("value"), "rank", "pid", "label")


@query(MAP_SQL + """, c AS (SELECT label, n_name || '-' || i AS city, [CAST(n_nationkey + i AS DOUBLE), n_nationkey * 2.0::DOUBLE - i] AS value FROM l JOIN nation ON n_nationkey = pid, range(3) t(i)),
d AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || city), city) AS r, count(*) OVER (PARTITION BY label) AS n FROM c)
SELECT label AS name, CAST(to_json(list({'city': city, 'value': value} ORDER BY city)) AS VARCHAR) AS children FROM d WHERE r <= n // 3 GROUP BY label""")
def dash_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.documents(dashboard.map_cities(province_table(spark, sf_dir), city_table(spark, sf_dir)))


@query(VISITOR_GROUP + " SELECT item, coalesce(CAST(sum(v) FILTER (is_new = '0') AS DOUBLE), 0) AS is_old, coalesce(CAST(sum(v) FILTER (is_new = '1') AS DOUBLE), 0) AS is_new FROM (UNPIVOT (SELECT is_new, uv_ct, pv_ct, sv_ct, uj_ct, dur_sum FROM visitor_stats) ON uv_ct, pv_ct, sv_ct, uj_ct, dur_sum INTO NAME item VALUE v) GROUP BY item")
def dash_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.visitors(visitor_table(spark, sf_dir))


@query(VISITOR_GROUP + " SELECT CAST(CAST(t AS DATE) AS VARCHAR) || ' ' || hour(t) || ':' || minute(t) AS name, CAST(sum(uv_ct) AS BIGINT) AS value FROM (SELECT CAST(edt AS TIMESTAMP) AS t, uv_ct FROM visitor_stats) GROUP BY t")
def dash_rank_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.traffic(visitor_table(spark, sf_dir))


@query("SELECT word AS name, CAST(sum(CASE source WHEN 'SEARCH' THEN 10 WHEN 'ORDER' THEN 3 WHEN 'CART' THEN 2 WHEN 'CLICK' THEN 1 ELSE 0 END) AS BIGINT) AS value FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word, CASE turn % 5 WHEN 0 THEN 'SEARCH' WHEN 1 THEN 'ORDER' WHEN 2 THEN 'CART' WHEN 3 THEN 'CLICK' ELSE 'OTHER' END AS source FROM conversations) GROUP BY word")
def dash_keywords_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.element_at(F.array(*map(F.lit, ("SEARCH", "ORDER", "CART", "CLICK", "OTHER"))), (F.col("turn") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select(F.explode(C.words(F.col("text"))).alias("keyword"), source.alias("source"))
    return dashboard.keywords(rows.groupBy("keyword", "source").agg(F.count("*").alias("ct")))


@query("SELECT source, count(*) AS n FROM (SELECT 'orders' AS source FROM orders UNION ALL SELECT 'customer' FROM customer UNION ALL SELECT 'part' FROM part) GROUP BY source")
def union_all_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).groupBy(F.col("tableName").alias("source")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE (epoch_us(o_orderdate) // 1000) END AS ms, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def date_to_ts_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.date_format("o_orderdate", C.STAMP)
    text = F.when(F.col("o_orderkey") % 4 == 0, at).when(F.col("o_orderkey") % 4 == 1, F.translate(at, "-", "/")).when(F.col("o_orderkey") % 4 == 2, "no time")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.to_millis(text).alias("ms"), C.day(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("day"))


@query("SELECT c_custkey, CAST(floor(date_diff('day', CAST('19' || (c_custkey % 90 + 10) || '-03-01' AS DATE), DATE '2024-06-01') / 365) AS INT) AS age FROM customer")
def user_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims(spark, sf_dir)["user"].select(F.col("id").alias("c_custkey"), C.age(F.col("birthday"), F.lit("2024-06-01").cast("timestamp")).alias("age"))


@query("SELECT coalesce(l.c_nationkey, r.s_nationkey) AS id, coalesce(l.n, r.n) AS n, coalesce(l.name, r.name) AS name FROM (SELECT c_nationkey, count(*) AS n, CASE WHEN c_nationkey % 2 = 0 THEN min(c_name) END AS name FROM customer GROUP BY 1) l FULL JOIN (SELECT s_nationkey, count(*) AS n, min('S' || s_suppkey) AS name FROM supplier GROUP BY 1) r ON l.c_nationkey = r.s_nationkey")
def first_non_null_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("n"), F.min("c_name").alias("name")).withColumn("name", F.when(F.col("id") % 2 == 0, F.col("name")))
    right = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.count("*").alias("n"), F.min(F.concat(F.lit("S"), "s_suppkey")).alias("name"))
    return C.first_non_null(left, right, "id")
