"""Small fixtures for every operator's edges."""

import random

import pytest
from pyspark.sql import functions as F

from brookmart.functions import columns as C
from brookmart.operators import joins, logs, parse, reshape, route, visits, windows
from brookmart.plans import dashboard, stats, wide
from brookmart.schemas import CHANGE_EVENT, DEBEZIUM, ORDER_DETAIL, ORDER_INFO, PAGE_LOG, PAYMENT_INFO, PRODUCT_STATS, ROUTE
from brookmart.sources import topics

GOOD = '{"common":{"mid":"m1","is_new":"1"},"page":{"page_id":"good_detail","item_type":"sku_id","item":"7","last_page_id":"search"},"displays":[{"item":"8","item_type":"sku_id","order":1},{"item":"a","item_type":"activity_id"}],"ts":5}'
START = '{"common":{"mid":"m1"},"start":{"entry":"icon"},"ts":6}'
BARE = '{"common":{"mid":"m1"},"page":{"page_id":"home"},"ts":7}'


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_dirty_records_are_apart(spark):
    raw = spark.createDataFrame([(GOOD,), (START,), (BARE,), ("{bad",), ("",), (None,)], "value string")
    good, dirty = parse.parse(raw, PAGE_LOG)
    assert values(good, "ts") == [(5,), (6,), (7,)]
    assert dirty.count() == 3
    with pytest.raises(Exception):
        parse.parse_strict(raw.filter("value = '{bad'"), PAGE_LOG).collect()


def test_log_split_and_clicks(spark):
    good, _ = parse.parse(spark.createDataFrame([(GOOD,), (START,), (BARE,)], "value string"), PAGE_LOG)
    parts = logs.split_log(good)
    assert values(parts["start"], "ts") == [(6,)] and values(parts["page"], "ts") == [(5,), (7,)]
    assert values(parts["display"], "item", "page_id") == [("8", "good_detail"), ("a", "good_detail")]
    assert "ts" not in parts["display"].columns
    assert values(logs.clicks_and_displays(parts["page"]), "sku_id", "ts", "click_ct", "display_ct") == [(7, 5, 1, 0), (8, 5, 0, 1)]
    assert values(stats.searches(parts["page"]), "fullword") == [("7",)]


def test_change_events(spark):
    rows = [("s.shop.t", None, {"id": "1"}, "c"), ("s.shop.t", {"id": "1"}, {"id": "2"}, "u"), ("s.shop.t", {"id": "2"}, None, "d"), ("s.shop.t", None, {"id": "3"}, "r"), ("s.shop.t", None, {"id": "4"}, "create")]
    rows = [(*r, 7, i) for i, r in enumerate(rows)]
    events = parse.change_events(spark.createDataFrame(rows, DEBEZIUM))
    assert values(events, "ts_ms", "pos") == [(7, i) for i in range(5)]
    assert values(events, "database", "tableName", "type") == [("shop", "t", x) for x in ("delete", "insert", "insert", "read", "update")]
    assert events.filter("type = 'delete'").first().after == {}
    assert parse.change_events(spark.createDataFrame(rows, DEBEZIUM), True).filter("type = 'insert'").count() == 3
    flags = topics.change_flags(events, spark.createDataFrame([], "id int").schema)
    assert values(flags, "is_add", "id") == [(False, 1), (False, 2), (True, 1), (True, 2), (True, 3), (True, 4)]
    first = topics.snapshot_then_changes(spark.createDataFrame([(9,)], "id int"), "shop", "t", events)
    assert first.count() == 6 and first.first().type == "read"


def test_routing(spark):
    config = spark.createDataFrame([("a", "insert", "hbase", "old", "id", None, None, 1), ("a", "insert", "kafka", "dwd_a", "id,x", None, None, 2), ("b", "insert", "hbase", "dim_b", "id", "id", "", 1), ("c", "insert", "clickhouse", "n", "id", None, None, 1), ("d", "insert", "kafka", "n", "id", None, None, 1), ("d", "insert", None, None, None, None, None, 2)], f"{ROUTE}, seq int")
    events = spark.createDataFrame([("s", t, {}, {"id": "1", "x": "2", "y": "3"}, k, None, None) for t, k in (("a", "insert"), ("a", "delete"), ("b", "insert"), ("c", "insert"), ("d", "insert"), ("e", "insert"), ("b", None))], CHANGE_EVENT)
    routes = route.current_routes(config, "seq")
    parts = route.split_routed(route.route(events, routes))
    assert [(r.sinkTable, r.after, r.sinkPk, r.sinkExtend) for r in parts["fact"].collect()] == [("dwd_a", {"id": "1", "x": "2"}, "id", "")]
    assert [(r.sinkTable, r.after) for r in parts["dim"].collect()] == [("dim_b", {"id": "1"})]
    assert values(route.unmatched(events, routes), "tableName", "type") == [("b", None), ("d", "insert"), ("e", "insert")]

def test_is_new_repair(spark):
    rows = spark.createDataFrame(list(enumerate("11101")), "n int, is_new string").withColumn("mid", F.lit("m"))
    assert [r.is_new for r in visits.repair_is_new(rows, "mid", "is_new", ["n"]).orderBy("n").collect()] == ["1", "1", "0", "0", "0"]


def test_is_new_repair_of_a_busy_and_of_no_visitor(spark):
    rnd = random.Random(1)
    data = [(i, rnd.choice(["0", "1", "1", None]), rnd.choice(["m", "m", "m", "n", None])) for i in range(800)]
    rows = spark.createDataFrame(data, "n int, is_new string, mid string")
    seen: dict = {}
    want = []
    for n, flag, mid in data:
        if flag == "1" and mid is not None:
            seen[mid] = seen.get(mid, 0) + 1
            flag = "1" if seen[mid] <= 2 else "0"
        want.append((n, flag, mid))
    got = visits.repair_is_new(rows, "mid", "is_new", ["n"])
    assert got.columns == rows.columns and sorted(map(tuple, got.collect())) == want


def test_unique_visits(spark):
    rows = spark.createDataFrame([(1, "d1"), (2, "d1"), (4, "d2"), (5, "d1")], "n int, day string").withColumn("mid", F.lit("m"))
    assert values(visits.unique_visits(rows, "mid", F.col("day"), ["n"]), "n") == [(1,), (4,), (5,)]


def test_rows_without_visitor_or_time_are_nobodys(spark):
    rows = spark.createDataFrame([(None, 1, "d1"), (None, 2, "d1"), ("m", 3, None), ("m", 4, "d1"), ("m", 5, "d1"), ("n", None, None)], "mid string, n int, day string")
    assert values(visits.unique_visits(rows, "mid", F.col("day"), ["n"]), "n") == [(4,)]
    pages = spark.createDataFrame([(None, 0), (None, 1), ("m", 0), ("m", None), ("m", 90_000), ("m", 90_001), ("k", 86_399_999), ("k", 86_400_001)], "mid string, ts long").withColumn("et", F.timestamp_millis("ts"))
    got = visits.bounces(pages, "mid", F.col("ts") != 86_400_001, "et", ["ts"])
    assert values(got, "mid", "ts") == [("m", 0), ("m", 90_000), ("m", 90_001)]  # k's page follows on the next day, in time


def test_bounces_in_pieces_are_those_of_whole_visitors(spark):
    rnd = random.Random(11)
    rows = [(f"m{rnd.randrange(3)}", rnd.randrange(2) == 0, i * 7_000 + rnd.randrange(6_000)) for i in range(400)]
    pages = spark.createDataFrame(rows, "mid string, entry boolean, ts long").withColumn("et", F.timestamp_millis("ts"))
    got = [values(visits.bounces(pages, "mid", F.col("entry"), "et", ["ts"], "9 seconds", p), "mid", "ts") for p in ("1 second", "1 minute", "1 day")]
    assert got[0] == got[1] == got[2] and 100 < len(got[0]) < 250
    assert visits.bounces(pages, "mid", F.col("entry"), "et", ["ts"]).columns == pages.columns


@pytest.mark.parametrize(("pages", "want"), [("E0 N5", []), ("E0 E5 N6", [0]), ("E0 E5 E9", [0, 5, 9]), ("E0 N10", [0]), ("N0 N1", []), ("E0 N9", [])])
def test_bounces(spark, pages, want):
    rows = spark.createDataFrame([(p[0] == "E", int(p[1:])) for p in pages.split()], "e boolean, s int").withColumns({"mid": F.lit("m"), "et": F.timestamp_seconds("s")})
    assert [r.s for r in visits.bounces(rows, "mid", F.col("e"), "et", ["s"]).orderBy("s").collect()] == want


def test_order_wide_interval(spark):
    info = wide.with_times(spark.createDataFrame([(1, 5, "1001", 9, None, None, None, None, None, None, "2024-01-01 00:00:10", None)], ORDER_INFO))
    detail = wide.with_times(spark.createDataFrame([(i, 1 if i < 9 else 2, 7, None, 1, "x", f"2024-01-01 00:00:{s:02d}", None, None, None) for i, s in ((1, 4), (2, 5), (3, 10), (4, 15), (5, 16), (9, 10))], ORDER_DETAIL))
    rows = wide.order_wide(info, detail)
    assert values(rows, "detail_id") == [(2,), (3,), (4,)]
    assert rows.first().create_hour == "00" and rows.first().split_feight_fee is None
    dims = {"user": spark.createDataFrame([("9", "2000-01-02", "F")], "id string, birthday string, gender string"), "sku": spark.createDataFrame([], "id string, sku_name string, category3_id string, spu_id string, tm_id string")}
    full = wide.with_dims(rows, dims, "2024-01-01 00:00:00").first()
    assert full.user_age == 24 and full.user_gender == "F" and full.sku_name is None and full.spu_id is None


def test_payment_wide(spark):
    orders = spark.createDataFrame([(i, i, 1, at) for i, at in enumerate(["2024-01-01 11:45:00", "2024-01-01 11:44:59", "2024-01-01 12:00:05", "2024-01-01 12:00:06", "2023-12-31 23:58:00"])], "order_id long, detail_id long, user_id long, create_time string")
    orders = wide.with_times(orders.withColumns({"total_amount": F.lit(1).cast("decimal(16,2)"), "split_total_amount": F.lit(1).cast("decimal(16,2)")}))
    pays = wide.with_times(spark.createDataFrame([(10 + i, i, 77, None, "s", "1101", "2024-01-01 12:00:00" if i < 4 else "2024-01-01 00:05:00", None) for i in range(5)], PAYMENT_INFO))
    rows = wide.payment_wide(pays, orders)
    assert values(rows, "order_id", "user_id") == [(0, 77), (2, 77), (4, 77)]
    assert values(wide.payment_wide(pays, orders, same_day=True), "order_id") == [(0,), (1,), (2,), (3,)]


def test_product_stats_edges(spark):
    base = spark.createDataFrame([(1, 0, 100), (1, 1, 100), (1, 2, 101), (2, 3, 102), (None, 4, 103)], "sku_id long, ts long, order_id long")
    rows = stats.product_rows(base, F.col("ts"), order_id=F.col("order_id"), order_amount=F.lit("2.50"))
    got = {r.sku_id: r for r in stats.product_stats(rows).collect()}
    assert set(got) == {1, 2} and got[1].order_ct == 2 and got[2].order_ct == 1 and float(got[1].order_amount) == 7.5
    old = {r.sku_id: r.order_ct for r in stats.product_stats(rows, compat=True).collect()}
    assert old == {1: 2, 2: 0}


def test_prefix_join_takes_the_first(spark):
    names = spark.createDataFrame([(1, "ab"), (2, "a"), (3, "x")], "pid int, pname string")
    rows = spark.createDataFrame([(1, "abc"), (2, "ac"), (3, "zz"), (4, None)], "id int, name string")
    assert values(joins.prefix_join(rows, names, "name", "pname", "pid", ["id"]), "id", "pname") == [(1, "ab"), (2, "a")]


def test_dashboard(spark):
    p = spark.createDataFrame([(1, "s1", 1, "A name that is long", 1, "t", 1, "c", 3, 10.0, 4, 2), (2, "s2", 1, "A name that is long", 2, "u", 1, "c", 4, 0.0, 1, 1), (3, "s3", 2, "exactly 15 char", 1, "t", 2, "d", 5, 1.0, 0, 0)], "sku_id int, sku_name string, spu_id int, spu_name string, tm_id int, tm_name string, category3_id int, category3_name string, order_ct long, order_amount double, comment_ct long, good_comment_ct long")
    assert dashboard.count(p).first()[0] == 11.0
    assert values(dashboard.seller(p), "name", "value") == [("t", 11.0)]
    tree = {r.name: r.children for r in dashboard.hot(p).collect()}
    assert tree["c"][0].value == 7 and [x.value for x in tree["c"][0].children] == [3, 4]
    assert values(dashboard.stock(p), "name", "stock", "sales") == [("A", 5, 3), ("exactly 15 char", 0, 0)]
    k = spark.createDataFrame([("a", "SEARCH", 2), ("a", "OTHER", 9), ("b", "CLICK", 30)], "keyword string, source string, ct long")
    assert [tuple(r) for r in dashboard.keywords(k).collect()] == [("b", 30), ("a", 20)]
    v = spark.createDataFrame([("1", 1, 2, 3, 4, 5, "2024-01-01 09:05:10"), ("0", 10, 20, 30, 40, 50, "2024-01-01 09:05:20")], "is_new string, uv_ct long, pv_ct long, sv_ct long, uj_ct long, dur_sum long, edt string")
    assert ("uv_ct", 10.0, 1.0) in values(dashboard.visitors(v), "item", "is_old", "is_new")
    assert [tuple(r) for r in dashboard.traffic(v).collect()] == [("2024-01-01 9:5", 11)]
    prov = spark.createDataFrame([(i, f"P{i:02d} province", float(i)) for i in range(36)], "province_id int, province_name string, order_amount double")
    cities = spark.createDataFrame([(i, f"P{i:02d}", [(f"c{j}", 1.0, 2.0) for j in range(3)]) for i in range(36)], "pid int, pname string, cities array<struct<cname:string,lng:double,lat:double>>")
    got = {r.name: len(r.children) for r in dashboard.map_cities(prov, cities).collect()}
    assert got == {"0%-60%": 20, "60%-30%": 10, "30%-100%": 4}


def test_helpers(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:01", ""), ("2024/01/01 00:00:01", "home"), ("no", None), (None, "x")], "t string, last string")
    rows = df.select(C.to_millis(F.col("t")).alias("ms"), C.is_entry(F.col("last")).alias("e")).collect()
    assert [r.ms for r in rows] == [1704067201000, 1704067201000, 0, 0] and [r.e for r in rows] == [True, False, True, False]
    assert C.camel(spark.createDataFrame([(1, 2)], "user_id int, T int")).columns == ["userId", "t"]
    assert df.limit(1).select(C.words(F.lit("Ab, c1-É"))).first()[0] == ["ab", "c1", "é"]
    assert df.limit(1).select(C.words(F.lit("红色鞋 size42, 鞋 a鞋子b"))).first()[0] == ["红色", "色鞋", "size42", "鞋", "a", "鞋子", "b"]
    codes = spark.createDataFrame([("1001",), ("9",), (None,)], "c string").select(C.code_name(F.col("c"), "order_status").alias("n"))
    assert [r.n for r in codes.collect()] == ["unpaid", None, None]
    both = C.first_non_null(spark.createDataFrame([(1, None), (2, "l")], "id int, v string"), spark.createDataFrame([(1, "r"), (3, "q")], "id int, v string"), "id")
    assert values(both, "id", "v") == [(1, "r"), (2, "l"), (3, "q")]


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "b")], "id int, v string")
    topics.write_topic(rows, "t", str(tmp_path))
    assert values(topics.read_topic(spark, "t", str(tmp_path)), "value") == [('{"id":1}',), ('{"id":2,"v":"b"}',)]
    routed = spark.createDataFrame([("x", {"id": "1"}), (None, {"id": "2"})], "sinkTable string, after map<string,string>")
    topics.write_by_topic(routed, str(tmp_path / "facts"))
    assert values(spark.read.text(str(tmp_path / "facts")), "topic") == [("DWD_DEFAULT",), ("x",)]
    (tmp_path / "cities.json").write_text('[{"pid":1,"pname":"P","cities":[{"cname":"c","lng":1.0,"lat":2.0}]}]')
    assert topics.cities(spark, str(tmp_path / "none.json"), str(tmp_path / "cities.json")).first().pname == "P"
    topics.append_stats(rows, ["v", "id"], str(tmp_path / "stats"))
    assert spark.read.parquet(str(tmp_path / "stats")).columns == ["v", "id"]
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a.json").write_text('{"topic":"s.d.t","before":null,"after":{"id":"1"},"op":"c"}\n')
    assert parse.change_events(topics.change_feed(spark, str(tmp_path / "feed"))).first().type == "insert"


def test_table_function_in_sql(spark):
    stats.register_splitter(spark)
    rows = spark.createDataFrame([("Red shoe, red", 1), ("", 1), (None, 2), ("红色鞋x", 3)], "fullword string, s int").withColumn("et", F.timestamp_seconds("s"))
    a = stats.keyword_stats(spark, rows, "splitWord", ts=F.lit(0))
    assert values(a, "keyword", "ct") == sorted([("red", 2), ("shoe", 1), ("红色", 1), ("色鞋", 1), ("x", 1)], key=repr) == values(stats.keyword_stats(spark, rows, ts=F.lit(0)), "keyword", "ct")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rows_")]


def test_jdbc_query(spark):
    """The database that Spark itself brings along."""
    url = "jdbc:derby:memory:shop;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, tm_name string").write.format("jdbc").options(url=url, dbtable="base_trademark", **driver).save()
    rows = topics.jdbc(spark, url, 'SELECT "id", "tm_name" FROM base_trademark WHERE "id" > 1', **driver)
    assert [tuple(r) for r in rows.collect()] == [(2, "b")] and C.camel(rows).columns == ["id", "tmName"]


def test_province_rows(spark):
    wide_row = spark.createDataFrame([(1, 5, "2.50", "North", 9)], "order_id long, province_id long, split_total_amount string, province_name string, s long")
    wide_row = wide_row.withColumns({"et": F.timestamp_seconds("s"), **{c: F.lit("x") for c in ("province_area_code", "province_iso_code", "province_3166_2_code")}})
    assert values(stats.province_rows(wide_row), "province_name", "order_amount", "order_count", "ts") == [("North", "2.50", 1, 9000)]


def test_product_dims_order(spark):
    rows = stats.product_stats(stats.product_rows(spark.createDataFrame([(1, 0)], "sku_id long, ts long"), F.col("ts")))
    sku = spark.createDataFrame([("1", "n", "9.5", "2", "3", "4")], "id string, sku_name string, price string, spu_id string, tm_id string, category3_id string")
    named = [spark.createDataFrame([(i, f"n{i}")], f"id string, {c} string") for i, c in (("2", "spu_name"), ("4", "name"), ("3", "tm_name"))]
    full = stats.product_dims(rows, sku, *named)
    assert full.columns == PRODUCT_STATS and full.first().spu_name == "n2" and full.first().category3_name == "n4" and full.first().tm_name == "n3"


def test_windows_and_nesting(spark):
    rows = spark.createDataFrame([(0, "a"), (9, "a"), (10, "a")], "s int, k string").withColumn("et", F.timestamp_seconds("s"))
    assert values(windows.tumble(rows, "et", "10 seconds", ["k"], F.count("*").alias("n")), "stt", "n") == [("1970-01-01 00:00:00", 2), ("1970-01-01 00:00:10", 1)]
    assert reshape.nest(rows, ["k"], "xs", "s").first().xs[0].s == 0
