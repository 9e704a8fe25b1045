"""Streams give what the closed forms give."""

import itertools
import json
import os
import random
import time

from pyspark.sql import functions as F

from brookmart.functions.columns import is_entry
from brookmart.operators import visits
from brookmart.plans import stats
from brookmart.schemas import PAGE_LOG
from brookmart.sources import topics
from brookmart.streaming import state
from brookmart.streaming.jobs import Jobs

END = 10_000_000


def log(n=120, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        last = rnd.choice([None, "", "home", "search"])
        rows.append({"common": {"mid": f"m{rnd.randrange(4)}", "is_new": rnd.choice("01"), "ar": "1", "ch": "c", "vc": "v"}, "page": {"page_id": "p", "last_page_id": last, "item": "red shoe", "during_time": i}, "displays": [{"item": str(i), "item_type": "sku_id"}] if i % 3 == 0 else None, "ts": 1000 * i + rnd.randrange(900)})
    return rows


ARRIVALS = itertools.count(int(time.time()) - 10_000)


def drop(path, rows, parts=3, name="part"):
    """Files that arrive one after another: their order is that of their modification times."""
    path.mkdir(parents=True, exist_ok=True)
    step = -(-len(rows) // parts)
    for i in range(parts):
        file = path / f"{name}-{i}.txt"
        file.write_text("".join(json.dumps(r) + "\n" for r in rows[i * step : (i + 1) * step]))
        os.utime(file, (at := next(ARRIVALS), at))


def collected(spark, rows, tmp_path, name):
    q = rows.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_bounce_stream_equals_window(spark, tmp_path):
    rows = [r for r in log() if True]
    drop(tmp_path / "t", [*rows, {"common": {"mid": "end"}, "page": {}, "ts": END}], 4)
    raw = topics.read_topic(spark, "t", str(tmp_path), stream=True, per_trigger=1)
    page = raw.select(F.from_json("value", PAGE_LOG).alias("r")).select("r.*")
    made = page.select(F.col("common.mid").alias("mid"), is_entry(F.col("page.last_page_id")).alias("entry"), F.timestamp_millis("ts").alias("et"), "ts")
    got = collected(spark, state.bounces(made, "mid", "entry", "et", "ts", ["ts"], 3000), tmp_path, "bounce_out")
    batch = spark.createDataFrame([(r["common"]["mid"], not r["page"]["last_page_id"], r["ts"]) for r in rows], "mid string, entry boolean, ts long").withColumn("et", F.timestamp_millis("ts"))
    want = visits.bounces(batch, "mid", F.col("entry"), "et", ["ts"], "3 seconds")
    assert sorted((r.mid, r.ts) for r in got.collect() if r.mid != "end") == sorted((r.mid, r.ts) for r in want.collect())


def test_settle_waits_for_late_rows():
    p = state._Bounces(("ts", "e"), "e", "ts", ("ts",), 10)
    assert p.settle([(0, True)], 5) == ([], [(0, True)])
    assert p.settle([(0, True), (7, False)], 5) == ([], [(0, True), (7, False)])
    assert p.settle([(0, True), (7, False)], 8) == ([], [(7, False)])
    assert p.settle([(0, True)], 10) == ([(0, True)], [])


def test_is_new_and_unique_streams(spark, tmp_path):
    rows = log(60)
    drop(tmp_path / "t", rows, 3)
    raw = topics.read_topic(spark, "t", str(tmp_path), stream=True, per_trigger=1).select(F.from_json("value", PAGE_LOG).alias("r")).select("r.common.mid", "r.common.is_new", "r.ts")
    got = collected(spark, state.repair_is_new(raw, "mid", "is_new", ["ts"]), tmp_path, "new_out")
    batch = spark.createDataFrame([(r["common"]["mid"], r["common"]["is_new"], r["ts"]) for r in rows], "mid string, is_new string, ts long")
    want = visits.repair_is_new(batch, "mid", "is_new", ["ts"])
    assert sorted(map(tuple, got.select("mid", "ts", "is_new").collect())) == sorted(map(tuple, want.select("mid", "ts", "is_new").collect()))
    days = raw.withColumn("day", F.floor(F.col("ts") / 7000).cast("string"))
    got = collected(spark, state.unique_visits(days, "mid", "day", ["ts"]), tmp_path, "uv_out")
    want = visits.unique_visits(batch, "mid", F.floor(F.col("ts") / 7000).cast("string"), ["ts"])
    assert sorted((r.mid, r.ts) for r in got.collect()) == sorted((r.mid, r.ts) for r in want.collect())


def test_jobs_from_log_to_stats(spark, tmp_path):
    rows = log(90)
    drop(tmp_path / "topics" / "ods_base_log", [*rows, {"start": {"entry": "icon"}, "ts": 1}, {"common": {"mid": "end"}, "page": {"last_page_id": "search", "item": "end"}, "ts": END}], 1)
    with (tmp_path / "topics" / "ods_base_log" / "part-0.txt").open("a") as f:
        f.write("{bad\n")
    jobs = Jobs(spark, str(tmp_path))
    jobs.split_log().awaitTermination()
    jobs.dirty.awaitTermination()
    assert spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "topics" / "dirty_log")).count() == 1
    page = spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "topics" / "dwd_page_log"))
    assert page.count() == 91
    assert spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "topics" / "dwd_display_log")).count() == 30
    jobs.unique_visit().awaitTermination()
    jobs.bounce(3000).awaitTermination()
    jobs.visitor_stats().awaitTermination()
    jobs.keyword_stats().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "stats" / "visitor_stats"))
    assert out.agg(F.sum("pv_ct")).first()[0] == 90
    words = spark.read.parquet(str(tmp_path / "stats" / "keyword_stats"))
    assert words.agg(F.sum("ct")).first()[0] == 2 * sum(r["page"]["last_page_id"] == "search" for r in rows)
    # the same windows in batch
    pages = page.select(F.from_json("value", PAGE_LOG).alias("r")).select("r.*").filter(f"ts < {END}")
    none = pages.limit(0)
    want = stats.visitor_stats(stats.visitor_rows(pages, none, none))
    assert {(r.stt, r.is_new): r.pv_ct for r in out.collect() if r.pv_ct} == {(r.stt, r.is_new): r.pv_ct for r in want.collect()}


def test_order_wide_and_change_jobs(spark, tmp_path):
    def order(i, at):
        return {"id": i, "province_id": 1, "user_id": 2, "total_amount": 5, "create_time": at}

    drop(tmp_path / "topics" / "dwd_order_info", [order(1, "2024-01-01 00:00:10"), order(2, "2024-01-01 00:01:00")], 1)
    drop(tmp_path / "topics" / "dwd_order_detail", [{"id": 7, "order_id": 1, "sku_id": 3, "split_total_amount": 2.5, "create_time": "2024-01-01 00:00:14"}, {"id": 8, "order_id": 2, "sku_id": 3, "create_time": "2024-01-01 00:01:06"}], 1)
    drop(tmp_path / "topics" / "ods_base_db", [{"database": "s", "tableName": "base_province", "before": {}, "after": {"id": "1", "name": "North", "area_code": "n", "x": "y"}, "type": "insert"}, {"database": "s", "tableName": "cart", "before": {}, "after": {"id": "5"}, "type": "insert"}], 1)
    config = spark.createDataFrame([("base_province", "insert", "hbase", "dim_base_province", "id,name,area_code,iso_code,iso_3166_2", "id", None, 1), ("cart", "insert", "kafka", "dwd_cart_info", "id", None, None, 1)], "sourceTable string, operateType string, sinkType string, sinkTable string, sinkColumns string, sinkPk string, sinkExtend string, seq int")
    config.write.parquet(str(tmp_path / "config"))
    jobs = Jobs(spark, str(tmp_path))
    jobs.split_db(str(tmp_path / "config")).awaitTermination()
    assert jobs.dims.read("dim_base_province").first().name == "North"
    assert spark.read.text(str(tmp_path / "facts" / "batch-0")).first().topic == "dwd_cart_info"
    jobs.order_wide().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "topics" / "dwm_order_wide")).collect()
    assert len(rows) == 1 and json.loads(rows[0].value)["province_name"] == "North"
    jobs.province_stats().awaitTermination()
    drop(tmp_path / "topics" / "dwm_order_wide" / "batch-9", [{"order_id": 5, "province_id": 2, "et": "2024-01-01T01:00:00.000Z"}], 1)  # the watermark passes
    jobs.province_stats().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "stats" / "province_stats")).filter("province_id = 1").collect()
    assert [(r.stt, r.province_name, float(r.order_amount), r.order_count) for r in out] == [("2024-01-01 00:00:10", "North", 2.5, 1)]


def change(table, kind="insert", ts_ms=None, pos=None, **after):
    return {"database": "s", "tableName": table, "before": {}, "after": {k: str(v) for k, v in after.items()}, "type": kind, "ts_ms": ts_ms, "pos": pos}


def routes(spark, path, *rows):
    full = [(*r, None, i) for i, r in enumerate(rows)]
    spark.createDataFrame(full, "sourceTable string, operateType string, sinkType string, sinkTable string, sinkColumns string, sinkPk string, sinkExtend string, seq int").write.parquet(str(path))


def test_the_last_change_at_the_source_counts(spark, tmp_path):
    """An older change in a small file and a newer one in a larger, in one batch, and changes out of order in a file; a route
    without columns, and one that was deleted."""
    topic = tmp_path / "topics" / "ods_base_db"
    drop(topic, [change("p", id=1, name="old"), change("q", ts_ms=9, pos=2, id=1, name="last"), change("q", ts_ms=9, pos=1, id=1, name="before"), change("q", ts_ms=3, pos=7, id=1, name="first")], 1, "a")
    drop(topic, [change("p", id=i, name="new") for i in range(1, 3000)] + [change("n", id=1, name="x"), change("p", id=None, name="none")], 1, "b")
    routes(spark, tmp_path / "config", ("p", "insert", "hbase", "dim_p", "id,name", None), ("q", "insert", "hbase", "dim_q", "id,name,gone", "id"), ("n", "insert", "hbase", "dim_n", None, None), ("p", "update", None, "dim_p", "id,odd", None))
    jobs = Jobs(spark, str(tmp_path))
    jobs.split_db(str(tmp_path / "config")).awaitTermination()
    assert {r.name for r in jobs.dims.read("dim_p").filter("id = '1'").collect()} == {"new"}
    assert [(r.name, r.gone) for r in jobs.dims.read("dim_q").collect()] == [("last", None)]
    assert jobs.dims.read("dim_p").columns == ["id", "name"] and jobs.dims.read("dim_n") is None


def test_a_restart_goes_on_and_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    topic = tmp_path / "topics" / "ods_base_log"
    rows = log(60)
    drop(topic, rows[:30], 2)
    Jobs(spark, str(tmp_path)).split_log().awaitTermination()
    page = tmp_path / "topics" / "dwd_page_log"
    before = {p: p.stat().st_mtime for p in page.rglob("part-*")}
    drop(topic, rows[30:], 2, "later")
    last = max(tmp_path.glob("checkpoints/split_log/commits/[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the job had ended before it noted its last batch
    for crc in last.parent.glob(f".{last.name}.crc"):
        crc.unlink()
    Jobs(spark, str(tmp_path)).split_log().awaitTermination()
    assert all(p.stat().st_mtime == t for p, t in before.items())
    got = spark.read.option("recursiveFileLookup", True).text(str(page)).select(F.from_json("value", PAGE_LOG).alias("r")).select("r.common.mid", "r.ts", "r.common.is_new")
    batch = spark.createDataFrame([(r["common"]["mid"], r["common"]["is_new"], r["ts"]) for r in rows], "mid string, is_new string, ts long")
    want = visits.repair_is_new(batch, "mid", "is_new", ["ts"]).select("mid", "ts", "is_new")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rows_without_a_visitor_pass_unrepaired(spark, tmp_path):
    rows = [{"common": {"mid": m, "is_new": "1"}, "page": {"page_id": "p"}, "ts": i} for i, m in enumerate([None] * 5 + ["m"] * 5)]
    drop(tmp_path / "topics" / "ods_base_log", rows, 1)
    Jobs(spark, str(tmp_path)).split_log().awaitTermination()
    page = spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "topics" / "dwd_page_log")).select(F.from_json("value", PAGE_LOG).alias("r"))
    assert page.filter("r.common.is_new = '1'").groupBy("r.common.mid").count().orderBy("count").collect() == [("m", 2), (None, 5)]


def test_late_rows_are_dropped(spark, tmp_path):
    """A window that the watermark of the batch before has passed takes no more rows; one that it hasn't does."""

    def word(text, ms):
        return {"page": {"last_page_id": "search", "item": text}, "ts": ms}

    drop(tmp_path / "t", [word("a", 1000), word("b", 60_000), word("c", 58_000), word("late", 2000), word("end", END)], 5)
    raw = topics.read_topic(spark, "t", str(tmp_path), stream=True, per_trigger=1)
    page = raw.select(F.from_json("value", PAGE_LOG).alias("r")).select("r.*")
    out = stats.keyword_stats(spark, stats.searches(page), delay="5 seconds", ts=F.lit(0))
    got = collected(spark, out, tmp_path, "late_out")
    assert sorted((r.keyword, r.ct) for r in got.collect()) == [("a", 1), ("b", 1), ("c", 1)]


def test_views_and_console(spark, tmp_path):
    drop(tmp_path / "t", log(5), 1)
    raw = topics.read_topic(spark, "t", str(tmp_path), stream=True)
    rows = topics.topic_view(spark, "page_view", raw.select(F.from_json("value", PAGE_LOG).alias("r")).select("r.*"), F.timestamp_millis("ts"))
    assert dict(rows.dtypes)["rt"] == "timestamp"
    got = collected(spark, spark.sql("SELECT page.item AS item, rt FROM page_view WHERE page.item IS NOT NULL"), tmp_path, "view_out")
    assert got.count() == 5
    topics.console(raw, str(tmp_path / "console")).awaitTermination()
    placed = topics.in_order(topics.read_topic(spark, "t", str(tmp_path), positions=True)).orderBy("position", "line")
    assert [json.loads(r.value)["ts"] for r in placed.collect()] == [r["ts"] for r in log(5)]


def test_a_feed_becomes_changes(spark, tmp_path):
    feed = [{"topic": "srv.shop.p", "before": None, "after": {"id": "1", "name": f"n{i}"}, "op": "c" if i == 0 else "u", "ts_ms": 5 + i, "pos": i} for i in range(3)]
    drop(tmp_path / "feed", feed[::-1], 1)
    routes(spark, tmp_path / "config", ("p", "insert", "hbase", "dim_p", "id,name", "id"), ("p", "update", "hbase", "dim_p", "id,name", "id"))
    jobs = Jobs(spark, str(tmp_path))
    jobs.change_capture(str(tmp_path / "feed")).awaitTermination()
    jobs.split_db(str(tmp_path / "config")).awaitTermination()
    assert [tuple(r) for r in jobs.dims.read("dim_p").collect()] == [("1", "n2")]


def test_chain_from_logs_and_changes_to_all_statistics(spark, tmp_path):
    at, dimensions = "2024-01-01 00:00:1", ("sku_info", "base_province")
    changes = [
        change("sku_info", id=3, sku_name="Shoe", price="9.5", spu_id=1, tm_id=1, category3_id=1),
        change("order_info", id=1, province_id=1, user_id=2, total_amount="5.00", create_time=f"{at}0"),
        change("order_detail", id=7, order_id=1, sku_id=3, sku_num=2, split_total_amount="2.50", create_time=f"{at}4"),
        change("payment_info", id=9, order_id=1, user_id=2, total_amount="5.00", payment_type="1101", create_time=f"{at}6"),
        change("favor_info", id=1, sku_id=3, create_time=f"{at}1"),
        change("cart_info", id=1, sku_id=3, create_time=f"{at}2"),
        change("order_refund_info", id=1, order_id=1, sku_id=3, refund_amount="1.25", create_time=f"{at}8"),
        change("comment_info", id=1, sku_id=3, appraise="1201", create_time=f"{at}9"),
        change("base_province", id=1, name="North", area_code="n"),
        change("favor_info", id=2, sku_id=4, create_time="2024-01-01 01:00:00"),
        change("order_info", id=2, province_id=1, user_id=2, total_amount="5.00", create_time="2024-01-01 01:00:00"),
        change("order_detail", id=8, order_id=2, sku_id=4, sku_num=1, split_total_amount="5.00", create_time="2024-01-01 01:00:01"),
        change("order_info", id=3, create_time="2024-01-01 02:00:00"),
        change("order_detail", id=9, order_id=4, create_time="2024-01-01 02:00:00"),
    ]
    drop(tmp_path / "topics" / "ods_base_db", changes, 1)

    def page(ts, mid="m", **more):
        return {"common": {"mid": mid, "is_new": "1", "vc": "v", "ch": "c", "ar": "1"}, "page": {"page_id": "good_detail", "item_type": "sku_id", "item": "3", "during_time": 5, **more}, "displays": [{"item": "3", "item_type": "sku_id"}], "ts": 1704067200000 + ts}

    drop(tmp_path / "topics" / "ods_base_log", [page(13_000), page(14_000, last_page_id="search"), page(15_000, "n", item_type="none"), page(3_600_000, "z", item="4"), page(7_200_000, "z", item="5", last_page_id="search")], 1)
    routes = [(c["tableName"], "insert", "hbase" if c["tableName"] in dimensions else "kafka", ("dim_" if c["tableName"] in dimensions else "dwd_") + c["tableName"], ",".join(c["after"]), "id", None, 1) for c in changes[:9]]
    spark.createDataFrame(routes, "sourceTable string, operateType string, sinkType string, sinkTable string, sinkColumns string, sinkPk string, sinkExtend string, seq int").write.parquet(str(tmp_path / "config"))
    jobs = Jobs(spark, str(tmp_path))
    jobs.split_db(str(tmp_path / "config")).awaitTermination()
    for job in (jobs.split_log, jobs.unique_visit, jobs.bounce, jobs.order_wide, jobs.payment_wide, jobs.visitor_stats, jobs.product_stats, jobs.province_stats, jobs.keyword_stats):
        job().awaitTermination()
    jobs.dirty.awaitTermination()
    paid = [json.loads(r.value) for r in spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "topics" / "dwm_payment_wide")).collect()]
    assert [(r["payment_id"], r["detail_id"], float(r["split_total_amount"]), r["sku_name"]) for r in paid] == [(9, 7, 2.5, "Shoe")]
    rows = spark.read.parquet(str(tmp_path / "stats" / "product_stats")).filter("sku_id = 3 AND stt = '2024-01-01 00:00:10'").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.stt, r.sku_name, r.click_ct, r.display_ct, r.favor_ct, r.cart_ct) == ("2024-01-01 00:00:10", "Shoe", 2, 3, 1, 1)
    assert (float(r.order_amount), r.order_sku_num, r.order_ct, float(r.payment_amount), r.paid_order_ct) == (5, 2, 1, 2.5, 1)
    assert (float(r.refund_amount), r.refund_order_ct, r.comment_ct, r.good_comment_ct) == (1.25, 1, 1, 1)

    def of(name):
        return spark.read.parquet(str(tmp_path / "stats" / name)).filter("stt = '2024-01-01 00:00:10'")

    visits_ = of("visitor_stats").agg(*(F.sum(c) for c in ("uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum"))).first()
    assert tuple(visits_) == (2, 3, 2, 1, 15)  # n's visit is a bounce
    assert [(r.province_name, float(r.order_amount), r.order_count) for r in of("province_stats").collect()] == [("North", 2.5, 1)]
    assert [(r.keyword, r.ct) for r in of("keyword_stats").collect()] == [("3", 1)]
