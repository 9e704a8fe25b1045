"""The database sink, sums for dashboards, lexicons and late rows."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_streaming import drop

from brookmart.functions.segment import Lexicon, lexicon_words
from brookmart.operators.lateness import split_late, with_watermark
from brookmart.plans import dashboard, stats
from brookmart.sources import rollups, topics
from brookmart.sources.jdbc import JdbcSink
from brookmart.streaming.jobs import Jobs


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_database_takes_a_batch_once(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    sink = JdbcSink(spark, url, "stats", ["stt", "n", "amount"])
    read = lambda: values(spark.read.format("jdbc").options(url=url, dbtable="stats").load(), "stt", "n", "amount")
    rows = lambda *xs: spark.createDataFrame([(n, Decimal(a), "t", s) for s, n, a in xs], "n long, amount decimal(16,2), transient string, stt string")
    for _ in range(2):
        sink.write(rows(("a", 1, "1.50"), ("b", None, "2.00")), 0)
    sink.write(rows(("c", 3, "0.25")), 1)
    want = [("a", 1, Decimal("1.50")), ("b", None, Decimal("2.00")), ("c", 3, Decimal("0.25"))]
    assert read() == sorted(want, key=repr)
    run, sink._run = sink._run, lambda *a: (_ for _ in ()).throw(RuntimeError("dies"))
    with pytest.raises(RuntimeError):  # after the staging table, before the transaction
        sink.write(rows(("d", 4, "1.00")), 2)
    assert len(read()) == 3 and not sink.noted(2)
    sink._run = run
    sink.write(rows(("d", 4, "1.00")), 2)
    assert len(read()) == 4 and sink.noted(2)
    with pytest.raises(Exception):  # the ledger refuses what another attempt has noted; nothing of it stays
        sink._run("INSERT INTO stats (\"stt\") VALUES ('e')", "INSERT INTO batch_ledger VALUES ('stats', 2)")
    assert len(read()) == 4


def product_batches(spark):
    rnd = random.Random(4)
    made = []
    for b in range(7):
        rows = [(f"t{b}", f"c{rnd.randrange(2)}", (s := rnd.randrange(3)), f"spu {s}", rnd.randrange(2), f"tm{rnd.randrange(2)}", f"sku{rnd.randrange(4)}", Decimal(rnd.randrange(900)) / 4, rnd.randrange(5), 2, 1) for _ in range(60)]
        made.append(spark.createDataFrame(rows, "stt string, category3_name string, spu_id long, spu_name string, tm_id long, tm_name string, sku_name string, order_amount decimal(26,2), order_ct long, comment_ct long, good_comment_ct long"))
    return made


def test_dashboards_of_sums_are_those_of_all_windows(spark, tmp_path):
    made = product_batches(spark)
    sums = rollups.rollup(spark, str(tmp_path), "product_stats")
    sums.COMPACT = 3
    assert sums.read() is None
    for n, rows in enumerate(made):
        for _ in range(2):  # every batch runs again
            sums.add(rows, n)
    sums.add(made[0], 1)  # an old one, too
    every = made[0]
    for rows in made[1:]:
        every = every.unionByName(rows)
    got = sums.read()
    for query in (dashboard.count, dashboard.seller, dashboard.hot_flat, dashboard.stock):
        assert values(query(got), *query(got).columns) == values(query(every), *query(every).columns)
    assert got.count() <= 96 and len([p for p in (tmp_path / "rollups" / "product_stats").iterdir() if p.name[0] in "dv"]) <= 7 < 7 + 2
    visitors = spark.createDataFrame([("1", f"2024-01-01 00:0{m}:{s}0", 1, 2, 1, 0, 5) for m in range(3) for s in range(1, 4)], "is_new string, edt string, uv_ct long, pv_ct long, sv_ct long, uj_ct long, dur_sum long")
    own = rollups.rollup(spark, str(tmp_path), "visitor_stats")
    own.add(rollups.prepared("visitor_stats", visitors), 0)
    assert own.read().count() == 3
    for query in (dashboard.traffic, dashboard.visitors):
        assert values(query(own.read()), *query(visitors).columns) == values(query(visitors), *query(visitors).columns)


def test_words_of_a_lexicon(spark):
    cut = Lexicon(["中国", "中国人", "国人", "人民", "iPhone", "red"]).cut
    assert cut("中国人民iphone13 Redder，好") == ["中国人", "中国", "国人", "人民", "iphone", "13", "red", "der", "好"]
    assert cut(None) == cut("") == cut("，。 ") == [] and Lexicon([]).cut("ab 中文") == ["ab", "中", "文"]
    rows = spark.createDataFrame([("中国人", 0), (None, 1), ("人民币", 2)], "fullword string, s long").withColumn("et", F.timestamp_seconds("s"))
    words = spark.createDataFrame([("中国",), ("国人",), ("人民",), (None,)], "word string")
    got = stats.keyword_stats(spark, rows, ts=F.lit(0), cut=lexicon_words(words))
    assert values(got, "keyword", "ct") == [("中国", 1), ("人民", 1), ("国人", 1), ("币", 1)]


def test_late_rows_by_their_own_watermark(spark):
    rnd = random.Random(6)
    rows = [(i, max(0, 700 * i + rnd.randrange(-9000, 2000))) for i in range(500)] + [(500, None)]
    df = spark.createDataFrame(rows, "offset long, ms long").withColumn("et", F.timestamp_millis("ms"))
    greatest, late = None, []
    for i, ms in rows:
        if ms is None or (greatest is not None and (ms // 5000 + 1) * 5000 <= greatest - 2000):
            late.append((i,))
        if ms is not None:
            greatest = ms if greatest is None else max(greatest, ms)
    got = split_late(df, "et", "offset", "5 seconds", "2 seconds")
    assert values(got[1], "offset") == sorted(late, key=repr) and 20 < len(late) < 400
    assert got[0].count() == 501 - len(late) and got[0].columns == df.columns
    small = with_watermark(df, "et", "offset", "2 seconds", block=7)
    assert values(small, "offset", "_watermark") == values(with_watermark(df, "et", "offset", "2 seconds"), "offset", "_watermark")
    first, rest = df.filter("offset < 200"), df.filter("offset >= 200")
    seen = F.lit(first.agg(F.max("et")).first()[0])  # batch by batch
    assert sorted(values(split_late(first, "et", "offset", "5 seconds", "2 seconds")[1], "offset") + values(split_late(rest, "et", "offset", "5 seconds", "2 seconds", seen)[1], "offset"), key=repr) == sorted(late, key=repr)


def test_a_job_keeps_files_sums_and_the_database(spark, tmp_path):
    page = lambda text, ms: {"page": {"last_page_id": "search", "item": text}, "ts": ms}
    drop(tmp_path / "topics" / "dwd_page_log", [page("red shoe", 1000), page("red", 2000), page("end", 900_000)], 1)
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    jobs = Jobs(spark, str(tmp_path), database=url)
    jobs.keyword_stats().awaitTermination()
    drop(tmp_path / "topics" / "dwd_page_log", [page("red", 901_000), page("x", 9_000_000)], 1, "more")
    jobs.keyword_stats().awaitTermination()
    want = [("end", 1), ("red", 1), ("red", 2), ("shoe", 1)]
    assert values(spark.read.parquet(str(tmp_path / "stats" / "keyword_stats")), "keyword", "ct") == want
    assert sorted((r[0], r[1]) for r in spark.read.format("jdbc").options(url=url, dbtable="keyword_stats").load().select("keyword", "ct").collect()) == want
    assert values(dashboard.keywords(jobs.sums("keyword_stats")), "name", "value") == [("end", 10), ("red", 30), ("shoe", 10)]


def test_an_order_of_several_batches_counts_once(spark, tmp_path):
    """Distinct orders of a stream: state is a row for each order of a window and product."""
    row = lambda order, amount, at: {"order_id": order, "province_id": 1, "split_total_amount": amount, "et": f"2024-01-01T00:00:{at:02d}.000Z"}
    for n, rows in enumerate(([row(1, 1.5, 1), row(2, 1, 2)], [row(1, 2, 3), row(None, 1, 3)], [row(9, 1, 50)], [row(9, 1, 59)])):
        drop(tmp_path / "topics" / "dwm_order_wide" / f"batch-{n}", rows, 1)
        Jobs(spark, str(tmp_path)).province_stats().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "stats" / "province_stats")).filter("stt = '2024-01-01 00:00:00'").collect()
    assert [(r.order_count, float(r.order_amount)) for r in got] == [(2, 5.5)]


def test_a_batch_that_dies_shows_nothing(spark, tmp_path):
    rows, path = spark.range(4).select(F.col("id").cast("string")), str(tmp_path / "out" / "batch-0")

    def dies(writer, to):
        writer.text(to)
        raise RuntimeError("dies")

    with pytest.raises(RuntimeError):
        topics.write_once(rows, path, dies)
    assert not list((tmp_path / "out").glob("batch-*"))
    assert spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "out")).count() == 0
    for _ in range(2):
        topics.write_once(rows, path, lambda w, p: w.text(p))
    assert spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "out")).count() == 4
