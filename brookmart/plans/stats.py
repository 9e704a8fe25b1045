"""Visitor, product, province and keyword statistics over tumbling windows; batch and streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import STAMP, WORD, event_time, is_entry, to_millis, words
from ..operators.joins import Keyed, lookup
from ..operators.windows import tumble
from ..schemas import GOOD_APPRAISE, KEYWORD_STATS, PRODUCT_STATS, PROVINCE_STATS, VISITOR_STATS

VISITOR_KEYS = ["ar", "ch", "is_new", "vc"]
VISITOR_COUNTS = ["uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum"]


def visitor_rows(page: DataFrame, unique: DataFrame, bounce: DataFrame, compat: bool = False) -> DataFrame:
    """Page, unique-visit and bounce records (nested common and page parts, ts) as rows of the visitor counts.
    compat: page rows count as bounces too, as the earlier system had it."""

    def rows(df: DataFrame, **counts: Column) -> DataFrame:
        given = [counts.get(c, F.lit(0)).cast("long").alias(c) for c in VISITOR_COUNTS]
        return df.select("common.vc", "common.ch", "common.ar", "common.is_new", "ts", *given)

    entered = F.when(is_entry(F.col("page.last_page_id")), 1).otherwise(0)
    seen = rows(page, pv_ct=F.lit(1), sv_ct=entered, dur_sum=F.coalesce("page.during_time", F.lit(0)), uj_ct=F.lit(int(compat)))
    return rows(unique, uv_ct=F.lit(1)).unionByName(rows(bounce, uj_ct=F.lit(1))).unionByName(seen)


def visitor_stats(rows: DataFrame, size: str = "10 seconds", delay: str = "11 seconds", keys: Sequence[str] = VISITOR_KEYS) -> DataFrame:
    """Sums of the visitor counts by window and keys; ts is the least of the window's."""
    timed = rows.withColumn("et", event_time(F.col("ts")))
    timed = timed.withWatermark("et", delay) if rows.isStreaming else timed
    out = tumble(timed, "et", size, keys, *(F.sum(c).alias(c) for c in VISITOR_COUNTS), F.min("ts").alias("ts"))
    return out.select(*(c for c in VISITOR_STATS if c in out.columns))


#: Measures of a product row, zero where a source doesn't give them.
PRODUCT_COUNTS = {
    "display_ct": "long", "click_ct": "long", "favor_ct": "long", "cart_ct": "long", "order_sku_num": "long", "order_amount": "decimal(16,2)", "payment_amount": "decimal(16,2)",
    "refund_amount": "decimal(16,2)", "comment_ct": "long", "good_comment_ct": "long",
}
PRODUCT_ORDERS = ["order_id", "paid_order_id", "refund_order_id"]


def product_rows(df: DataFrame, ts: Column, **given: Column) -> DataFrame:
    """Rows of sku_id, ts, the product measures and the order ids to count."""
    counts = [given.get(c, F.lit(0)).cast(t).alias(c) for c, t in PRODUCT_COUNTS.items()]
    return df.select(F.col("sku_id").cast("long").alias("sku_id"), ts.alias("ts"), *counts, *(given.get(c, F.lit(None)).cast("long").alias(c) for c in PRODUCT_ORDERS))


def product_sources(clicks: DataFrame, favor: DataFrame, cart: DataFrame, order: DataFrame, payment: DataFrame, refund: DataFrame, comment: DataFrame) -> DataFrame:
    """The union of the seven sources. An order's row carries the whole order's amount, a payment's its split amount. Rows that
    carry their event time (et) are not parsed for it again."""
    made = to_millis(F.col("create_time"))

    def at(rows: DataFrame, text: str) -> Column:
        return F.unix_millis("et") if "et" in rows.columns else to_millis(F.col(text))

    parts = [
        product_rows(clicks, F.col("ts"), click_ct=F.col("click_ct"), display_ct=F.col("display_ct")),
        product_rows(favor, made, favor_ct=F.lit(1)),
        product_rows(cart, made, cart_ct=F.lit(1)),
        product_rows(order, at(order, "create_time"), order_sku_num=F.col("sku_num"), order_amount=F.col("total_amount"), order_id=F.col("order_id")),
        product_rows(payment, at(payment, "payment_create_time"), payment_amount=F.col("split_total_amount"), paid_order_id=F.col("order_id")),
        product_rows(refund, made, refund_amount=F.col("refund_amount"), refund_order_id=F.col("order_id")),
        product_rows(comment, made, comment_ct=F.lit(1), good_comment_ct=F.when(F.col("appraise") == GOOD_APPRAISE, 1).otherwise(0)),
    ]
    return reduce(DataFrame.unionByName, parts)


def product_stats(rows: DataFrame, size: str = "10 seconds", delay: str = "2 seconds", compat: bool = False) -> DataFrame:
    """Sums by window and sku, and exact counts of distinct orders, paid orders and refunded orders. A row has one order id
    at most. compat: a window of a single row counts no orders, as the earlier system had it."""
    timed = rows.filter("sku_id is not null").withColumn("et", event_time(F.col("ts")))
    orders = {"order_ct": "order_id", "paid_order_ct": "paid_order_id", "refund_order_ct": "refund_order_id"}
    sums = [F.sum(c).alias(c) for c in PRODUCT_COUNTS]
    timed = timed.withWatermark("et", delay) if rows.isStreaming else timed
    # By order first, so that no row is multiplied for its distinct counts: then an order is one row of its window. A stream
    # chains the two, and its state is a row for each order of a window, however many a product has.
    each = timed.groupBy(F.window("et", size).alias("_w"), "sku_id", *PRODUCT_ORDERS).agg(*sums, F.min("ts").alias("ts"), F.count("*").alias("_n"))
    counts = [F.count(c).alias(n) for n, c in orders.items()]
    out = tumble(each.withColumn("et", F.window_time("_w")).drop("_w"), "et", size, ["sku_id"], *sums, *counts, F.min("ts").alias("ts"), F.sum("_n").alias("_n"))
    if compat:
        out = out.withColumns({n: F.when(F.col("_n") == 1, F.lit(0).cast("long")).otherwise(F.col(n)) for n in orders})
    return out.drop("_n")


def product_dims(stats: DataFrame, sku: DataFrame | Keyed, spu: DataFrame | Keyed, category3: DataFrame | Keyed, trademark: DataFrame | Keyed) -> DataFrame:
    """Names and prices of the aggregate's products: looked up after the aggregation, once a window and sku."""
    out = lookup(stats, sku, "sku_id", "id", {"sku_name": "sku_name", "price": "sku_price", "spu_id": "spu_id", "tm_id": "tm_id", "category3_id": "category3_id"})
    out = lookup(out, spu, "spu_id", "id", {"spu_name": "spu_name"})
    out = lookup(out, category3, "category3_id", "id", {"name": "category3_name"})
    return lookup(out, trademark, "tm_id", "id", {"tm_name": "tm_name"}).select(*PRODUCT_STATS)


def over(spark: SparkSession, rows: DataFrame, sql: Callable[[str], str]) -> DataFrame:
    """A query in SQL over rows, under a view's name that no other has and that is gone afterwards."""
    view = f"rows_{uuid4().hex}"
    rows.createOrReplaceTempView(view)
    try:
        return spark.sql(sql(view))
    finally:
        spark.catalog.dropTempView(view)


def province_rows(wide: DataFrame) -> DataFrame:
    """Each row of the wide table as a row of the province statistics that counts one order."""
    return wide.select("province_id", "province_name", "province_area_code", "province_iso_code", "province_3166_2_code", F.col("split_total_amount").alias("order_amount"), F.lit(1).cast("long").alias("order_count"), F.unix_millis("et").alias("ts"))


def province_stats(spark: SparkSession, wide: DataFrame, size: str = "10 seconds", delay: str = "1 second", compat: bool = False, ts: Column | None = None) -> DataFrame:
    """Orders and amounts by window and province, in SQL over a view. compat: split amounts are rounded to whole units."""
    timed = wide.withWatermark("et", delay) if wide.isStreaming else wide
    kind = "DECIMAL(10,0)" if compat else "DECIMAL(16,2)"
    keys = "province_id, province_name, province_area_code, province_iso_code, province_3166_2_code"
    # A stream counts distinct orders by order first; its state is a row for each order of a window.
    by_order = f"(SELECT window_time(w) AS et, {keys}, order_id, amount FROM (SELECT window(et, '{size}') AS w, {keys}, order_id, sum(CAST(split_total_amount AS {kind})) AS amount FROM {{view}} GROUP BY window(et, '{size}'), {keys}, order_id))"
    source, amount, count = (by_order, "amount", "count(order_id)") if wide.isStreaming else ("{view}", f"CAST(split_total_amount AS {kind})", "count(DISTINCT order_id)")
    rows = over(spark, timed, lambda view: f"""
        SELECT date_format(window(et, '{size}').start, '{STAMP}') AS stt, date_format(window(et, '{size}').end, '{STAMP}') AS edt, {keys}, sum({amount}) AS order_amount, {count} AS order_count
        FROM {source.format(view=view)} GROUP BY window(et, '{size}'), {keys}""")
    return rows.withColumn("ts", F.unix_millis(F.current_timestamp()) if ts is None else ts).select(*PROVINCE_STATS)


def keyword_stats(spark: SparkSession, searches: DataFrame, splitter: str | None = None, size: str = "10 seconds", delay: str = "1 second", ts: Column | None = None, cut: Callable[[Column], Column] = words) -> DataFrame:
    """Words searched for, counted by window, in SQL over a view of (fullword, et). splitter: a registered table function
    from a string to rows (word); without one, cut makes an array of words: the built-in tokenizer, or a lexicon's
    (functions.segment)."""
    timed = searches.withWatermark("et", delay) if searches.isStreaming else searches
    timed = timed if splitter else timed.withColumn("words", cut(F.col("fullword")))
    lateral = f"LATERAL {splitter}(fullword)" if splitter else "LATERAL explode(words) AS t(word)"
    rows = over(spark, timed, lambda view: f"""
        SELECT word AS keyword, count(*) AS ct, 'SEARCH' AS source, date_format(window(et, '{size}').start, '{STAMP}') AS stt, date_format(window(et, '{size}').end, '{STAMP}') AS edt
        FROM {view}, {lateral} GROUP BY window(et, '{size}'), word""")
    return rows.withColumn("ts", F.unix_millis(F.current_timestamp()) if ts is None else ts).select(*KEYWORD_STATS)


def searches(page: DataFrame, *keep: str) -> DataFrame:
    """Searched items of page records: pages reached from the search page, with an item. keep: columns that stay."""
    hit = (F.col("page.last_page_id") == "search") & F.col("page.item").isNotNull()
    return page.filter(hit).select(*keep, F.col("page.item").alias("fullword"), event_time(F.col("ts")).alias("et"))


def register_splitter(spark: SparkSession, name: str = "splitWord") -> None:
    """A table function from a string to its words, for SQL's LATERAL; rows go to and from it in Arrow batches."""
    import regex
    from pyspark.sql.functions import udtf

    word = regex.compile(r"(?V1)" + WORD.replace("IsHan", "Han"))

    class SplitWord:
        def eval(self, text: str):
            for m in word.finditer((text or "").lower()):
                yield (m[1],)

    spark.udtf.register(name, udtf(SplitWord, returnType="word string", useArrow=True))
