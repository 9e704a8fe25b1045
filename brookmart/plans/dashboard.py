"""Dashboard queries over the four statistics tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.joins import prefix_join
from ..operators.reshape import nest, transpose
from ..schemas import KEYWORD_WEIGHTS

# Labels of the sales ranks, by the last rank of each.
BUCKETS = {20: "0%-60%", 30: "60%-30%", 34: "30%-100%"}
VISITOR_ITEMS = ["uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum"]


def count(products: DataFrame) -> DataFrame:
    """The whole order amount."""
    return products.agg(F.sum("order_amount").alias("order_amount"))


def seller(products: DataFrame) -> DataFrame:
    """Trademarks with sales, the greatest first."""
    sums = products.groupBy("tm_id", "tm_name").agg(F.sum("order_amount").alias("value")).filter("value > 0")
    return sums.orderBy(F.desc("value"), "tm_name").select(F.col("tm_name").alias("name"), "value")


def hot_flat(products: DataFrame) -> DataFrame:
    """Order counts of each category, spu and sku."""
    return products.groupBy("category3_name", "spu_name", "sku_name").agg(F.sum("order_ct").alias("value"))


def hot(products: DataFrame) -> DataFrame:
    """name and children: categories of spus (with their sum) of skus."""
    sku = hot_flat(products)
    spu = sku.groupBy("category3_name", "spu_name").agg(F.sum("value").alias("value"), F.sort_array(F.collect_list(F.struct("sku_name", "value"))).alias("children"))
    named = spu.select(F.col("category3_name").alias("name"), F.struct(F.col("spu_name").alias("name"), "value", "children").alias("x")).select("name", "x")
    return named.groupBy("name").agg(F.sort_array(F.collect_list("x")).alias("children"))


def stock(products: DataFrame, longest: int = 15) -> DataFrame:
    """Comments and good comments of each spu; names longer than 15 characters are cut at their first space."""
    name = F.when(F.length("spu_name") > longest, F.split("spu_name", " ")[0]).otherwise(F.col("spu_name"))
    sums = products.groupBy("spu_id", "spu_name").agg(F.sum("comment_ct").alias("stock"), F.sum("good_comment_ct").alias("sales"))
    return sums.select(name.alias("name"), "stock", "sales")


def map_ranks(provinces: DataFrame, cities: DataFrame) -> DataFrame:
    """Provinces by ascending sales with the name of the first city table's province that theirs begins with, rank and label."""
    sums = provinces.groupBy("province_id", "province_name").agg(F.sum("order_amount").alias("value"))
    hit = prefix_join(sums, cities, "province_name", "pname", "pid", ["province_id", "province_name"])
    ranked = hit.withColumn("rank", F.row_number().over(Window.orderBy("value", "province_id")))  # a row a province
    label = F.lit(None).cast("string")
    for last, name in sorted(BUCKETS.items(), reverse=True):
        label = F.when(F.col("rank") <= last, name).otherwise(label)
    return ranked.withColumn("label", label).filter("label is not null")


def map_cities(provinces: DataFrame, cities: DataFrame, seed: int = 0) -> DataFrame:
    """name and children: for each label a seeded third of its provinces' cities with their coordinates."""
    rows = map_ranks(provinces, cities).select("label", F.explode("cities").alias("c"))
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col("c.cname")))
    order = Window.partitionBy("label").orderBy(drawn, "c.cname")
    every = Window.partitionBy("label")
    some = rows.withColumns({"_r": F.row_number().over(order), "_n": F.count("*").over(every)}).filter(F.col("_r") <= F.floor(F.col("_n") / 3))
    return nest(some.select(F.col("label").alias("name"), F.col("c.cname").alias("city"), F.array("c.lng", "c.lat").alias("value")), ["name"], "children", "city", "value")


def visitors(stats: DataFrame) -> DataFrame:
    """item, is_old and is_new: the visitor sums of returning and new visitors."""
    sums = stats.groupBy("is_new").agg(*(F.sum(c).alias(c) for c in VISITOR_ITEMS))
    return transpose(sums, "is_new", {"0": "is_old", "1": "is_new"}, VISITOR_ITEMS)


def traffic(stats: DataFrame) -> DataFrame:
    """Unique visitors of each minute, by the window's end; minutes are named without leading zeros."""
    edt = F.to_timestamp("edt", "yyyy-MM-dd HH:mm:ss")
    sums = stats.groupBy(F.to_date(edt).alias("d"), F.hour(edt).alias("h"), F.minute(edt).alias("m")).agg(F.sum("uv_ct").alias("value"))
    return sums.orderBy("d", "h", "m").select(F.concat(F.col("d").cast("string"), F.lit(" "), F.col("h").cast("string"), F.lit(":"), F.col("m").cast("string")).alias("name"), "value")


def keywords(stats: DataFrame) -> DataFrame:
    """Words with their counts weighted by source, ordered by the plain counts."""
    weight = F.lit(0)
    for source, w in KEYWORD_WEIGHTS.items():
        weight = F.when(F.col("source") == source, w).otherwise(weight)
    sums = stats.groupBy("keyword").agg(F.sum(F.col("ct") * weight).alias("value"), F.sum("ct").alias("_ct"))
    return sums.orderBy(F.desc("_ct"), "keyword").select(F.col("keyword").alias("name"), "value")


def documents(rows: DataFrame) -> DataFrame:
    """A widget's rows with their nested columns as JSON."""
    nested = {f.name for f in rows.schema if f.dataType.typeName() in ("array", "struct", "map")}
    return rows.select(*(F.to_json(c).alias(c) if c in nested else c for c in rows.columns))
