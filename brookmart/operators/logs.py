"""Splitting of behaviour logs into start, page and display records, and click and display counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_log(log: DataFrame) -> dict[str, DataFrame]:
    """start: records with a start part; page: all others, unchanged; display: a row for each display of a page, with its
    page_id and nothing else of the record."""
    page = log.filter("start is null")
    shown = page.select(F.explode("displays").alias("d"), F.col("page.page_id").alias("page_id")).select("d.*", "page_id")
    return {"start": log.filter("start is not null"), "page": page, "display": shown}


def clicks_and_displays(page: DataFrame) -> DataFrame:
    """sku_id, ts, click_ct and display_ct: a row for the click on a good's page, and one for each displayed good."""
    hit = (F.col("page.page_id") == "good_detail") & (F.col("page.item_type") == "sku_id")
    click = F.when(hit, F.array(F.struct(F.col("page.item").alias("item"), F.lit(1).alias("click_ct"), F.lit(0).alias("display_ct"))))
    goods = F.filter("displays", lambda d: d["item_type"] == "sku_id")
    shown = F.transform(goods, lambda d: F.struct(d["item"].alias("item"), F.lit(0).alias("click_ct"), F.lit(1).alias("display_ct")))
    none = F.array().cast("array<struct<item:string,click_ct:int,display_ct:int>>")
    # One pass over the record: an explode of both arrays instead of a union of two scans.
    rows = page.select("ts", F.explode(F.concat(F.coalesce(click, none), F.coalesce(shown, none))).alias("x"))
    return rows.select(F.col("x.item").cast("long").alias("sku_id"), "ts", F.col("x.click_ct").cast("long").alias("click_ct"), F.col("x.display_ct").cast("long").alias("display_ct"))
