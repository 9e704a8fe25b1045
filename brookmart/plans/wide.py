"""Order and payment wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import age, to_millis
from ..operators.joins import Keyed, interval_join, lookup

#: Columns of dimensions that the wide table reads: dim -> (key in the wide table, {dim column: wide column}).
DIMS = {
    "province": ("province_id", {"name": "province_name", "area_code": "province_area_code", "iso_code": "province_iso_code", "iso_3166_2": "province_3166_2_code"}),
    "sku": ("sku_id", {"sku_name": "sku_name", "category3_id": "category3_id", "spu_id": "spu_id", "tm_id": "tm_id"}),
    "spu": ("spu_id", {"spu_name": "spu_name"}),
    "trademark": ("tm_id", {"tm_name": "tm_name"}),
    "category3": ("category3_id", {"name": "category3_name"}),
}


def with_times(rows: DataFrame) -> DataFrame:
    """create_date, create_hour and create_ts of create_time, and its event time et."""
    parts = F.split("create_time", " ")
    out = rows.withColumns({"create_date": parts[0], "create_hour": F.split(parts[1], ":")[0], "create_ts": to_millis(F.col("create_time"))})
    return out.withColumn("et", F.timestamp_millis("create_ts"))


def order_wide(info: DataFrame, detail: DataFrame, before: str = "5 seconds", after: str = "5 seconds") -> DataFrame:
    """Details joined with their order, if both were made at about the same time. Money of the order that nothing fills is null."""
    o = info.select(*(F.col(c).alias(f"o_{c}") for c in info.columns))
    joined = interval_join(o, detail, F.col("o_id") == F.col("order_id"), "o_et", "et", before, after)
    money = F.lit(None).cast("decimal(16,2)")
    return joined.select(
        F.col("id").alias("detail_id"), "order_id", "sku_id", "order_price", "sku_num", "sku_name", "split_total_amount", "split_activity_amount", "split_coupon_amount",
        F.col("o_province_id").alias("province_id"), F.col("o_order_status").alias("order_status"), F.col("o_user_id").alias("user_id"), F.col("o_total_amount").alias("total_amount"),
        F.col("o_activity_reduce_amount").alias("activity_reduce_amount"), F.col("o_coupon_reduce_amount").alias("coupon_reduce_amount"), F.col("o_original_total_amount").alias("original_total_amount"),
        F.col("o_feight_fee").alias("feight_fee"), money.alias("split_feight_fee"), F.lit(None).cast("string").alias("expire_time"), F.col("o_create_time").alias("create_time"),
        F.lit(None).cast("string").alias("operate_time"), F.col("o_create_date").alias("create_date"), F.col("o_create_hour").alias("create_hour"), F.col("o_et").alias("et"),
    )


def with_dims(wide: DataFrame, dims: dict[str, DataFrame | Keyed], as_of: str | None = None) -> DataFrame:
    """The wide table with the current row of each given dimension: user (age, gender), province, sku, then the sku's spu,
    trademark and category. A miss leaves nulls."""
    if "user" in dims:
        wide = lookup(wide, dims["user"], "user_id", "id", {"birthday": "_birthday", "gender": "user_gender"})
        now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
        wide = wide.withColumn("user_age", age(F.col("_birthday"), now)).drop("_birthday")
    for name, (key, columns) in DIMS.items():
        if name in dims:
            wide = lookup(wide, dims[name], key, "id", columns)
    return wide


def payment_wide(payments: DataFrame, wide: DataFrame, before: str = "15 minutes", after: str = "5 seconds", same_day: bool = False) -> DataFrame:
    """Payments joined with their order's rows made in the given time; of columns with one name, the payment's win.
    same_day: the older way, by the day of both times."""
    p = payments.select(*(F.col(c).alias(f"p_{c}") for c in payments.columns))
    on = F.col("p_order_id") == F.col("order_id")
    if same_day:
        joined = p.join(wide, on & (F.to_date("p_et") == F.to_date("et")))
    else:
        joined = interval_join(p, wide, on, "p_et", "et", before, after)
    own = {"order_id", "user_id", "total_amount"}
    rest = [F.col(c) for c in wide.columns if c not in own and c not in ("et", "create_time", "create_date", "create_hour")]
    return joined.select(
        F.col("p_id").alias("payment_id"), F.col("p_subject").alias("subject"), F.col("p_payment_type").alias("payment_type"), F.col("p_create_time").alias("payment_create_time"), F.col("p_callback_time").alias("callback_time"),
        F.col("p_order_id").alias("order_id"), F.col("p_user_id").alias("user_id"), F.col("p_total_amount").alias("total_amount"), *rest, F.col("create_time").alias("order_create_time"), F.col("p_et").alias("et"),
    )
