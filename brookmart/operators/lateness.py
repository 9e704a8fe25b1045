"""Late rows by each row's own watermark, with the late ones set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block: the greatest time so far is known of blocks first, then within each.
BLOCK = 65_536


def with_watermark(rows: DataFrame, time: str, offset: str, delay: str, seen: Column | None = None, block: int = BLOCK) -> DataFrame:
    """rows with _watermark: the greatest time of the rows before (in the order of their offsets, which are whole numbers) less
    the delay; null where there is none. seen: the greatest time of what came before these rows. Rows without a time
    move nothing.

    The order is of all rows, but no task sorts more than the rows of a block: a block's greatest time is a partial
    aggregate, and only a row a block is put in order as a whole.
    """
    placed = rows.withColumn("_b", F.floor(F.col(offset) / block))
    most = placed.groupBy(F.col("_b").alias("_k")).agg(F.max(time).alias("_m"))  # a row a block
    before = F.max("_m").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))
    known = most.select("_k", F.greatest(before, *([] if seen is None else [seen]), F.lit(None).cast("timestamp")).alias("_p"))
    own = F.max(time).over(Window.partitionBy("_b").orderBy(offset).rowsBetween(Window.unboundedPreceding, -1))
    joined = placed.withColumn("_own", own).join(known, F.col("_b") == F.col("_k"))
    return joined.withColumn("_watermark", F.greatest("_own", "_p") - F.expr(f"INTERVAL {delay}")).select(*rows.columns, "_watermark")


def split_late(rows: DataFrame, time: str, offset: str, size: str, delay: str, seen: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(in time, late): a row is late if its window of this size ends at or before its own watermark, so that the window was
    complete when it came. Rows without a time are late."""
    marked = with_watermark(rows, time, offset, delay, seen)
    end = F.window(F.coalesce(time, F.timestamp_seconds(F.lit(0))), size)["end"]  # a window of nothing would drop the row
    late = F.col(time).isNull() | F.coalesce(end <= F.col("_watermark"), F.lit(False))
    marked = marked.withColumn("_late", late)
    return marked.filter(~F.col("_late")).drop("_late", "_watermark"), marked.filter("_late").drop("_late", "_watermark")
