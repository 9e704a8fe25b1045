"""Visitor state in closed form: is_new repair, daily unique visits and bounces, as one window pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts in which a visitor's rows are ranked first.
SALTS = 32


def repair_is_new(rows: DataFrame, visitor: str, flag: str, order: Sequence[str], keep: int = 2) -> DataFrame:
    """Of a visitor's rows that claim is_new = '1', the first `keep` in arrival order do; later ones become '0'. Rows
    without a visitor stay as they are."""
    # Only rows that can change are shuffled. A visitor's rows are ranked in SALTS parts first: what is not among the first of
    # its part is not among the first of all, so a very busy visitor sends a few rows of each part to one task.
    claims = F.coalesce((F.col(flag) == "1") & F.col(visitor).isNotNull(), F.lit(False))
    salt = F.pmod(F.xxhash64(*order), F.lit(SALTS))
    part = Window.partitionBy(visitor, "_salt").orderBy(*order)
    ranked = rows.filter(claims).withColumn("_salt", salt).withColumn("_r", F.row_number().over(part))
    whole = Window.partitionBy(visitor).orderBy(*order)
    first = ranked.filter(F.col("_r") <= keep).withColumn("_r", F.row_number().over(whole))
    kept = first.withColumn(flag, F.when(F.col("_r") > keep, "0").otherwise(F.col(flag)))
    later = ranked.filter(F.col("_r") > keep).withColumn(flag, F.lit("0"))
    return kept.unionByName(later).select(*rows.columns).unionByName(rows.filter(~claims))


def unique_visits(entries: DataFrame, visitor: str, day: Column, order: Sequence[str]) -> DataFrame:
    """Entry pages whose day differs from that of the visitor's entry page before. Rows without a visitor or a day are nobody's
    visits: they are left out."""
    w = Window.partitionBy(visitor).orderBy(*order)
    marked = entries.withColumn("_day", day).filter(F.col(visitor).isNotNull() & F.col("_day").isNotNull())
    return marked.withColumn("_before", F.lag("_day").over(w)).filter(F.col("_before").isNull() | (F.col("_before") != F.col("_day"))).drop("_day", "_before")


def bounces(pages: DataFrame, visitor: str, entry: Column, time: str, order: Sequence[str], within: str = "10 seconds", piece: str = "1 day") -> DataFrame:
    """Entry pages that no other page follows in time: the visitor's next page is missing, an entry, or `within` later. Times
    ascend along the order columns. Rows without a visitor or a time are left out, as bounces and as what follows.

    piece: a visitor's rows are looked at in pieces of so much time, so that a very busy one is no single task's work; the
    last row of a piece is followed by the first of the visitor's next one.
    """
    known = pages.withColumn("_e", entry).filter(F.col(visitor).isNotNull() & F.col(time).isNotNull())
    known = known.withColumn("_p", F.window(time, piece)["start"])
    w = Window.partitionBy(visitor, "_p").orderBy(*order)
    marked = known.withColumn("_n", F.lead(F.struct("_e", F.col(time).alias("_t"))).over(w))
    first = known.groupBy(F.col(visitor).alias("_v"), F.col("_p").alias("_q")).agg(F.min(F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), "_e", F.col(time).alias("_t"))).alias("_f"))
    later = F.lead(F.struct("_f._e", "_f._t")).over(Window.partitionBy("_v").orderBy("_q"))
    joined = marked.join(first.withColumn("_l", later).drop("_f"), (F.col(visitor) == F.col("_v")) & (F.col("_p") == F.col("_q")))
    after = F.coalesce("_n", "_l")
    late = after["_t"] >= F.col(time) + F.expr(f"INTERVAL {within}")
    return joined.filter(F.col("_e") & (after.isNull() | after["_e"] | late)).select(*pages.columns)
