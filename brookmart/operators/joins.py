"""Interval joins, dimension lookups and the prefix join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def interval_join(left: DataFrame, right: DataFrame, on: Column, left_time: str, right_time: str, before: str, after: str) -> DataFrame:
    """Inner join of rows that meet `on` with right_time in [left_time - before, left_time + after], both ends included.

    The equality in `on` is the shuffle key; the interval is a condition of the same join. Watermarks on both sides bound
    the state if the inputs are streams.
    """
    lt, rt = F.col(left_time), F.col(right_time)
    return left.join(right, on & (rt >= lt - F.expr(f"INTERVAL {before}")) & (rt <= lt + F.expr(f"INTERVAL {after}")))


class Keyed(Protocol):
    """A dimension that gives the rows which some keys may find, such as sources.dims.Dim."""

    def near(self, keys: DataFrame) -> DataFrame | None: ...


def lookup(rows: DataFrame, dim: DataFrame | Keyed, key: str, dim_key: str, columns: Mapping[str, str]) -> DataFrame:
    """Left outer lookup: rows with the dim's columns (source name -> new name), null on a miss and for columns that the
    dim does not have; columns that the rows have are replaced. The dim has one row a key. Catalyst broadcasts a dim only
    below its size threshold; of a keyed dim only what the rows' keys may find is read (rows are read for their keys first,
    so a caller keeps them)."""
    found = dim if isinstance(dim, DataFrame) else dim.near(rows.select(key))
    new = set(columns.values())
    kept = [c for c in rows.columns if c not in new]
    if found is None:
        return rows.select(*kept, *(F.lit(None).cast("string").alias(b) for b in columns.values()))
    side = found.select(F.col(dim_key).alias("_k"), *((F.col(a) if a in found.columns else F.lit(None).cast("string")).alias(f"_v_{b}") for a, b in columns.items()))
    joined = rows.join(side, F.col(key).cast("string") == F.col("_k").cast("string"), "left").drop("_k")
    return joined.select(*kept, *(F.col(f"_v_{b}").alias(b) for b in columns.values()))


def prefix_join(rows: DataFrame, names: DataFrame, text: str, prefix: str, rank: str, id_: Sequence[str]) -> DataFrame:
    """Each row with the first name (by rank) that its text begins with. Instead of comparing every row with every name, a
    row is joined on its prefixes of the lengths that occur, so the join is an equality."""
    lengths = names.agg(F.coalesce(F.array_sort(F.collect_set(F.length(prefix))), F.array().cast("array<int>")).alias("_n"))
    cut = rows.crossJoin(F.broadcast(lengths)).withColumn("_p", F.explode(F.transform("_n", lambda n: F.substring(F.col(text), F.lit(1), n)))).filter(F.length("_p") > 0)
    hit = cut.join(names, F.col("_p") == F.col(prefix)).drop("_n", "_p")
    first = Window.partitionBy(*id_).orderBy(rank)
    return hit.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
