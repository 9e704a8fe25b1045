"""Nesting, transposing and bucketing of small results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nest(rows: DataFrame, keys: Sequence[str], children: str, *fields: str) -> DataFrame:
    """A row for each key with its rows' fields as a sorted array of structs."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(children))


def transpose(rows: DataFrame, by: str, values: Mapping[str, str], items: Sequence[str]) -> DataFrame:
    """A row for each item, a column for each value of `by` (value -> column name); missing cells are 0."""
    stacked = rows.select(by, F.explode(F.map_from_arrays(F.array(*map(F.lit, items)), F.array(*(F.col(i).cast("double") for i in items)))).alias("item", "_v"))
    cells = [F.coalesce(F.sum(F.when(F.col(by) == v, F.col("_v"))), F.lit(0.0)).alias(name) for v, name in values.items()]
    return stacked.groupBy("item").agg(*cells)
