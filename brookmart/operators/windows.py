"""Tumbling event-time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import STAMP


def tumble(rows: DataFrame, time: str, size: str, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregates by window and keys, with the window's bounds as stt and edt. Partial aggregation comes before the shuffle."""
    out = rows.groupBy(F.window(time, size).alias("_w"), *keys).agg(*aggregates)
    return out.withColumns({"stt": F.date_format("_w.start", STAMP), "edt": F.date_format("_w.end", STAMP)}).drop("_w")
