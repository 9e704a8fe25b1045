"""Sums that grow with their keys and not with time: what dashboards read instead of all windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .topics import file_system, write_once

#: Keys and sums of the statistics that the dashboards ask for: a row for each product, province, kind of visitor and minute, or word.
ROLLUPS = {
    "product_stats": (["tm_id", "tm_name", "category3_name", "spu_id", "spu_name", "sku_name"], ["order_amount", "order_ct", "comment_ct", "good_comment_ct"]),
    "province_stats": (["province_id", "province_name"], ["order_amount", "order_count"]),
    "visitor_stats": (["is_new", "edt"], ["uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum"]),
    "keyword_stats": (["keyword", "source"], ["ct"]),
}
#: edt of visitors to the minute.
MINUTE = "concat(substr(edt, 1, 16), ':00')"


class Rollup:
    """Sums by keys in a folder: a batch's own sums (d<number>), and after every COMPACT of them all so far (v<number>).
    Batches come in ascending order; one that runs again is found there, or below the last whole one, and adds nothing."""

    COMPACT = 16

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], sums: Sequence[str]):
        self.spark, self.path, self.keys, self.sums = spark, path.rstrip("/"), list(keys), list(sums)
        self.fs, self.of = file_system(spark, self.path)

    def parts(self) -> list[tuple[int, str]]:
        """Numbers and names of the folders to add up, in order."""
        if not self.fs.exists(self.of(self.path)):
            return []
        names = [x.getPath().getName() for x in self.fs.listStatus(self.of(self.path))]
        found = sorted((int(n[1:]), n) for n in names if n[0] in "dv" and n[1:].isdigit())
        base = max((n for n, x in found if x[0] == "v"), default=-1)
        return [(n, x) for n, x in found if n > base or x == f"v{base}"]

    def _summed(self, rows: DataFrame) -> DataFrame:
        """Sums by keys; decimals have one type, however often they are added up."""
        out = rows.groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in self.sums))
        return out.select(*(F.col(c).cast("decimal(38,2)").alias(c) if t.startswith("decimal") else c for c, t in out.dtypes))

    def read(self) -> DataFrame | None:
        """The sums so far; None if there are none."""
        found = self.parts()
        if not found:
            return None
        rows = self.spark.read.parquet(*(f"{self.path}/{x}" for _, x in found))
        return self._summed(rows)

    def add(self, rows: DataFrame, batch: int) -> None:
        found = self.parts()
        if any(n >= batch and x[0] == "v" for n, x in found):
            return
        if not any(n == batch for n, _ in found):
            write_once(self._summed(rows), f"{self.path}/d{batch}", lambda w, p: w.parquet(p))
            found = self.parts()
        if sum(x[0] == "d" for _, x in found) >= self.COMPACT:
            write_once(self.read(), f"{self.path}/v{batch}", lambda w, p: w.parquet(p))
            for x in self.fs.listStatus(self.of(self.path)):  # readers may still have the parts of the last whole one
                name = x.getPath().getName()
                if name[0] in "dv" and name[1:].isdigit() and int(name[1:]) < min(n for n, _ in found):
                    self.fs.delete(x.getPath(), True)


def rollup(spark: SparkSession, root: str, name: str) -> Rollup:
    return Rollup(spark, f"{root.rstrip('/')}/rollups/{name}", *ROLLUPS[name])


def prepared(name: str, rows: DataFrame) -> DataFrame:
    """A batch of statistics as its roll-up takes it."""
    return rows.withColumn("edt", F.expr(MINUTE)) if name == "visitor_stats" else rows
