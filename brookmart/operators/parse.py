"""Parsing of JSON records and change envelopes, with dirty records apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse(raw: DataFrame, schema: T.StructType | str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, dirty): records of the JSON column as columns of the schema, and the rows whose value is no JSON object.

    Other columns of raw stay, unless the schema has them too. Null values are dirty.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*schema.fields, T.StructField("_dirty", T.StringType())])
    parsed = raw.withColumn("_r", F.from_json(value, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_dirty"}))
    bad = F.col(value).isNull() | F.col("_r").isNull() | F.col("_r._dirty").isNotNull()
    names = [f.name for f in schema.fields]
    rest = [c for c in raw.columns if c != value and c not in names]
    return parsed.filter(~bad).select(*rest, *(F.col(f"_r.{n}").alias(n) for n in names)), parsed.filter(bad).select(*raw.columns)


def parse_strict(raw: DataFrame, schema: T.StructType | str, value: str = "value") -> DataFrame:
    """Columns of the schema, after raw's others; a record that is no JSON fails the job."""
    rest = [c for c in raw.columns if c != value]
    return raw.select(*rest, F.from_json(value, schema, {"mode": "FAILFAST"}).alias("r")).select(*rest, "r.*")


def change_events(envelopes: DataFrame, snapshot_as_insert: bool = False) -> DataFrame:
    """Change events of envelopes (topic 'server.database.table', before, after, op): missing images are empty maps, and the
    operations are named insert, update, delete and read (read counts as insert if asked for). ts_ms and pos stay."""
    parts = F.split("topic", r"\.")
    op = F.lower("op")
    kind = F.when(op.isin("c", "create"), "insert").when(op.isin("u", "update"), "update").when(op.isin("d", "delete"), "delete")
    kind = kind.when(op.isin("r", "read"), "insert" if snapshot_as_insert else "read").otherwise(op)
    empty = F.create_map().cast("map<string,string>")
    return envelopes.select(parts[1].alias("database"), parts[2].alias("tableName"), F.coalesce("before", empty).alias("before"), F.coalesce("after", empty).alias("after"), kind.alias("type"), *(F.col(c) if c in envelopes.columns else F.lit(None).cast("long").alias(c) for c in ("ts_ms", "pos")))
