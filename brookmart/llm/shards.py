"""Sharding by weighted rendezvous hashing, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a sub-range of a shard, and the least number of sub-ranges; they are numbered side by side.
PART_ROWS, PARTS = 250_000, 64


def draw(key: Column, shard: int) -> Column:
    """A uniform number in (0, 1) of the key and the shard: the first 52 bits of an md5."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{shard}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def best(key: Column, weights: Sequence[float], shards: Sequence[int], even: bool) -> Column:
    """score and shard of the one of `shards` whose score -ln(u) / weight is least; equal weights need no logarithm."""
    scores = [F.struct((-draw(key, i) if even else -F.log(draw(key, i)) / F.lit(float(weights[i]))).alias("s"), F.lit(i).alias("shard")) for i in shards]
    return F.least(*scores) if len(scores) > 1 else scores[0]


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard that a key prefers. A key moves only if a shard that it prefers comes or goes, so one more shard takes rows
    only into itself, and each shard's share follows its weight."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    return best(key, weights, range(len(weights)), len(set(weights)) == 1)["shard"]


def sub_range(parts: int) -> Column:
    """The sub-range of key, text_crc32 and size: the first 32 bits of an md5, modulo the parts."""
    row = F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("null")), "text_crc32", "size")
    return F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long") % F.lit(parts)


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Key, size, text_crc32, law, shard, slot and grown_shard of each row.

    size: UTF-8 bytes of the text (null: none) plus 1; text_crc32: unsigned, of the text's UTF-8 (null: of nothing);
    law: 'key', since the key and the shards' weights alone decide; slot: gapless from 0 within a shard, ordered by
    sub-range, key, crc and size; grown_shard: the shard under `grown` (one more shard of the same weight by default).
    Rows with equal keys share a shard and have slots of their own; null keys are one key; an empty table gives no rows;
    text is read for its size and crc but never shuffled; other columns are not read. A shard is numbered in `parts`
    sub-ranges side by side (by default with the number of rows). They hash key, crc and size, and equal rows are counted
    before they are numbered, so a key with very many rows is no single task's work.
    """
    grown = list(weights) + [weights[-1]] if grown is None else list(grown)
    if not weights or not grown or min([*weights, *grown]) <= 0:
        raise ValueError("weights must be positive")
    even = len({*weights, *grown}) == 1
    stay = list(weights) == grown[: len(weights)]  # then only the new shards are drawn for `grown`
    parts = parts or max(PARTS, -(-docs.count() // (len(weights) * PART_ROWS)))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    equal = rows.groupBy("key", "size", "text_crc32").agg(F.count("*").alias("copies"))
    drawn = equal.withColumn("now", best(F.col("key"), weights, range(len(weights)), even))
    more = [*([F.col("now")] if stay else []), *([best(F.col("key"), grown, range(len(weights) if stay else 0, len(grown)), even)] if len(grown) > len(weights) or not stay else [])]
    placed = drawn.withColumns({
        "shard": F.col("now.shard").cast("int"),
        "grown_shard": (F.least(*more) if len(more) > 1 else more[0])["shard"].cast("int"),
        "part": sub_range(parts),
    }).drop("now")
    counts = placed.groupBy("shard", "part").agg(F.sum("copies").alias("rows"))  # shards x parts rows
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    base = F.broadcast(base) if len(weights) * parts <= 200_000 else base
    within = Window.partitionBy("shard", "part").orderBy("key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("at", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(base, ["shard", "part"])
    each = numbered.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("at") + F.col("copy")).cast("long").alias("slot"), "grown_shard")


def sql(n: int, documents: str = "documents") -> str:
    """The same over `documents` (doc_id, text), whose keys are distinct, for n shards of one weight, in DuckDB's SQL. It has no
    crc32, so each text's bytes go through a table made by the polynomial's rule."""
    return f"""
WITH RECURSIVE g(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM g WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS steps FROM g WHERE k = 8),
b AS MATERIALIZED (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, x: xor(c >> 8, steps[xor(c & 255, x) + 1])), 4294967295) AS text_crc32 FROM {documents}, t),
u AS (SELECT doc_id, CAST(i AS INTEGER) AS i, CAST('0x' || substr(md5(key || ':' || i), 1, 13) AS BIGINT) AS u FROM b, range({n + 1}) r(i)),
p AS (SELECT doc_id, min(struct_pack(s := -u, shard := i)) FILTER (i < {n}) AS now, min(struct_pack(s := -u, shard := i)) AS more FROM u GROUP BY doc_id),
s AS (SELECT b.*, now.shard AS shard, more.shard AS grown_shard, CAST('0x' || substr(md5(key || ':' || text_crc32 || ':' || size), 1, 8) AS BIGINT) % (
    SELECT greatest({PARTS}, (count(*) + {n * PART_ROWS - 1}) // {n * PART_ROWS}) FROM b) AS part FROM b JOIN p ON b.doc_id IS NOT DISTINCT FROM p.doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST) - 1 AS BIGINT) AS slot, grown_shard FROM s"""
