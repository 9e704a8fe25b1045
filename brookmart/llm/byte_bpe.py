"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than `chunk` is cut into chunks that overlap. Chunks are pre-tokenised in parallel. Two neighbours
resynchronise at the first pre-token boundary that both have in their overlap: the pattern looks ahead only, so from
there on both see the same pre-tokens. By induction from the first chunk, that boundary is one of the whole text. Chunks
without a common boundary are joined to their predecessor. The pieces between boundaries are then encoded in parallel.
Decoding concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import by_bytes, fresh, small_batches

#: A match that ends this close to a chunk's end may go on beyond it, or be decided by what stands there.
MARGIN = 8


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """tiktoken's encoding for a file of ranks, without special tokens; one for each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ids_of(text: str, path: str, pattern: str) -> bytes:
    return np.asarray(encoding(path, pattern).encode_ordinary(text), "<u4").tobytes()


def bytes_of(ids: bytes, path: str, pattern: str) -> bytes:
    return encoding(path, pattern).decode_bytes(np.frombuffer(ids, "<u4").tolist())


def boundaries(text: str, begin: int, end: int, pattern: str) -> list[int]:
    """Where matches begin within [begin, end) of the text, if matching begins at 0."""
    import regex

    out = []
    for m in regex.compile(pattern).finditer(text):
        if m.start() >= end:
            break
        if m.start() >= begin:
            out.append(m.start())
    return out


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = 32_768, overlap: int = 1_024) -> DataFrame:
    """Key, n_tokens and ids (packed little-endian unsigned 32-bit integers) of each row's whole text.

    ranks: a .tiktoken file on every executor. Null texts are empty; rows with null or repeated keys stay, a row each;
    an empty table gives no rows; other columns are not read. No text is cut: long ones are encoded in pieces that
    resynchronise (see the module), and one without a place to cut is encoded in one piece.
    """
    if not MARGIN < overlap <= chunk // 2:
        raise ValueError("overlap must be over the margin and at most half a chunk")
    small_batches(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    long = F.octet_length("text") > chunk

    def whole(batches):
        for batch in batches:
            for part in by_bytes(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([ids_of(x, ranks, pattern) for x in part.column("text").to_pylist()], pa.binary())], ["key", "ids"])

    def cut(batches):
        for batch in batches:
            for part in by_bytes(batch, "text"):
                for key_, row, text_ in zip(part.column("key").to_pylist(), part.column("row").to_pylist(), part.column("text").to_pylist(), strict=True):
                    n = max(1, -(-len(text_) // chunk))
                    for k in range(0, n, 64):
                        ks = range(k, min(n, k + 64))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([key_] * len(ks), part.column("key").type), pa.array([row] * len(ks), pa.int64()), pa.array(list(ks), pa.int32()), pa.array([n] * len(ks), pa.int32()), pa.array([text_[i * chunk : (i + 1) * chunk + overlap] for i in ks], pa.string())],
                            ["key", "row", "k", "n", "body"],
                        )

    def edges(batches):
        for batch in batches:
            head, tail = [], []
            for k, n, body in zip(batch.column("k").to_pylist(), batch.column("n").to_pylist(), batch.column("body").to_pylist(), strict=True):
                head.append(boundaries(body, 0, min(overlap - MARGIN, len(body)), pattern) if k else [0])
                ends = boundaries(body, chunk, min(chunk + overlap, len(body)) - MARGIN * (k < n - 1), pattern) if k < n - 1 else []
                tail.append([x - chunk for x in ends if not body[x - 1].isspace()])  # matches of white space depend on what follows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], [*batch.schema.names, "head", "tail"])

    def pieces(batches):
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                body = "".join(x["body"][:chunk] for x in parts[:-1])
                last = parts[-1]
                body += last["body"] if last["until"] is None else last["body"][: chunk + last["until"]]
                out.append(ids_of(body[parts[0]["cut"] :], ranks, pattern))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("key", "row", "g", "copies")), pa.array(out, pa.binary())], ["key", "row", "g", "copies", "ids"])

    def joined(batches):
        for batch in batches:
            out = [b"".join(x["ids"] for x in parts) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), pa.array(out, pa.binary())], ["key", "copies", "ids"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = rows.filter(long).withColumn("row", F.xxhash64("key", "text")).mapInArrow(cut, f"key {kind}, row long, k int, n int, body string")
    spread = chunks.groupBy("key", "row", "k").agg(F.first("n").alias("n"), F.first("body").alias("body"), F.count("*").alias("copies"))  # equal rows once
    seen = spread.repartition(n, "key", "row", "k").mapInArrow(edges, f"key {kind}, row long, k int, n int, body string, copies long, head array<int>, tail array<int>")
    order = Window.partitionBy("key", "row").orderBy("k")
    at = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    met = seen.withColumn("cut", at).withColumn("until", F.lead("cut").over(order)).withColumn("g", F.sum(F.when(F.col("cut").isNotNull(), 1).otherwise(0)).over(order))
    group = met.groupBy("key", "row", "g").agg(F.array_sort(F.collect_list(F.struct("k", "body", "cut", "until"))).alias("parts"), F.first("copies").alias("copies"))
    done = group.select("key", "row", "g", "copies", "parts").mapInArrow(pieces, f"key {kind}, row long, g long, copies long, ids binary")
    texts = done.groupBy("key", "row").agg(F.array_sort(F.collect_list(F.struct("g", "ids"))).alias("parts"), F.first("copies").alias("copies"))
    found = texts.select("key", "copies", "parts").mapInArrow(joined, f"key {kind}, copies long, ids binary")
    whole_long = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("key", "ids")  # a row each
    short = rows.filter(~long).mapInArrow(whole, f"key {kind}, ids binary")
    out = short.unionByName(whole_long)
    return out.select(F.col("key").alias(key), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, ranks: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds decoded (or _decoded, if there is such a column), the raw bytes of each row's ids one after another (null for null ids)."""
    (decoded,) = fresh(encoded.columns, "decoded")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    names = encoded.columns

    def run(batches):
        for batch in batches:
            raw = [None if x is None else bytes_of(x, ranks, pattern) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*names, decoded])

    return encoded.mapInArrow(run, f"{kinds}, {decoded} binary")
