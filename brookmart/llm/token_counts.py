"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_bytes, small_batches, text_views
from .wordcodec import codec


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """Key, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row's whole text.

    tokenizer: a .json file of the tokenizers library or a .model file of sentencepiece, on every executor. Batches are
    balanced by bytes; long texts are cut at safe boundaries. A null text counts as empty: 0 bytes, and what the library
    gives for an empty text. Null and repeated keys stay as they are, a row each; an empty table gives no rows; other
    columns are not read.
    """

    def lengths(batches):
        model = codec(tokenizer)
        for whole in batches:
            for batch in by_bytes(whole, "text", 1 << 22):
                body, at = text_views(batch.column("text"))
                raw = body.tobytes()
                n, _ = model.encode([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], ids=False)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.diff(at)), pa.array(n)], ["key", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(lengths, f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
