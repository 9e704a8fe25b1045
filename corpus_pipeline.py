"""Corpus pipeline: toxicity, near-dedup, mixing, byte-level BPE; every stage takes all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmart.llm import byte_bpe, minhash_dedup, mixing, toxicity
from brookmart.llm.queries import PATTERN, RANKS, mix_domain, table
from brookmart.llm.shared import saved

#: The mix keeps nine tenths of the tokens; the rest goes where sources are over their weights.
MIX_SHARE = 0.9
MIX_WEIGHTS = {"language": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the grammar, fitted to the labels of rows that aren't held out, rejects. Null and empty texts
    are clean; rows that repeat a doc_id or have none are judged by their own text; an empty table stays empty."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, a similarity of 0.8): the one with the least doc_id.
    Rows that repeat a doc_id are one document and stay or go together; rows without a doc_id stay."""
    groups = minhash_dedup.near_duplicates(docs, 80).filter("kept").select("doc_id").distinct()
    kept = docs.filter("doc_id is not null").join(groups, "doc_id", "left_semi")
    return kept.unionByName(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """At most one epoch of each leaf, towards even sources within languages within domains. Null languages and sources are
    names of their own, a null text counts one token, rows that repeat a doc_id are rows of their own."""
    return mixing.mix(docs, mix_domain(), MIX_SHARE, 1, MIX_WEIGHTS).select(*docs.columns)


def encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the bytes that they decode to. A null text is empty; every row
    stays, whatever its doc_id. Columns of documents are not returned."""
    rows = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("minhash_dedup", drop_near_copies), ("mixing", mix_sources), ("byte_bpe", encode_decode)]

#: Toxicity is learned, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = saved(docs, name) if i < len(STAGES) - 1 else docs
    return docs
