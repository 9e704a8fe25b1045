"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_clusters, byte_bpe, embed_dedup, exact_dedup, html_text, impact_search, lexical_search, minhash_dedup, mixing, shards, token_counts, token_files, toxicity
from .shared import scratch

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_collision_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, WORDS, end_id=2)
    return token_files.ids_crc32(token_files.with_start(spark, path, ["doc_id", "n_tokens", "ids"])).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.score(docs, model)
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("clauses").alias("n_clauses"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), RANKS, PATTERN), RANKS, PATTERN)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), WORDS)


#: The mix of op9: domains are the sources' numbers modulo 4.
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "language": {"en": 4, "de": 2, "fr": 2, "es": 2}}
MIX_SHARE, MIX_EPOCHS = 0.6, 2


def mix_domain() -> Column:
    return F.concat(F.lit("d"), F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int") % 4)


MIX_DOMAIN_SQL = "'d' || (TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4)"


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"), mix_domain(), MIX_SHARE, MIX_EPOCHS, MIX_WEIGHTS)
    return rows.select("doc_id", "epoch", "mix_tokens")


def op10_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"), [1.0] * 16)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_block_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_clusters.clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_collision_dedup": op1_collision_dedup,
    "op2_token_files": op2_token_files,
    "op3_toxicity": op3_toxicity,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_html_text": op6_html_text,
    "op7_impact_search": op7_impact_search,
    "op8_token_counts": op8_token_counts,
    "op9_mix_sources": op9_mix_sources,
    "op10_rendezvous_shards": op10_rendezvous_shards,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_block_clusters": op13_block_clusters,
}

SQL: dict[str, str] = {
    "op1_collision_dedup": embed_dedup.sql(0.95),
    "op4_minhash_dedup": minhash_dedup.sql(85),
    "op7_impact_search": impact_search.sql("vec_id % 100 = 0", 10),
    "op10_rendezvous_shards": shards.sql(16),
    "op11_exact_dedup": exact_dedup.sql(),
    "op12_lexical_search": lexical_search.sql(),
    "op13_block_clusters": block_clusters.sql(),
    "op9_mix_sources": mixing.sql(MIX_DOMAIN_SQL, MIX_SHARE, MIX_EPOCHS, MIX_WEIGHTS),
}
