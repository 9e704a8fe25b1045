"""Tokenizer operators against the libraries themselves, on texts made to break boundaries."""

import hashlib
import math
import struct
import zlib

import duckdb
import public_tokenizers as P
import pytest

from brookmart.llm import byte_bpe, queries, shards, token_counts, token_files
from brookmart.llm.shared import scratch

SF = "/root/testdata/sf0.001"
WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "\n\n", "plain words here", "Mixed CASE, don't we'll 12345 99", "tab\tand nbsp 　wide", "a" * 5000,
    "H̱ ẖ é ́x", "ΣΣ ΟΣ İ", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "\U0001f600\U0001f469‍\U0001f4bb 中文",
    "x \x1c y \x85 z \x0b w", "  lead and trail  ", "word " * 9000, ("It's a long line, isn't it? " * 40 + "\n   \n") * 60, " " * 3000 + "end", "plain words here",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 4 else None, t, "clash", 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string, key int")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_counts_equal_the_library(docs):
    got = {(r.doc_id): r for r in token_counts.count_tokens(docs, WORDS).collect()}
    t = library()
    for i, x in enumerate(TEXTS):
        r = got[i if i != 4 else None]
        assert r.n_tokens == len(t.encode(x or "", add_special_tokens=False).ids), x
        assert r.n_bytes == len((x or "").encode())
        assert r.over_limit == (r.n_tokens > 2048)


def test_counts_with_other_libraries(docs):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, P.path("piece_bpe_32k.model")).collect()}
    assert all(got[i if i != 4 else None] == len(m.encode(x or "")) for i, x in enumerate(TEXTS))
    from tokenizers import Tokenizer

    b = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, P.path("byte_bpe_50k.json")).collect()}
    assert all(got[i if i != 4 else None] == len(b.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(TEXTS))


@pytest.mark.parametrize("change", ["cased", "one pattern", "stripped", "other pattern"])
def test_counts_of_other_settings_equal_the_library(docs, tmp_path, change):
    import json

    from tokenizers import Tokenizer

    with open(WORDS, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]
    if change == "cased":
        spec["normalizer"] = None
    elif change == "one pattern":
        split["Regex"] = "[^\\s]+"
    elif change == "other pattern":
        split["Regex"] = "[\\p{L}]+[.,]?|[^\\s\\p{L}]+"
    else:
        spec["normalizer"]["normalizers"].append({"type": "Strip", "strip_left": True, "strip_right": True})
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    for i, x in enumerate([*TEXTS]):
        assert got[i if i != 4 else None] == len(t.encode(x or "", add_special_tokens=False).ids), x


def test_files_with_one_hot_key(spark):
    df = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS doc_id", "concat('t ', id) AS text")
    path = scratch(spark, "test")
    token_files.write_token_files(df, path, WORDS, files=6)
    rows = token_files.with_start(spark, path, ["doc_id", "part", "n_tokens", "ids"]).orderBy("start").collect()
    assert len({r.part for r in rows if r.doc_id is None}) > 1 and len(rows) == 900
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert [r.doc_id or -1 for r in rows] == sorted(r.doc_id or -1 for r in rows)


def test_files_are_read_in_part(spark):
    """Metadata without ids, and row groups and pages without rows of other keys."""
    import glob

    import pyarrow.parquet as pq

    df = spark.range(12_000).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 60), i -> concat('w', (id * 7919 + i * 104729) % 100003)), ' ') AS text")
    path = scratch(spark, "test")
    token_files.write_token_files(df, path, WORDS, files=1, row_group_mb=1, page_rows=256)
    meta = pq.ParquetFile(glob.glob(f"{path}/*.parquet")[0]).metadata
    assert meta.num_row_groups > 1 and max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 2 << 20
    plan = token_files.read_tokens(spark, path, ["doc_id", "n_tokens"]).filter("doc_id = 17")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "EqualTo(doc_id,17)" in plan
    assert token_files.read_tokens(spark, path).filter("doc_id = 17").count() == 1


def test_queries_equal_the_libraries(spark):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, SF, "documents").collect()}
    t, e, start = library(), byte_bpe.encoding(RANKS, P.PATTERN), 0
    counts = {r.doc_id: r for r in queries.QUERIES["op8_token_counts"](spark, SF).collect()}
    files = {r.doc_id: r for r in queries.QUERIES["op2_token_files"](spark, SF).collect()}
    pieces = {r.doc_id: r for r in queries.QUERIES["op5_byte_bpe"](spark, SF).collect()}
    assert len(counts) == len(files) == len(pieces) == len(texts)
    for i in sorted(texts):
        ids = t.encode(texts[i], add_special_tokens=False).ids
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len(texts[i].encode()), len(ids), len(ids) > 2048)
        packed = struct.pack(f"<{len(ids) + 1}I", *ids, 2)
        assert (files[i].start, files[i].n_tokens, files[i].ids_crc32) == (start, len(ids) + 1, zlib.crc32(packed))
        start += len(ids) + 1
        ids = e.encode_ordinary(texts[i])
        assert (pieces[i].n_tokens, pieces[i].ids_sha256, pieces[i].decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())


def test_files_hold_the_ids_in_order(spark, docs):
    path = scratch(spark, "test")
    token_files.write_token_files(docs, path, WORDS, end_id=2, files=3)
    rows = token_files.with_start(spark, path, ["doc_id", "n_tokens", "ids"]).orderBy("start").collect()
    t, start = library(), 0
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: -1 if x is None else x)
    for r in rows:
        want = [*t.encode(TEXTS[4 if r.doc_id is None else r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert r.ids == want and r.n_tokens == len(want) and r.start == start
        start += len(want)
    crc = {r.doc_id: r.ids_crc32 for r in token_files.ids_crc32(token_files.read_tokens(spark, path)).collect()}
    assert all(crc[r.doc_id] == zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)) for r in rows)


def test_file_layout(spark, docs):
    import glob

    import pyarrow.parquet as pq

    path = scratch(spark, "test")
    token_files.write_token_files(docs, path, WORDS, files=1)
    meta = pq.ParquetFile(glob.glob(f"{path}/*.parquet")[0]).metadata
    ids = meta.row_group(0).column(meta.num_columns - 1)
    assert {"RLE_DICTIONARY", "PLAIN_DICTIONARY"} & set(ids.encodings) and meta.row_group(0).column(0).has_column_index


@pytest.mark.parametrize(("chunk", "overlap"), [(32_768, 1_024), (256, 64), (64, 16)])
def test_byte_bpe_equals_tiktoken_and_round_trips(docs, chunk, overlap):
    e = byte_bpe.encoding(RANKS, P.PATTERN)
    rows = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN, chunk=chunk, overlap=overlap), RANKS, P.PATTERN).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[4 if r.doc_id is None else r.doc_id] or ""
        ids = e.encode_ordinary(text)
        assert hashlib.sha256(r.ids).hexdigest() == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), text[:50]
        assert r.n_tokens == len(ids) and bytes(r.decoded) == text.encode()


@pytest.mark.parametrize("chunk", [32_768, 256])
def test_byte_bpe_keeps_equal_long_rows(spark, chunk):
    long, other = "word and more, " * 3000, "other words\n" * 4000
    rows = [(1, long), (1, long), (None, long), (None, long), (None, long), (None, other), (2, long), (1, "short"), (1, "short"), (1, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = byte_bpe.encode(df, RANKS, P.PATTERN, chunk=chunk, overlap=64).collect()
    e = byte_bpe.encoding(RANKS, P.PATTERN)
    want = [(str(i), struct.pack(f"<{len(ids)}I", *ids)) for i, t in rows for ids in [e.encode_ordinary(t)]]
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted(want)
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)


def test_byte_bpe_cuts_no_white_space_from_what_follows(spark, tmp_path):
    import base64

    path = str(tmp_path / "lines.tiktoken")
    with open(path, "w") as f:
        f.writelines(f"{base64.b64encode(x).decode()} {i}\n" for i, x in enumerate([*(bytes([i]) for i in range(256)), b"\n\n"]))
    texts = ["x" * i + "\n\nWord" * 60 for i in range(8)]  # a chunk begins at every offset of a paragraph
    rows = byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, P.PATTERN, chunk=64, overlap=24).collect()
    e = byte_bpe.encoding(path, P.PATTERN)
    assert {r.doc_id: list(struct.unpack(f"<{r.n_tokens}I", r.ids)) for r in rows} == dict(enumerate(map(e.encode_ordinary, texts)))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(none, WORDS).count() == 0
    assert byte_bpe.encode(none, RANKS, P.PATTERN).count() == 0
    assert shards.shard_documents(none, [1.0] * 4).count() == 0
    path = scratch(spark, "test")
    token_files.write_token_files(none, path, WORDS)
    assert token_files.with_start(spark, path).count() == 0


def u(key, shard):
    return (int(hashlib.md5(f"{'null' if key is None else key}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def prefers(key, weights):
    return min(range(len(weights)), key=lambda i: (-math.log(u(key, i)) / weights[i], i))


@pytest.mark.parametrize(("weights", "grown"), [([1.0] * 16, None), ([1.0, 3.0, 0.5], None), ([1.0, 3.0], [2.0, 3.0, 1.0]), ([1.0] * 4, [1.0] * 3), ([2.0], [2.0])])
def test_shards_equal_rendezvous_in_python(spark, weights, grown):
    keys = [*range(700), None, None, 5, 5, 5]
    df = spark.createDataFrame([(k, f"t{i % 3}", 1) for i, k in enumerate(keys)], "doc_id long, text string, shard int")
    rows = shards.shard_documents(df, weights, grown, parts=5).collect()
    assert len(rows) == len(keys)
    more = grown or [*weights, weights[-1]]
    assert all((r.shard, r.grown_shard) == (prefers(r.doc_id, weights), prefers(r.doc_id, more)) for r in rows)
    for s in range(len(weights)):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shards_with_one_hot_key(spark):
    df = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS doc_id", "concat('t', id % 50) AS text").unionAll(spark.sql("SELECT CAST(NULL AS LONG), CAST(NULL AS STRING)"))
    rows = shards.shard_documents(df, [1.0] * 4, parts=8).collect()
    assert len(rows) == 6001
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shard_query_equals_rendezvous_in_python(spark):
    rows = queries.QUERIES["op10_rendezvous_shards"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(body) + 1, zlib.crc32(body), "key", prefers(r.doc_id, [1.0] * 16), prefers(r.doc_id, [1.0] * 17))


def test_shard_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(shards.sql(16)).fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES["op10_rendezvous_shards"](spark, SF).collect()) == want


def test_shards(spark, docs):
    many = spark.range(4000).selectExpr("id as doc_id", "concat('t', id % 7) as text").unionByName(docs.select("doc_id", "text"))
    rows = shards.shard_documents(many, [1.0] * 16).collect()
    assert len(rows) == 4000 + len(TEXTS)
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 16) for r in rows)
    assert 150 < sum(r.grown_shard == 16 for r in rows) < 330
    assert {r.doc_id: r.text_crc32 for r in rows if r.doc_id == 4001 % 4000}
    heavy = shards.shard_documents(many, [1.0, 3.0]).groupBy("shard").count().collect()
    n = {r.shard: r["count"] for r in heavy}
    assert 2.6 < n[1] / n[0] < 3.4
    assert all(r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode()) for r in shards.shard_documents(docs.filter("doc_id = 5"), [1.0]).collect() for t in [TEXTS[5]])
