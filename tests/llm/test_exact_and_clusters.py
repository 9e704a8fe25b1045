"""Exact dedup, lexical search and clustering against brute force and SQL."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brookmart.llm import block_clusters, exact_dedup, lexical_search, queries, shared

SF = "/root/testdata/sf0.001"


def groups(rows):
    """What exact_duplicates gives, by dictionaries."""
    texts = {}
    for key, text in rows:
        texts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(key)
    out = []
    for text, keys in texts.items():
        keep = min((k for k in keys if k is not None), default=None)
        out += [(k, keep, len(keys), k == keep, hashlib.sha256(text.encode()).hexdigest()) for k in keys]
    return sorted(out, key=repr)


def odd_rows():
    rnd = random.Random(4)
    texts = [None, "", " ", "\t \n", "a b", "a  b", "a\x0bb", "a\u00a0b", " a b", "A b", "é" * 50, "x" * 300_000, "x" * 300_000 + " "]
    rows = [(i, rnd.choice(texts)) for i in range(400)] + [(1000 + i, "hot  text" if i % 2 else "hot text") for i in range(200)] + [(2000 + i, f"text {i % 150}") for i in range(300)]
    rows += [(None, "a b"), (None, "only without keys"), (None, "only without keys"), (7, "again"), (7, "again"), (7, "other")]
    rnd.shuffle(rows)
    return rows


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def extra(spark, rows):
    return spark.createDataFrame([(*r, 1, "h") for r in rows], "doc_id long, text string, keep_id int, bucket string").repartition(6)


@pytest.mark.parametrize("clash", [False, True])
def test_exact_dedup_equals_brute_force(spark, monkeypatch, clash):
    """Small buckets, hot texts in several tasks; with clash, few hashes: unequal texts are chained."""
    monkeypatch.setattr(exact_dedup, "HOT", 40)
    if clash:
        monkeypatch.setattr(exact_dedup, "text_hash", lambda x: F.pmod(F.xxhash64(x), F.lit(5)).bitwiseXOR(F.shiftleft(F.length(x) % 3, 62)))
    rows = odd_rows()
    assert found(exact_dedup.exact_duplicates(extra(spark, rows), capacity=3000)) == groups(rows)


def test_exact_dedup_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_exact_index_takes_more_documents(spark, tmp_path, monkeypatch):
    """Three inserts: buckets split, those without new rows keep their files, and all rows are as if inserted at once."""
    monkeypatch.setattr(exact_dedup, "HOT", 40)
    rows = odd_rows()
    index = exact_dedup.ExactIndex(spark, str(tmp_path / "index"), 20_000)
    depths = []
    for part in (rows[:100], rows[100:], [(5000, "one more")]):
        index.insert(extra(spark, part))
        depths.append(index.directory().depth)
    got = sorted(((r.id, r.keep, r.copies, r.id == r.keep, r.sha) for r in index.documents().collect()), key=repr)
    assert got == groups([*rows, (5000, "one more")])
    assert depths[0] < depths[1] and index.generation() == 2
    last = [b for b in index.directory().buckets if b[2] == 2]
    assert len(last) == 1 and len(index.directory().buckets) > 3


def test_directory_doubles_where_a_bucket_is_overfull():
    held = np.zeros(1 << 6, np.int64)
    held[[1, 3, 40]] = 5, 6, 1
    grown = exact_dedup.Directory([(0, 0, -1)]).grown(held, 10)
    assert grown.depth == 5 and [b[:2] for b in grown.buckets] == [(0, 5), (1, 5), (1, 4), (1, 3), (1, 2), (1, 1)]
    assert grown.find((np.array([1, 3, 40], np.uint64) << np.uint64(58)).view(np.int64)).tolist() == [0, 1, 5]
    held[1] = 50  # what the bits don't tell apart can't be split
    assert exact_dedup.Directory([(0, 0, -1)]).grown(held, 10).depth == 5


def test_exact_dedup_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(exact_dedup.sql()).fetchall(), key=repr)
    assert found(queries.op11_exact_dedup(spark, SF)) == want


def kmeans(rows, k, rounds, dims):
    """What clusters gives, with plain integers."""
    kept = [(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in seeds]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centroids = [tuple(sum(x) // len(vs) for x in zip(*vs, strict=True)) if vs else c for vs, c in zip(own, centroids, strict=True)]
    last = [(i, *nearest(v)) for i, v in kept]
    return sorted(((i, j, d, sum(e for _, e, m in last if m == j), sum(e for _, e, _ in last), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in last), key=repr)


def clustered(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def vector_rows(dims):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((6, dims))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.standard_normal(dims) * 0.2]) for i in range(150)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)] + [(None, rows[1][1]), (None, rows[1][1]), (3, rows[7][1]), (3, rows[3][1])]  # a large group of copies
    return rows + [(2000, None), (2001, rows[0][1][:-1]), (2002, [None] * dims), (2003, [math.nan] * dims), (2004, [math.inf] + [0.0] * (dims - 1)), (2005, [0.0] * dims), (2006, [-1e4] * dims)]


@pytest.mark.parametrize(("k", "dims"), [(9, 20), (500, 3)])
def test_clusters_equal_brute_force(spark, k, dims):
    rows = vector_rows(dims)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cluster int, x int").repartition(5)
    assert clustered(block_clusters.clusters(df, k, 3, dims=dims)) == kmeans(rows, k, 3, dims)


def test_clusters_of_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    got = block_clusters.clusters(empty)
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="too large"):
        block_clusters.clusters(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dims=2).collect()


def test_screen_prunes_and_never_the_nearest():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.standard_normal((2000, 64)) / 8).astype(np.int64)
    x[:300] = x[0]  # ties with equal centroids
    screen = block_clusters.Screen(np.concatenate([x[:3], x[400:437]]))
    compressed = block_clusters.compress(x)
    cluster, distance, computed = screen.nearest(x, *compressed)
    every = ((x[:, None, :] - screen.exact[None]) ** 2).sum(2)
    assert (distance == every.min(1)).all() and (cluster == every.argmin(1)).all()
    lower, upper = screen.bounds(*compressed, (x**2).sum(1).astype(float))
    assert (lower <= every).all() and (every <= upper).all()
    assert computed < 0.4 * every.size


def test_clusters_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    cursor = con.execute(block_clusters.sql())
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(dict(zip(names, r)).values()) for r in cursor.fetchall()), key=repr)
    assert clustered(queries.op13_block_clusters(spark, SF)) == want


def ranked(docs, items, k):
    """What search gives, by a look at every document for every item."""

    def terms(text):
        return [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]

    bags = [(i, Counter(terms(x))) for i, x in docs if terms(x)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked: dict = {}
    for i, x in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(x))
    out = []
    for item, q in asked.items():
        scores = []
        for i, b in bags:
            m = 25 + (75 * sum(b.values()) * n) // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t, times in q.items() if b[t])
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, r + 1, i, -score) for r, (score, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def searched(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def search_tables():
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["Éa", "été", "日本語", "x9", "UPPER"]
    text = lambda n: " ".join(rnd.choice(words[: rnd.choice([5, 20, 65])]) for _ in range(n))
    docs = [(i, text(rnd.choice([0, 1, 5, 30, 200]))) for i in range(400)] + [(1000 + i, "w1 w2, W3-w4.upper") for i in range(150)]
    docs += [(None, "w1 été"), (5, "w1 w7"), (5, "w1 w7"), (2000, None), (2001, ""), (2002, "..  !"), (2003, "w8 " * 50_000)]
    items = [(i, text(rnd.choice([1, 3, 12]))) for i in range(25)] + [(100, None), (101, ""), (102, "nowhere"), (103, "w1 w1 w1 W2"), (None, "w1"), (104, "w5"), (104, "w6"), (105, "the whole of w1!")]
    rnd.shuffle(docs)
    return docs, items


@pytest.mark.parametrize(("shard", "terms"), [(8192, 1_000_000), (37, 30)])
def test_search_equals_brute_force(spark, monkeypatch, shard, terms):
    """As it is, and with small shards and several passes over the documents."""
    monkeypatch.setattr(lexical_search, "SHARD", shard)
    monkeypatch.setattr(lexical_search, "PASS_TERMS", terms)
    docs, items = search_tables()
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item_id int, score int").repartition(3)
    got = searched(lexical_search.search(d, spark.createDataFrame(items, "item_id long, text string"), 7))
    assert got == ranked(docs, items, 7)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs, items).count() == 1


def test_shard_search_skips_postings():
    rng = np.random.default_rng(5)
    n = 4000
    terms = [np.unique(np.concatenate([np.flatnonzero(rng.random(40) < 0.6), 40 + rng.integers(0, 400, 3)])) for _ in range(n)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
    flat = np.concatenate(terms)
    shard = lexical_search.Shard(np.arange(n), np.full(n, 30), first, flat, rng.integers(1, 4, len(flat)), n, 30 * n)
    df = np.bincount(flat, minlength=440)
    weights = np.asarray([lexical_search.weight(n, int(x)) for x in df])
    query = np.asarray([0, 1, 2, 3, 4, 5, 50, 60, 70])
    places, scores, all_ = shard.search(query, weights[query], 5, 1)
    again, same, probed = shard.search(query, weights[query], 5, int(scores[-1]))
    assert again.tolist() == places.tolist() and same.tolist() == scores.tolist()
    assert probed < all_ / 10


def test_search_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert searched(queries.op12_lexical_search(spark, SF)) == sorted(con.execute(lexical_search.sql()).fetchall())


def test_scratch_tables_are_deleted_but_those_that_are_kept(spark):
    from pathlib import Path

    tmp = shared.Scratch()
    one, two = (tmp.saved(spark.range(n), "t") for n in (3, 4))
    paths = [Path(x.scratch_path.removeprefix("file:")) for x in (one, two)]
    assert all(p.exists() for p in paths) and two.count() == 4
    tmp.discard(two)
    assert [p.exists() for p in paths] == [False, True] and two.count() == 4
    tmp.discard()
    assert not paths[1].exists()
