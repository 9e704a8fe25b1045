"""Near-duplicate operators and search against brute force."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brookmart.llm import embed_dedup, graph, impact_search, minhash_dedup, queries

SF = "/root/testdata/sf0.001"


def united(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def corpus():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = [None, "", "  \n", "One two", "one  TWO", "é É five words long here", "x"]
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([6, 40, 120]))]
        docs.append(" ".join(base))
        for _ in range(rnd.choice([0, 1, 3])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            docs.append(" ".join(copy))
    hot = [rnd.choice(vocabulary) for _ in range(150)]
    for _ in range(60):  # one large group round the threshold
        copy = list(hot)
        for _ in range(rnd.choice([0, 1, 2, 3, 4])):
            copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
        docs.append(" ".join(copy))
    docs.append("long " + " ".join(rnd.choice(vocabulary) for _ in range(60_000)))
    docs.append(docs[-1] + " tail")
    return docs


def test_minhash_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SMALL", 4)  # the large path for small groups too
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16_000)
    docs = corpus()
    rows = spark.createDataFrame([(i, d, "c") for i, d in enumerate(docs)] + [(None, docs[3], "c"), (3, docs[3], "c")], "doc_id long, text string, component_id string")
    got = minhash_dedup.near_duplicates(rows, 85).collect()
    sets = [shingles(d) for d in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = united(range(len(docs)), links)
    assert len(got) == len(docs) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r.doc_id
    assert sum(want[i] != i for i in want) > 40


def test_minhash_of_keys_with_several_texts(spark):
    """A key's texts are judged each for itself: 1 has two that link with 2 and with 3, which nothing else joins."""
    words = [f"w{i}" for i in range(200)]
    a, b = " ".join(words[:90]), " ".join(words[100:190])
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (0, "other words than those here"), (1, a), (4, b), (None, a)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(0, 0), (1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1)]
    far = [(5, a), (2, b), (5, "lone words of a text here"), (3, a + " x")]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(far, "doc_id long, text string"), 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(2, 86, 2, True), (3, 87, 3, True), (5, 2, 5, True), (5, 86, 3, False)]


def test_minhash_of_a_large_group_round_the_threshold(spark, monkeypatch):
    """1,500 texts of one group whose links are sparse: all blocks are needed to tell who is linked with whom."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 1 << 19)
    rnd = random.Random(8)
    hot = [f"w{rnd.randrange(300)}" for _ in range(120)]
    docs = []
    for i in range(1500):
        base = list(docs[rnd.randrange(max(0, i - 200), i)]) if i and rnd.random() < 0.7 else list(hot)
        for _ in range(rnd.choice([1, 1, 2, 3, 5, 8])):
            base[rnd.randrange(len(base))] = f"w{rnd.randrange(300)}"
        docs.append(base)
    codes: dict = {}
    sets = [sorted({codes.setdefault(tuple(d[i : i + 5]), len(codes)) for i in range(len(d) - 4)}) for d in docs]
    holds = np.zeros((len(docs), len(codes)), np.float32)
    for i, x in enumerate(sets):
        holds[i, x] = 1
    size, same = holds.sum(1), holds @ holds.T
    near = 100 * same >= 85 * (size[:, None] + size[None, :] - same)
    want = united(range(len(docs)), [(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    rows = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(rows, 85).collect()}
    assert got == want and 200 < len(set(want.values())) < 1400


def test_block_links_span_what_they_join():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 100 - k], rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in rng.integers(0, 12, 60)]

    def block(ids):
        signs = [minhash_dedup.signature(sets[i]).astype(np.uint16).tobytes() for i in ids]
        return pa.table({"node": ids, "c": ids, "n": [len(sets[i]) for i in ids], "signature": signs, "bands": pa.array([[1] * 25] * len(ids), pa.list_(pa.int64())), "members": [sets[i].tobytes() for i in ids]})

    a, b = minhash_dedup.meet(block(list(range(20))), block(list(range(60))), 85, 1e-9)
    near = [(i, j) for i in range(20) for j in range(60) if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert united(range(60), zip(a, b, strict=True)) == united(range(60), near) and len(a) == 60 - len(set(united(range(60), near).values()))


def test_minhash_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.SQL["op4_minhash_dedup"]).fetchall()
    assert sorted(map(tuple, queries.QUERIES["op4_minhash_dedup"](spark, SF).collect())) == sorted(want) and want


def test_minhash_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_dedup.near_duplicates(none).count() == 0
    assert minhash_dedup.near_duplicates(spark.createDataFrame([(1, None), (2, "")], none.schema)).filter("kept").count() == 2


def test_posterior_bounds():
    for m, k in zip(range(32, 257, 32), minhash_dedup.least_matches(0.85, 1e-5), strict=True):
        tail = lambda k: sum(math.comb(m + 1, i) * 0.85**i * 0.15 ** (m + 1 - i) for i in range(k + 1))  # noqa: B023, E731
        assert tail(k) >= 1e-5 > (tail(k - 1) if k else 0)


def test_components(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)] + [(7, 7), (1, 0), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == united({x for ab in real for x in ab}, real)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(2)
    out = [(i, list(map(float, v))) for i, v in enumerate(rng.standard_normal((300, 16)))]
    for i in range(300, 420):
        base = np.asarray(out[rng.integers(0, 20)][1])
        out.append((i, list(map(float, base * rng.uniform(0.5, 2) + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.25, 0.4])))))
    return out + [(420 + i, out[7][1]) for i in range(5)]


def test_embeddings_equal_brute_force(spark):
    rows = vectors()
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, [float("inf")] + [1.0] * 15), (None, rows[0][1]), (1006, rows[0][1][:8])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, n_links string")
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df, 0.95).collect()}
    x = np.asarray([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    want = united(range(len(rows)), [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j])
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum() - 1, want[i], want[i] == i), i
    assert near.sum() > 600 and len(got) == len(rows) + len(odd)
    assert all(got[i].n_links == 0 and got[i].kept for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006, None))
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def linked(x, threshold=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    return near.sum(1) - 1, united(range(len(x)), [(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True) if i < j])


def test_embeddings_of_keys_with_several_vectors(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (3, [1.0, 0.1]), (4, [0.1, 1.0]), (3, [-1.0, 0.0]), (6, [1.0, 0.0]), (5, [1.0, 0.0])]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(3, 0, 3), (3, 3, 3), (4, 1, 4), (5, 1, 4), (5, 3, 3), (5, 3, 3), (6, 3, 3)]


def test_embeddings_of_hot_cells_equal_brute_force(spark, monkeypatch):
    """A third of all rows are one group of near copies, and cells are dealt to small blocks."""
    monkeypatch.setattr(embed_dedup, "LIMIT", 150)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1800, 24))
    x[:600] = x[0] + rng.standard_normal((600, 24)) * rng.choice([0.05, 0.2, 0.3], (600, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    n, want = linked(x)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {i: (n[i], want[i]) for i in range(len(x))} and n.max() > 200


def test_embedding_recall_of_many_rows(spark):
    """20,000 vectors need several coarse projections; pairs lie round the threshold."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((20_000, 32)).astype(np.float32)
    x[10_000:] = x[:10_000] + rng.standard_normal((10_000, 32)) * rng.uniform(0.2, 0.36, (10_000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = np.concatenate([(u[i : i + 1000] @ u.T >= 0.95).sum(1) - 1 for i in range(0, len(u), 1000)])
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df).collect()}
    assert all(got[i] <= n[i] for i in got) and sum(got.values()) >= 0.999 * n.sum() and n.sum() > 8_000
    assert embed_dedup.calibrate(0.95, len(x), 1e-5)[0] > 1


def test_embedding_calibration():
    for n in (100, 10_000, 10**6):
        coarse, width, rounds, count = embed_dedup.calibrate(0.95, n, 1e-5)
        d, p = math.sqrt(0.1), math.erf(embed_dedup.WINDOW / math.sqrt(2))
        apart = (1 - p * embed_dedup.same_cell(d, width) ** coarse) ** rounds
        few = sum(math.comb(embed_dedup.SKETCH, i) * p**i * (1 - p) ** (embed_dedup.SKETCH - i) for i in range(count))
        assert apart + few <= 1e-5
        assert embed_dedup.same_cell(math.sqrt(2), width) ** coarse * n <= embed_dedup.MATES


def test_windows_equal_brute_force():
    rng = np.random.default_rng(4)
    x = rng.integers(60, 200, (700, embed_dedup.SKETCH)).astype(np.uint8)
    x[300:] = np.clip(x[rng.integers(0, 50, 400)].astype(int) + rng.integers(-17, 18, (400, embed_dedup.SKETCH)), 0, 255)
    half = math.ceil(embed_dedup.WINDOW * embed_dedup.STEPS) + 1
    hits = (np.abs(x[:, None, :].astype(int) - x[None]) <= half).sum(2)
    by = rng.integers(0, embed_dedup.SKETCH, 3)
    side = rng.integers(0, 2, 700)
    run = np.sort(rng.integers(0, 3, 700))
    for sides, runs in ((np.full(700, -1), np.zeros(700, int)), (side, np.zeros(700, int)), (side, run)):
        a, b = embed_dedup.collide(x, runs, by[runs], sides, 26)
        place = x[np.arange(700), by[runs]].astype(int)
        own = np.abs(place[:, None] - place[None, :]) <= half
        want = {(i, j) for i, j in zip(*np.nonzero((hits >= 26) & own), strict=True) if i < j and runs[i] == runs[j] and (sides[i] < 0 or sides[i] != sides[j])}
        assert {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)} == want and len(a) == len(want) > 5


def test_runs_stay_whole():
    rng = np.random.default_rng(1)
    keys = np.repeat(rng.permutation(60), rng.integers(1, 90, 60))
    batches = [pa.RecordBatch.from_arrays([pa.array(x)], ["k"]) for x in np.array_split(keys, 40)]
    for most in (1, 50, 100_000):
        tables = list(embed_dedup.whole_runs(iter(batches), "k", most))
        assert np.array_equal(np.concatenate([t.column("k").to_numpy() for t, _ in tables]), keys)
        assert sum(len(set(t.column("k").to_pylist())) for t, _ in tables) == 60 == sum(r[-1] + 1 for _, r in tables)
    run = np.sort(rng.integers(0, 9, 80))
    got = [(int(i), int(j)) for p, q in embed_dedup.pairs_of_runs(run, 100) for i, j in zip(p, q, strict=True)]
    assert sorted(got) == [(i, j) for i in range(80) for j in range(i + 1, 80) if run[i] == run[j]] and len(got) == len(set(got))


def test_embedding_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(queries.SQL["op1_collision_dedup"]).fetchall()
    assert sorted(map(tuple, queries.QUERIES["op1_collision_dedup"](spark, SF).collect())) == sorted(want) and want


def test_search_equals_brute_force(spark):
    rows = vectors()[:200] + [(200, [0.5] * 16), (201, [0.5] * 16), (202, [0.0] * 16)]
    odd = [(1000, None), (1003, [float("nan")] + [1.0] * 15), (1010, [None] + [1.0] * 15), (None, rows[0][1]), (1020, [1.0] * 4)]
    df = spark.createDataFrame([(i, v) for i, v in rows + odd], "vec_id long, embedding array<double>")
    for block in (2048, 32):
        got = {}
        for r in impact_search.top_k(df, F.col("vec_id") % 10 == 0, 10, block=block).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        x = np.floor(np.asarray([v for _, v in rows]) * 1024).astype(np.int64)
        queries = [i for i, _ in rows if i % 10 == 0]
        assert set(got) == set(queries)
        for q in queries:
            score = x @ x[q]
            order = [i for i in np.lexsort((np.arange(len(rows)), -score)) if i != q][:10]
            assert sorted(got[q]) == [(n + 1, int(i), int(score[i])) for n, i in enumerate(order)]
    few = impact_search.top_k(df.filter("vec_id < 3"), F.col("vec_id") == 0, 10)
    assert few.count() == 2 and impact_search.top_k(df.limit(0), F.lit(True), 3).count() == 0
    clash = df.selectExpr("vec_id", "embedding", "'x' AS rows", "1 AS score", "2 AS block", "vec_id AS id")
    assert impact_search.top_k(clash, F.col("vec_id") % 10 == 0, 10).count() == 10 * len(queries)


def test_search_refuses_scores_beyond_63_bits(spark):
    df = spark.createDataFrame([(i, [float(2**e)] * 4) for i, e in enumerate((18, 18, 30))], "vec_id long, embedding array<double>")
    got = impact_search.top_k(df.filter("vec_id < 2"), F.col("vec_id") == 0, 3).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 4 * 2**56)]
    with pytest.raises(Exception, match="63 bits"):
        impact_search.top_k(df, F.col("vec_id") == 0, 3).collect()


def test_search_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(queries.SQL["op7_impact_search"]).fetchall()
    got = queries.QUERIES["op7_impact_search"](spark, SF).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_search_with_repeated_keys_equals_brute_force(spark):
    rows = [(i % 150, v) for i, v in enumerate(x for _, x in vectors()[:200])]
    rows += [rows[10]] * 3 + [rows[20]] * 2 + [(20, v) for _, v in rows[30:60]] + [rows[5]] * 4 + [(7, rows[8][1])] * 12
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ids, x = np.asarray([i for i, _ in rows]), np.floor(np.asarray([v for _, v in rows]) * 1024).astype(np.int64)
    want = []
    for q in np.flatnonzero(ids % 10 == 0):
        score = x @ x[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:10]
        want += [(int(ids[q]), n + 1, int(ids[i]), int(score[i])) for n, i in enumerate(order)]
    for block in (2048, 32):
        assert sorted(map(tuple, impact_search.top_k(df, F.col("vec_id") % 10 == 0, 10, block=block).collect())) == sorted(want)


def test_search_proof_allows_for_all_own_rows():
    rnd = np.random.default_rng(5)
    for _ in range(20):
        x = rnd.integers(-60, 60, (600, 8))
        q = rnd.integers(-60, 60, (1, 8))
        ids = np.arange(600)
        x[:40], ids[:40] = q, 0  # forty own rows, the best of the block for all but the longest
        _, row, score = impact_search.Index(ids, x).search(q, np.asarray([0]), 10)
        s = x @ q[0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != 0][:10]
        assert list(row) == order and list(score) == list(s[order])
