"""MinHash near-dedup with sequential Bayesian verification.

Documents with one shingle set are a class. Signatures of classes are banded; a bucket's classes are candidates. A
candidate pair's signatures are compared batch by batch, and the pair is given up once the posterior probability that its
similarity reaches the threshold falls below the chosen miss probability. Survivors are verified on their full sets.

A bucket's classes are first compared with two hubs each, one of them the class with the most bucket mates, which is linear
in its size. What the links then leave apart is compared in full: every class outside the hub's component with every
class of the bucket in another component. Small buckets give their pairs as rows; the classes of large ones meet in blocks
of signatures and full sets, whose tasks verify the pairs and return links that span them, never the pairs themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import Scratch, by_bytes, small_batches, text_views
from .words import mix, shingle_sets

BANDS, ROWS = 25, 5
#: Bytes of texts that are hashed together.
PART = 1 << 19
#: Hash functions of a signature (16 bits of each are kept; the bands use all 32 of the first 125), and of a batch.
HASHES, BATCH = 256, 32
#: Buckets of more classes than this meet in blocks, of about so many bytes of signatures and sets.
SMALL, BLOCK = 16, 1 << 21
#: Up to so many ids (8 bytes each) are broadcast to filter texts, signatures or sets; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_rng = np.random.default_rng(41)
MULTIPLY = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(values: np.ndarray, n: int = HASHES) -> np.ndarray:
    """The least of each of the first n hash functions over a set, 32 bits each."""
    out = np.full(n, np.uint32(0xFFFFFFFF))
    for i in range(0, len(values), 2048):
        part = values[i : i + 2048]
        out = np.minimum(out, ((part[None, :] * MULTIPLY[:n, None] + ADD[:n, None]) >> np.uint64(32)).min(1).astype(np.uint32))
    return out


def least_matches(threshold: float, miss: float, batch: int = BATCH, total: int = HASHES) -> list[int]:
    """After each batch, the matches below which a pair is given up: with a uniform prior, the posterior of the
    similarity after k matches in m is Beta(k+1, m-k+1), and its tail is a binomial sum: P(s > t) = P(Bin(m+1, t) <= k)."""
    out = []
    for m in range(batch, total + 1, batch):
        tail, k = 0.0, 0
        while k <= m:
            tail += math.comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
            if tail >= miss:
                break
            k += 1
        out.append(k)
    return out


def _digests(values: np.ndarray, where: np.ndarray) -> list[pa.Array]:
    """Size and two sums of hashes of each set."""
    out = [np.diff(where).astype(np.int64)]
    for hashed in (mix(values), mix(values ^ np.uint64(0x5DEECE66D))):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashed, dtype=np.uint64)])
        out.append((sums[where[1:]] - sums[where[:-1]]).view(np.int64))
    return [pa.array(x) for x in out]


def _banded(docs: DataFrame, width: int) -> DataFrame:
    """Digests and bands of every text; only the hash functions of the bands are computed."""

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, "text", PART):
                values, where = shingle_sets(*text_views(batch.column("text")), width)
                signs = [signature(values[a:b], BANDS * ROWS) if b > a else None for a, b in zip(where[:-1], where[1:], strict=True)]
                bands = [None if s is None else mix((s.reshape(BANDS, ROWS).astype(np.uint64) * BAND).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64) for s in signs]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *_digests(values, where), pa.array(bands, pa.list_(pa.int64()))], ["id", "n_shingles", "d1", "d2", "bands"])

    return docs.mapInArrow(run, "id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Class, size, whole signature and full set of texts (node, d1, d2, n, text) whose digests are those given."""

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, "text", PART):
                values, where = shingle_sets(*text_views(batch.column("text")), width)
                same = [a.to_numpy() == batch.column(k).to_numpy() for a, k in zip(_digests(values, where), ("n", "d1", "d2"), strict=True)]
                keep = np.flatnonzero(np.logical_and.reduce(same))
                each = [values[where[i] : where[i + 1]] for i in keep]
                signs = [signature(x).astype(np.uint16).tobytes() for x in each]
                own = [batch.column(k).take(pa.array(keep)) for k in ("node", "n")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(signs, pa.binary()), pa.array([x.tobytes() for x in each], pa.binary())], ["id", "n_shingles", "signature", "members"])

    return docs.select("node", "d1", "d2", "n", "text").mapInArrow(run, "id long, n_shingles long, signature binary, members binary")


def _only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose id is in ids (id), a written table of distinct ids."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _near(m: str, n: str, threshold: float) -> Column:
    """Sets of these sizes can reach the threshold: their intersection is at most the smaller, their union at least the larger."""
    return F.least(m, n) >= threshold * F.greatest(m, n) - 1e-9


def _survivors(pairs: DataFrame, signs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs that the signatures do not rule out."""
    least = least_matches(threshold, miss)

    def run(batches):
        for batch in batches:
            keep = np.arange(batch.num_rows)
            if len(keep):
                a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint16).reshape(len(keep), -1) for x in ("sa", "sb"))
                na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
                keep = keep[np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9]
                matches = np.zeros(len(a), np.int64)
                for i, k in enumerate(least):
                    part = slice(i * BATCH, (i + 1) * BATCH)
                    matches[keep] += (a[keep, part] == b[keep, part]).sum(1)
                    keep = keep[matches[keep] >= k]
            yield pa.RecordBatch.from_arrays([batch.column(x).take(pa.array(keep)) for x in ("a", "b")], ["a", "b"])

    both = pairs.join(signs.drop("bands").toDF("a", "na", "sa"), "a").join(signs.drop("bands").toDF("b", "nb", "sb"), "b")
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def meet(ls: pa.Table, rs: pa.Table, percent: int, miss: float) -> tuple[list[int], list[int]]:
    """Links that span what two blocks of classes join: pairs of a left and a right class of different components with a band
    in common go through the posterior bounds and are then verified on their full sets, the likeliest first. A link unites
    two components here, so their other pairs need no look, and a block gives fewer links than it has classes."""
    threshold, least = percent / 100, least_matches(percent / 100, miss)

    def block(t: pa.Table) -> tuple[np.ndarray, ...]:
        sign = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint16).reshape(t.num_rows, -1)
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        values = np.frombuffer(b"".join(t.column("members").to_pylist()), np.uint64)
        return t.column("node").to_numpy(), t.column("n").to_numpy(), sign, bands, values, np.concatenate([[0], np.cumsum(t.column("n").to_numpy())])

    (x, nx, sx, bx, vx, ax), (y, ny, sy, by, vy, ay) = block(ls), block(rs)
    _, part = np.unique(np.concatenate([ls.column("c").to_numpy(), rs.column("c").to_numpy()]), return_inverse=True)
    px, py = part[: len(x)], part[len(x) :]  # components by number, the same one for what is united
    found: tuple[list[int], list[int]] = ([], [])
    for i in range(len(x)):
        to = np.flatnonzero((py != px[i]) & (np.minimum(ny, nx[i]) >= threshold * np.maximum(ny, nx[i]) - 1e-9))
        to = to[(by[to] == bx[i]).any(1)]
        matches = np.zeros(len(to), np.int64)
        for j, k in enumerate(least):
            if not len(to):
                break
            cut = slice(j * BATCH, (j + 1) * BATCH)
            matches += (sy[to, cut] == sx[i, cut]).sum(1)
            to, matches = to[matches >= k], matches[matches >= k]
        to, own, at, some = to[np.argsort(-matches, kind="stable")], vx[ax[i] : ax[i + 1]], 0, 8
        while at < len(to):
            now = to[at : at + some]
            at, some = at + some, 2 * some
            now = now[py[now] != px[i]]
            if not len(now):
                continue
            begin = np.concatenate([[0], np.cumsum(ny[now])])
            theirs = vy[np.repeat(ay[now] - begin[:-1], ny[now]) + np.arange(begin[-1])]
            same = np.add.reduceat(own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs, begin[:-1], dtype=np.int64)
            for k in now[100 * same >= percent * (nx[i] + ny[now] - same)]:
                if py[k] != px[i]:
                    found[0].append(int(min(x[i], y[k])))
                    found[1].append(int(max(x[i], y[k])))
                    old, new = py[k], px[i]
                    px[px == old], py[py == old] = new, new
    return found


def _met(many: DataFrame, signs: DataFrame, sets: DataFrame, percent: int, miss: float, tmp: Scratch) -> DataFrame:
    """Links of the classes of large buckets (bucket, node, c, hub_c). Buckets with hubs of one component are a group: its
    classes outside that component meet all of its classes, in blocks of some BLOCK bytes. So a class is sent once for its
    group and block of the other side, not for each of its buckets, and its full set goes with it."""
    sizes = F.col("n") * 8 + (2 * HASHES + 8 * BANDS + 64)
    nodes = many.groupBy(F.col("hub_c").alias("g"), "node").agg(F.max(F.col("c") != F.col("hub_c")).alias("left"), F.first("c").alias("c"), F.first("n").alias("n"))
    nodes = tmp.saved(nodes, "grouped")
    blocks = nodes.groupBy("g").agg(*(F.ceil(F.sum(F.when(F.lit(side) | F.col("left"), sizes).otherwise(0)) / BLOCK).alias(k) for k, side in (("nl", False), ("nr", True))))
    wanted = tmp.saved(nodes.select(F.col("node").alias("id")).distinct(), "wanted")
    full = nodes.join(blocks, "g").join(_only(signs, wanted).select(F.col("id").alias("node"), "signature", "bands"), "node").join(_only(sets, wanted).withColumnRenamed("id", "node"), "node")
    full = full.withColumn("block", F.pmod(F.xxhash64("node"), "nr"))
    out = ["g", "lb", "rb", "node", "c", "n", "signature", "bands", "members"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    right = full.withColumns({"rb": F.col("block"), "lb": every("nl")}).select(*out)
    left = full.filter("left").withColumns({"lb": F.pmod(F.xxhash64("node", F.lit(1)), "nl"), "rb": every("nr")}).select(*(F.col(k).alias(f"l_{k}") for k in out))

    def run(ls: pa.Table, rs: pa.Table) -> pa.Table:
        ls = ls.rename_columns(out)
        a, b = meet(ls, rs, percent, miss) if ls.num_rows and rs.num_rows else ([], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    keys = out[:3]
    return left.groupBy(*(f"l_{k}" for k in keys)).cogroup(right.groupBy(*keys)).applyInArrow(run, "a long, b long").distinct()


def _apart(buckets: DataFrame, part: DataFrame, signs: DataFrame, sets: DataFrame, percent: int, miss: float, tmp: Scratch) -> DataFrame:
    """Links between classes with one bucket in different components, one of them not in the hub's."""
    own = buckets.join(part, "node", "left").select("bucket", "node", "n", F.col("hub.node").alias("hub"), "size", F.coalesce("component", "node").alias("c"))
    open_ = own.groupBy("bucket").agg(F.min(F.when(F.col("node") == F.col("hub"), F.col("c"))).alias("hub_c"), F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 <> c2")
    own = tmp.saved(own.join(open_.select("bucket", "hub_c"), "bucket"), "open")
    few = own.filter(F.col("size") <= SMALL)
    pairs = few.filter("c <> hub_c").select("bucket", F.col("node").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx")).join(few.select("bucket", F.col("node").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ny")), "bucket").filter(F.col("cx") != F.col("cy")).filter(_near("nx", "ny", percent / 100))
    small = _verified(_survivors(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), signs, percent / 100, miss), sets, percent, tmp)
    return small.unionByName(_met(own.filter(F.col("size") > SMALL), signs, sets, percent, miss, tmp)).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, tmp: Scratch) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union. Only the sets of the pairs' ends are shuffled."""
    pairs = tmp.saved(pairs, "candidates")
    sets = _only(sets, tmp.saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends"))

    def run(batches):
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist(), strict=True)):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                if 100 * same >= percent * (len(both) - same):
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(x).take(keep) for x in ("a", "b")], ["a", "b"])

    both = pairs.join(sets.toDF("a", "ma"), "a").join(sets.toDF("b", "mb"), "b")
    return both.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, key: str = "doc_id", text: str = "text", miss: float = 1e-5) -> DataFrame:
    """key, n_shingles, component_id and kept of each row.

    Words are runs other than space and \\x09-\\x0D of the whole text with A-Z in lower case; a document's set holds its
    distinct shingles of `width` words, or its whole sequence if it has fewer. Links join documents with
    100 * intersection >= percent * union. Null and empty texts have no shingles and link with nothing. component_id is
    the least key that is reachable; kept says that it is the row's own. Rows that share a key each go by their own text's
    class; a null key links with nothing, has a null component and is kept. Empty tables give no rows; other columns are not read.
    A pair at the threshold is missed by the bands with a probability of about 4e-7 at 85 % and 5e-5 at 80 %, and given
    up by the posterior bound with at most about `miss`. Sets are compared as 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    tmp = Scratch()
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    banded = tmp.saved(_banded(rows, width), "bands")
    digest = ["d1", "d2", "n_shingles"]
    # Copies have the same bands; whole signatures are made for classes that share a bucket only.
    # A class has a number of its own, since a key may stand for several texts.
    classes = tmp.saved(banded.filter("n_shingles > 0 and id is not null").groupBy(*digest).agg(F.min("id").alias("id"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "classes")
    spread = classes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    mated = tmp.saved(spread.join(shared, "bucket"), "mates")
    mates = mated.groupBy("node").agg(F.sum("size").alias("mates"))
    hubs = mated.join(mates, "node").groupBy("bucket").agg(F.max_by(F.struct("node", "n"), F.struct("mates", -F.col("node"))).alias("hub"), F.min(F.struct("node", "n")).alias("hub2"))
    buckets = tmp.saved(mated.join(hubs, "bucket"), "buckets")
    met = tmp.saved(classes.join(buckets.select("node").distinct(), "node", "left_semi").select("id", "node", "d1", "d2", F.col("n_shingles").alias("n")), "met")
    texts = rows.join(F.broadcast(met) if met.count() <= BROADCAST_IDS // 5 else met, "id").dropDuplicates(["node", "text"])
    full = tmp.saved(_sets(texts, width), "sets")
    sets = full.select("id", "members")
    signs = tmp.saved(full.drop("members").join(classes.select(F.col("node").alias("id"), "bands"), "id"), "signs")

    threshold = percent / 100
    ends = buckets.select("node", "n", F.explode(F.array("hub", "hub2")).alias("other")).filter(F.col("node") != F.col("other.node"))
    starred = ends.filter(_near("n", "other.n", threshold)).select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b")).distinct()
    first = tmp.saved(_verified(_survivors(starred, signs, threshold, miss), sets, percent, tmp), "links")
    part = components(first)

    # What is still apart within a bucket. Components stand for the links found before.
    more = tmp.saved(_apart(buckets, part, signs, sets, percent, miss, tmp), "links")
    if not more.isEmpty():
        part = components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    tmp.discard(banded, classes)

    named = part.join(classes.select("node", "id"), "node")
    least = named.join(named.groupBy("component").agg(F.min("id").alias("least")), "component").select("node", "least")
    known = classes.join(least, "node", "left").select(*digest, F.coalesce("least", "id").alias("least"))
    member = banded.select("id", *digest).join(known, digest, "left")
    out = member.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def sql(percent: int = 85, width: int = 5, documents: str = "documents") -> str:
    """The same over `documents` (doc_id, text), whose keys are distinct, by exact sets in DuckDB's SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= {width} THEN [array_to_string(w[i : i + {width - 1}], ' ') for i in range(1, len(w) - {width - 2})] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM words)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * same >= {percent} * (x.n + y.n - same)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM {documents} UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM {documents} d JOIN least ON least.a = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id"""
