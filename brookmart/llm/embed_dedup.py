"""Embedding near-dedup by collision counting on sorted one-dimensional projections.

Every vector is projected on many random directions. `SKETCH` of the projections are kept as small integers; further ones,
`coarse` for each of `rounds` rounds, deal the vectors to cells, so that near ones share a cell in some round. Within a
cell the vectors are sorted by the round's projection, and each is the centre of windows on all kept ones: a pair collides where
it falls into one another's window, and collisions are counted per pair. Pairs that reach the count calibrated for the
recall are candidates. Candidates hang together as clusters, whose members meet once more with their vectors; there pairs
are verified in double precision, counted per vector and united. No task returns pairs: only members, counts and links
that span what is joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import discard, saved, small_batches

#: Projections whose window collisions are counted, half a window in units of the largest distance that links, and steps
#: of a kept projection in that unit.
SKETCH, WINDOW, STEPS = 32, 2.5, 5
#: Unrelated vectors that a vector may meet in a round, on average.
MATES = 512
#: Cells of more vectors are dealt to blocks of about so many, which meet in pairs.
LIMIT = 4096
#: Components of vectors that are compared at a time.
PAIR_VALUES = 1 << 22
#: Rounds are told by the low bits of a cell's code; more than they can tell are an error.
ROUND_BITS = 16
#: Rounds that are looked through at a time for an earlier meeting of a pair.
EARLIER = 4


def same_cell(sd: float, width: float) -> float:
    """The probability that two projections whose difference has this deviation share a cell of a shifted grid."""
    x = width / sd
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


def calibrate(threshold: float, rows: int, miss: float) -> tuple[int, float, int, int]:
    """Coarse projections, the width of a cell, rounds and the count: a pair at the threshold shares no cell, or collides
    less often than the count, with a probability of at most `miss`; unrelated vectors meet about MATES others a round.
    Coarse projections grow with the logarithm of the rows, rounds with a small power of them."""
    d = math.sqrt(2 - 2 * threshold)
    p = math.erf(WINDOW / math.sqrt(2))
    count, tail = 0, 0.0
    while (tail := tail + math.comb(SKETCH, count) * p**count * (1 - p) ** (SKETCH - count)) <= miss / 4:
        count += 1
    best = None
    for width in (x * d / 2 for x in range(4, 25)):
        far, near = same_cell(math.sqrt(2), width), same_cell(d, width)
        coarse = max(1, math.ceil(math.log(MATES / max(rows, MATES + 1)) / math.log(far)))
        rounds = max(1, math.ceil(math.log(miss / 2) / math.log1p(-p * near**coarse)))
        if best is None or rounds < best[2]:
            best = coarse, width, rounds, count
    if best[2] > 1 << ROUND_BITS:
        raise ValueError(f"{best[2]} rounds are needed; the threshold is too low for so many rows")
    return best


@lru_cache(maxsize=8)
def draws(dims: int, threshold: float, coarse: int, width: float, rounds: int, seed: int) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function from unit vectors to their cells' codes (a number a round) and sketches (bytes)."""
    rng = np.random.default_rng([seed, dims])
    directions, shift = rng.standard_normal((dims, SKETCH + rounds * coarse)), rng.random(rounds * coarse) * width
    salt = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dims)
    step = math.sqrt(2 - 2 * threshold) / STEPS

    def sketch(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = u @ directions
        kept = np.clip(np.floor(y[:, :SKETCH] / step) + 128, 0, 255).astype(np.uint8)
        cells = np.floor((y[:, SKETCH:] + shift) / width).astype(np.int64).astype(np.uint64).reshape(len(u), rounds, coarse)
        code = np.broadcast_to(salt, (len(u), rounds)).copy()
        for j in range(coarse):
            code = (code ^ cells[:, :, j]) * np.uint64(0xBF58476D1CE4E5B9)
            code ^= code >> np.uint64(29)
        low = np.uint64((1 << ROUND_BITS) - 1)
        return ((code & ~low) | np.arange(rounds, dtype=np.uint64)).view(np.int64), kept

    return sketch


def unit(flat: np.ndarray, dims: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, most: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of at least `most` rows with all rows of each of their keys, and the number of each row's key; the batches
    are sorted by it."""
    held: list[pa.RecordBatch] = []

    def numbered(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        return table, np.concatenate([[0], np.cumsum(np.diff(table.column(key).to_numpy()) != 0)])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cut = np.flatnonzero(np.diff(keys))
        cut = int(cut[-1]) + 1 if len(cut) else 0
        new = bool(held) and held[-1].column(key)[-1].as_py() != keys[0]
        if (cut or new) and sum(x.num_rows for x in held) + cut >= most:
            yield numbered(pa.Table.from_batches([*held, *([batch.slice(0, cut)] if cut else [])]))
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield numbered(pa.Table.from_batches(held))


def collide(sketches: np.ndarray, run: np.ndarray, by: np.ndarray, side: np.ndarray, count: int, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one run that collide in the window of the projection `by`, one for each run, by which it is sorted, and in
    at least `count` of all windows; side: -1, or the blocks 0 and 1 of which only mixed pairs are wanted."""
    half = math.ceil(WINDOW * STEPS) + 1
    place = run * 1024 + sketches[np.arange(len(run)), by]
    order = np.argsort(place, kind="stable")
    place = place[order]
    until = np.searchsorted(place, place + half, side="right")
    x, side = np.ascontiguousarray(sketches[order].T), side[order]
    first, second = [], []
    for begin in range(0, len(order), block):
        end = min(begin + block, len(order))
        to = int(until[end - 1])
        misses = np.zeros((end - begin, to - begin), np.uint8)
        for c in range(SKETCH // 2):
            # The difference is taken modulo 256: what wraps round only adds candidates.
            misses += (x[c, begin:end, None] - x[c, None, begin:to] + np.uint8(half)) > 2 * half
        i, j = np.nonzero(misses <= SKETCH - count)
        keep = (j > i) & (begin + j < until[begin + i])
        i, j = i[keep], j[keep]
        keep = (side[begin + i] < 0) | (side[begin + i] != side[begin + j])
        i, j = i[keep], j[keep]
        total = misses[i, j]
        for c in range(SKETCH // 2, SKETCH):
            total += (x[c, begin + i] - x[c, begin + j] + np.uint8(half)) > 2 * half
        keep = total <= SKETCH - count
        first.append(order[begin + i[keep]])
        second.append(order[begin + j[keep]])
    return np.concatenate(first), np.concatenate(second)


def pairs_of_runs(run: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of rows with one run, some `most` at a time; run ascends."""
    end = np.searchsorted(run, run, side="right")
    many = end - np.arange(len(run)) - 1
    upto = np.concatenate([[0], np.cumsum(many)])
    begin = 0
    while begin < len(run):
        to = max(begin + 1, int(np.searchsorted(upto, upto[begin] + most, side="right")) - 1)
        i = np.repeat(np.arange(begin, to), many[begin:to])
        yield i, i + 1 + np.arange(len(i)) - np.repeat(upto[begin:to] - upto[begin], many[begin:to])
        begin = to


def unmet(codes: np.ndarray, hits: np.ndarray, p: np.ndarray, q: np.ndarray, among: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Which of the pairs `among` (places in p, q, hits and now) have met in no round before theirs: a pair counts where it meets
    first. The look at a pair ends with the first round that it met in, which near copies do early."""
    left, done = among, []
    for r in range(0, codes.shape[1], EARLIER):
        ripe = now[left] <= r
        done.append(left[ripe])
        left = left[~ripe]
        if not len(left):
            break
        rounds = np.arange(r, min(r + EARLIER, codes.shape[1]))
        met = (codes[p[left, None], rounds] == codes[q[left, None], rounds]) & hits[left[:, None], rounds % SKETCH] & (rounds < now[left, None])
        left = left[~met.any(1)]
    return np.sort(np.concatenate([*done, left]))


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of 0..n-1 reaches over the links (a, b)."""
    out = np.arange(n)
    while True:
        least = out.copy()
        np.minimum.at(least, a, out[b])
        np.minimum.at(least, b, out[a])
        least = least[least]
        if (least == out).all():
            return out
        out = least


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding", miss: float = 1e-5, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row: links are pairs with a cosine of at least the threshold.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing (they are kept). Vectors
    link only within their own length. Equal vectors are one class: copies count as links but are not paired. Rows that
    share a key are vectors of their own, each with its links; component_id is the least key that a row's vector reaches. A
    null key links with nothing. Empty tables give no rows. A pair at the threshold is missed with a probability of at most `miss`, closer ones far less often. Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kind = vectors.select(vector).schema[0].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull()
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    # A class has a number of its own, since a key may stand for several vectors.
    classes = saved(rows.filter("sound").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "classes")
    coarse, width, rounds, count = calibrate(threshold, classes.count(), miss)

    def sketcher(dims: int):
        return draws(dims, threshold, coarse, width, rounds, seed)

    def project(batches):
        for batch in batches:
            v = batch.column("v")
            length = np.diff(v.offsets.to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
            for dims in np.unique(length):
                at = pa.array(np.flatnonzero(length == dims))
                codes, kept = sketcher(int(dims))(unit(v.take(at).flatten().to_numpy(), int(dims)))
                edge = pa.array(np.arange(len(at) + 1, dtype=np.int32) * rounds)
                yield pa.RecordBatch.from_arrays([batch.column("node").take(at), pa.ListArray.from_arrays(edge, pa.array(codes.ravel())), pa.array([x.tobytes() for x in kept], pa.binary())], ["node", "codes", "sketch"])

    sketches = saved(classes.select("node", "v").mapInArrow(project, "node long, codes array<long>, sketch binary"), "sketches")
    dealt = sketches.select("node", F.explode("codes").alias("cell"), "sketch")
    hot = saved(dealt.groupBy("cell").agg(F.count("*").alias("size")).filter(F.col("size") > LIMIT), "hot")
    n_hot = hot.count()
    if n_hot:
        # Blocks of a hot cell meet in pairs, so no task holds more than two of them.
        dealt = dealt.join(F.broadcast(hot) if n_hot <= 100_000 else hot, "cell", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / LIMIT), F.lit(1)))
        own = F.pmod(F.xxhash64("node", "cell"), F.col("blocks"))
        dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        met = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
        meeting = F.when(F.col("blocks") > 1, met.bitwiseAND(F.lit(~((1 << ROUND_BITS) - 1))).bitwiseOR(F.col("cell").bitwiseAND(F.lit((1 << ROUND_BITS) - 1)))).otherwise(F.col("cell"))
        side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
        dealt = dealt.select("node", meeting.alias("cell"), "sketch", side.cast("byte").alias("side"))
    else:
        dealt = dealt.withColumn("side", F.lit(-1).cast("byte"))

    def round_of(table: pa.Table) -> np.ndarray:
        return table.column("cell").to_numpy() & ((1 << ROUND_BITS) - 1)

    def count_collisions(batches):
        for table, run in whole_runs(batches, "cell"):
            x = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            side = table.column("side").to_numpy()
            a, b = collide(x, run, round_of(table) % SKETCH, side, count)
            who = np.unique(np.concatenate([a, b]))
            if len(who):
                node, cell, part = table.column("node").to_numpy(), table.column("cell").to_numpy(), labels(len(run), a, b)
                out = [pa.array(node[who]), pa.array(cell[who]), pa.array(node[part[who]]), pa.array(side[who]), table.column("sketch").combine_chunks().take(pa.array(who))]
                yield pa.RecordBatch.from_arrays(out, ["node", "cell", "first", "side", "sketch"])

    members = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(count_collisions, "node long, cell long, first long, side byte, sketch binary")
    members = saved(members, "members")
    half = math.ceil(WINDOW * STEPS) + 1

    def verify(batches):
        for table, run in whole_runs(batches, "cluster"):
            v = table.column("v").combine_chunks()
            length = np.diff(v.offsets.to_numpy())
            for dims in np.unique(length):  # a cluster's vectors have one length
                at = np.flatnonzero(length == dims)
                some = table.take(pa.array(at))
                u = unit(some.column("v").combine_chunks().flatten().to_numpy(), int(dims))
                codes, _ = sketcher(int(dims))(u)
                x = np.frombuffer(b"".join(some.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
                node, copies, side = (some.column(k).to_numpy() for k in ("node", "copies", "side"))
                now = round_of(some)
                near, part = np.zeros(len(u), np.int64), np.arange(len(u))
                for p, q in pairs_of_runs(run[at], PAIR_VALUES // int(dims)):
                    keep = (side[p] < 0) | (side[p] != side[q])
                    p, q = p[keep], q[keep]
                    hits = np.abs(x[p].astype(np.int16) - x[q]) <= half
                    keep = np.flatnonzero((hits.sum(1) >= count) & hits[np.arange(len(p)), now[p] % SKETCH] & (codes[p, now[p]] == codes[q, now[p]]))
                    first = unmet(codes, hits, p, q, keep, now[p])
                    p, q = p[first], q[first]
                    close = np.einsum("ij,ij->i", u[p], u[q]) >= threshold
                    p, q = p[close], q[close]
                    np.add.at(near, p, copies[q])
                    np.add.at(near, q, copies[p])
                    new = part[p] != part[q]
                    if new.any():
                        part = labels(len(u), np.concatenate([np.arange(len(u)), p[new]]), np.concatenate([part, q[new]]))
                linked = np.flatnonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[part[linked]]), pa.array(near[linked])], ["node", "to", "others"])

    known = classes.select("node", "v", "copies").join(members, "node").withColumn("cluster", F.xxhash64("cell", "first"))
    met = saved(known.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(verify, "node long, to long, others long"), "links")
    degree = met.groupBy("node").agg(F.sum("others").alias("others"))
    joined = components(met.select(F.col("node").alias("a"), F.col("to").alias("b")))
    discard(sketches, hot, members)
    named = joined.join(classes.select("node", "id"), "node")
    least = named.join(named.groupBy("component").agg(F.min("id").alias("least")), "component").select("node", "least")
    whole = classes.join(degree, "node", "left").join(least, "node", "left")
    labelled = whole.select("v", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    plain = rows.filter("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = rows.filter("sound").join(labelled, "v").select("id", "n_links", "component_id").unionByName(plain)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def sql(threshold: float = 0.95, vectors: str = "embeddings") -> str:
    """The same over `vectors` (vec_id, embedding), whose keys are distinct, in DuckDB's SQL."""
    return f"""
WITH RECURSIVE u AS (
  SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS x FROM {vectors}
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([1 for x in embedding if x <> 0]) > 0),
links AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= {threshold}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM {vectors} UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM {vectors} e JOIN least ON least.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
