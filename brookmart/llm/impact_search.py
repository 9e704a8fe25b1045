"""Exact top-k search by inner product on an impact-ordered, score-at-a-time index.

A component of a vector is an impact, a dimension and sign a term. The index of a block of rows has, for every term, its
postings cut into segments of one quantised impact level. Queries meet a block together: segments come in descending
level, each adds weight x level to its rows, and what is still to come bounds every row's final score from above. A
query stops only when the bound proves that no more rows than a few can be among its best; those are rescored exactly.
The queries are copied to every block of rows, whose index is built once, and every block returns k rows a query at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Quantised levels of an index.
LEVELS = 64
#: Levels between two looks at the bounds.
LOOK = 8
#: Rows of a pack, the unit that is shuffled, and packs of queries that pass an index together.
PACK, TOGETHER = 64, 8
#: Bounds (rows x queries) that a task holds at a time; the largest block, which takes half a gigabyte in its task.
BOUNDS, LARGEST = 1 << 23, 131_072
#: Tasks are as many as blocks up to here.
MOST_TASKS = 20_000
#: Equal query rows that share a search; more are several searches, so their results are no single task's work.
EQUAL = 4096


class Index:
    """The impact-ordered postings of a block: x is rows x dimensions, integers."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: int = LEVELS):
        self.ids, self.x = ids, x
        self.top = top = int(np.abs(x).max(initial=0))
        self.step = max(1, -(-(top + 1) // levels))
        level = np.abs(x) // self.step
        self.rest = np.abs(x).max(axis=0, initial=0).astype(np.float64)
        #: (level, dimension, sign, rows), by descending level
        self.segments: list[tuple[int, int, int, np.ndarray]] = []
        for d in range(x.shape[1]):
            code = level[:, d] * 2 + (x[:, d] > 0)
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.diff(code[order])) + 1
            for rows in np.split(order, cuts):
                if len(rows) and (x[rows, d] != 0).any():
                    self.segments.append((int(level[rows[0], d]), d, 1 if x[rows[0], d] > 0 else -1, rows))
        self.segments.sort(key=lambda s: -s[0])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, row number and exact score of each query's k best rows, ties to the smaller id. own: ids to leave out."""
        n, m = len(queries), len(self.ids)
        q = queries.astype(np.float64)
        size = np.abs(q)
        slack = size.sum(1) * (self.top + self.step) * 2.0**-44  # of sums in floating point
        acc = np.zeros((m, n))
        at, open_ = 0, np.arange(n)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        names, times = np.unique(self.ids, return_counts=True)
        place = np.minimum(np.searchsorted(names, own), max(len(names) - 1, 0))
        mine = np.where(names[place] == own, times[place], 0) if m else np.zeros(n, np.int64)  # a query's own rows in the block
        few = np.maximum(4 * (k + mine), m // 64)
        while len(open_):
            level = self.segments[at][0] if at < len(self.segments) else 0
            while at < len(self.segments) and self.segments[at][0] == level:
                _, d, sign, rows = self.segments[at]
                acc[rows] += (sign * (level + 0.5) * self.step) * q[open_, d]
                at += 1
            done = at >= len(self.segments)
            if not done and level % LOOK:
                continue
            # A component read is off by half a step at most; one unread is below this level's impacts and its dimension's largest.
            bound = size[open_] @ np.minimum(self.rest, float(level * self.step)) if level else size[open_].sum(1) * (self.step / 2)
            bound = bound + slack[open_]
            kth = np.empty(len(open_))
            for r in np.unique(mine[open_]):  # so many more: the query's own rows may be among the best
                same = mine[open_] == r
                kth[same] = np.partition(acc[:, same], -min(k + r, m), axis=0)[-min(k + r, m)]
            member = acc >= kth - 2 * bound
            proven = np.flatnonzero((member.sum(0) <= few[open_]) | done)
            for j in proven:
                found.append((np.full(int(member[:, j].sum()), open_[j]), np.flatnonzero(member[:, j])))
            left = np.setdiff1d(np.arange(len(open_)), proven)
            acc, open_ = acc[:, left], open_[left]
        who = np.concatenate([x for x, _ in found] or [np.zeros(0, int)])
        row = np.concatenate([x for _, x in found] or [np.zeros(0, int)])
        keep = self.ids[row] != own[who]
        who, row = who[keep], row[keep]
        score = np.concatenate([np.einsum("ij,ij->i", queries[who[i : i + 65536]], self.x[row[i : i + 65536]]) for i in range(0, len(who), 65536)] or [np.zeros(0, np.int64)])
        order = np.lexsort((self.ids[row], -score, who))
        who, row, score = who[order], row[order], score[order]
        begin = np.searchsorted(who, np.arange(n))
        best = np.arange(len(who)) - begin[who] < k if len(who) else np.zeros(0, bool)
        return who[best], row[best], score[best]


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy().astype(np.int64).reshape(len(lists), -1)


def _fits(x: np.ndarray, q: np.ndarray) -> None:
    """An error unless every inner product of the rows of x and q fits in 63 bits."""
    if x.shape[1] * float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) >= 2.0**62:
        raise ValueError("components are too large: a score may not fit in 63 bits")


def meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Packs of rows (dims, block, kind, rows), a block's candidates (kind 0) before its queries (kind 1): the index of a
    block is built once, and queries pass by in groups. Only one block's rows and one group's bounds are held."""
    at, held, index, times = None, [], None, None
    for batch in batches:
        marks = list(zip(batch.column("block").to_pylist(), batch.column("dims").to_pylist(), batch.column("kind").to_pylist(), strict=True))
        i = 0
        while i < len(marks):
            j = i + 1
            few = max(1, BOUNDS // (PACK * max(1, sum(len(x) for x in held)))) if marks[i][2] else TOGETHER
            while j < len(marks) and marks[j] == marks[i] and j - i < min(TOGETHER, few):
                j += 1
            rows = batch.column("rows").slice(i, j - i).flatten()
            if marks[i][:2] != at:
                at, held, index = marks[i][:2], [], None
            if marks[i][2] == 0:
                held.append(rows)
            elif held:
                if index is None:
                    cs = pa.concat_arrays(held)
                    index, times = Index(cs.field("id").to_numpy(), _matrix(cs.field("v"))), cs.field("copies").to_numpy()
                asked = _matrix(rows.field("v"))
                _fits(index.x, asked)
                who, row, score = index.search(asked, rows.field("id").to_numpy(), k)
                own = [pa.array(rows.field(x).to_numpy()[who]) for x in ("id", "mark", "part", "copies")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(index.ids[row]), pa.array(score), pa.array(times[row])], ["query_id", "mark", "part", "asked", "vec_id", "score", "copies"])
            i = j


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: for each row that is_query marks, the k rows with the highest inner product of
    floor(scale x component), ties to the smaller key; all other rows if there are fewer.

    Rows whose vector is null, empty or holds null or non-finite components, or whose key is null, take no part, as
    queries and as candidates; vectors of other lengths than the query's are no candidates. A query's candidates leave
    out all rows with its own key; rows that share another key are candidates each. Query rows that share a key have k
    rows each, with ranks of their own. Other columns are not read. Components so large that a score might not fit in 63
    bits (some 2^28 after scaling, in 64 dimensions) are an error. block: rows an index (by default 2,048 to 131,072, with
    the number of rows). Tasks follow the blocks, so they grow with the rows; queries are copied to every block.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    sound = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(sound).select("id", F.size("v").alias("dims"), F.transform("v", lambda x: F.floor(x * scale)).alias("v"), F.coalesce("q", F.lit(False)).alias("q"))
    n, queries = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0))).first()
    block = block or min(LARGEST, max(2_048, n // 4_096))
    blocks = max(1, -(-n // block))
    tasks = min(blocks, MOST_TASKS)

    # Equal rows once, with their count. A block is a hash of the key and vector: however many rows share a key, it stays near
    # its size.
    distinct = rows.groupBy("id", "dims", "v").agg(F.count("*").alias("copies"), F.sum(F.col("q").cast("long")).alias("asked"))
    number = lambda of: F.pmod(F.xxhash64("id", "v"), F.lit(of))
    member = lambda copies, part: F.struct("id", "v", copies.alias("copies"), part.alias("part"), F.xxhash64("v").alias("mark"))
    zero = F.lit(0).cast("long")
    candidates = distinct.groupBy("dims", number(blocks).alias("block"), F.pmod(F.xxhash64("v", "id", F.lit(1)), F.lit(-(-block // PACK))).alias("pack")).agg(F.collect_list(member(F.col("copies"), zero)).alias("rows"))
    asked = distinct.filter("asked > 0").withColumn("part", F.explode(F.sequence(zero, F.floor((F.col("asked") - 1) / EQUAL))))
    share = F.least(F.lit(EQUAL).cast("long"), F.col("asked") - F.col("part") * EQUAL)
    packs = asked.groupBy("dims", number(max(1, -(-queries // PACK))).alias("pack")).agg(F.collect_list(member(share, F.col("part"))).alias("rows"))
    copied = packs.withColumn("block", F.explode(F.sequence(zero, F.lit(blocks - 1).cast("long"))))
    both = candidates.select("dims", "block", F.lit(0).alias("kind"), "rows").unionByName(copied.select("dims", "block", F.lit(1).alias("kind"), "rows"))
    met = both.repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int")).sortWithinPartitions("block", "dims", "kind")

    best = met.mapInArrow(lambda batches: meet(batches, k), "query_id long, mark long, part long, asked long, vec_id long, score long, copies long")
    order = Window.partitionBy("query_id", "mark", "part").orderBy(F.desc("score"), "vec_id").rowsBetween(Window.unboundedPreceding, -1)
    first = best.withColumn("before", F.coalesce(F.sum("copies").over(order), F.lit(0))).filter(F.col("before") < k)
    ranked = first.withColumn("rank", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("copies"), F.lit(k)))))
    each = ranked.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("asked"))))
    return each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def sql(is_query: str, k: int = 10, scale: int = 1024, vectors: str = "embeddings") -> str:
    """The same over `vectors` (vec_id, embedding), whose keys are distinct, in DuckDB's SQL."""
    return f"""
WITH v AS (
  SELECT vec_id, [floor({scale} * CAST(x AS DOUBLE)) for x in embedding] AS x FROM {vectors}
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE {is_query}) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= {k}"""
