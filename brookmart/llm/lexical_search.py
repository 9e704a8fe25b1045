"""Ranked lexical search with MaxScore in each shard of the documents.

Documents are counted once: their terms that some item asks for, with frequencies, and their lengths. Statistics of the
corpus (documents, tokens, documents of a term) are sums over all of them. A task inverts its documents shard by shard.
Within a shard a term's upper bound is the most that it adds to any score there. A query's lists are ordered by their
bounds and split: the bounds of the non-essential ones together do not reach the score of the query's k-th document, so
only documents in essential lists are candidates; non-essential lists are probed from the largest bound on, and only
for candidates that can still qualify. A query's best scores go on from shard to shard within a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch, by_bytes, small_batches, text_views
from .words import LOWER, prefix_sums, range_hash, spans

#: Documents of a shard, and bytes of texts that are counted together.
SHARD, PART = 8192, 1 << 20
#: Pairs of an item and a term that a pass over the documents takes; more items go by in several passes.
PASS_TERMS = 1_000_000
#: ASCII bytes that part terms.
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower())


def hashes(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the terms of texts, one text after another, and where each text's terms begin."""
    body = LOWER[body]
    begin, end, first = spans(body, at, BETWEEN)
    return range_hash(prefix_sums(body), begin, end), first


def counted(docs: DataFrame, asked: np.ndarray) -> DataFrame:
    """id, n (terms with repeats), terms (places in `asked`, ascending) and tfs of each document with a term; asked:
    ascending hashes of terms. Other terms count for n only."""

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, "text", PART):
                terms, first = hashes(*text_views(batch.column("text")))
                place = np.minimum(np.searchsorted(asked, terms), max(len(asked) - 1, 0))
                hit = np.flatnonzero(asked[place] == terms) if len(asked) else np.zeros(0, np.int64)
                owner = np.searchsorted(first, hit, side="right") - 1
                code, tf = np.unique(owner * np.int64(len(asked) + 1) + place[hit], return_counts=True)
                owner, term = np.divmod(code, len(asked) + 1)
                n = np.diff(first)
                edge = pa.array(np.searchsorted(owner, np.arange(len(n) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edge, pa.array(x.astype(np.int32))) for x in (term, tf)]
                out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n.astype(np.int64)), *lists], ["id", "n", "terms", "tfs"])
                yield out.take(pa.array(np.flatnonzero(n > 0)))

    return docs.mapInArrow(run, "id long, n long, terms array<int>, tfs array<int>")


class Shard:
    """The postings of some documents by term: places in the shard, ascending, and impacts."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, first: np.ndarray, terms: np.ndarray, tfs: np.ndarray, documents: int, tokens: int):
        order = np.argsort(ids, kind="stable")  # so that places ascend with keys, as ties do
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        m = 100 - 75 + (75 * n * documents) // tokens
        owner = np.repeat(np.arange(len(ids)), np.diff(first))
        impact = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[owner])
        order = np.lexsort((place[owner], terms))
        self.terms, self.places, self.impacts = terms[order], place[owner][order], impact[order]
        self.names, begin = np.unique(self.terms, return_index=True)
        self.cuts = np.append(begin, len(self.terms))
        self.most = np.maximum.reduceat(self.impacts, begin) if len(begin) else np.zeros(0, np.int64)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of at most k best documents of a query (distinct terms and their weights); least: the k-th
        best score so far, below which a document is of no use. And how many postings were probed."""
        at = np.minimum(np.searchsorted(self.names, terms), max(len(self.names) - 1, 0))
        here = (self.names[at] == terms) & (weights > 0) if len(self.names) else np.zeros(len(terms), bool)
        at, weights = at[here], weights[here]
        bound = weights * self.most[at]
        order = np.argsort(bound, kind="stable")
        at, weights, bound = at[order], weights[order], bound[order]
        upto = np.cumsum(bound)  # of a list and all with smaller bounds
        cut = int(np.searchsorted(upto, max(least, 1)))  # lists before it are non-essential: together they do not reach `least`
        scores, probed = np.zeros(len(self.ids), np.int64), 0
        for i in range(len(at) - 1, cut - 1, -1):
            part = slice(self.cuts[at[i]], self.cuts[at[i] + 1])
            scores[self.places[part]] += weights[i] * self.impacts[part]
            probed += part.stop - part.start
        found = np.flatnonzero(scores)
        for i in range(cut - 1, -1, -1):
            if len(found) > k:  # what the candidates have for sure raises the bar
                least = max(least, int(np.partition(scores[found], -k)[-k]))
            found = found[scores[found] + upto[i] >= least]
            part = slice(self.cuts[at[i]], self.cuts[at[i] + 1])
            places = self.places[part]
            if not len(found):
                break
            where = np.minimum(np.searchsorted(places, found), len(places) - 1)
            hit = places[where] == found
            scores[found[hit]] += weights[i] * self.impacts[part][where[hit]]
            probed += len(found)
        found = found[scores[found] >= max(least, 1)]
        best = found[np.lexsort((found, -scores[found]))][:k]
        return best, scores[best], probed


def shards(batches: Iterator[pa.RecordBatch], documents: int, tokens: int) -> Iterator[Shard]:
    """The documents of a task in shards."""
    held: list[pa.RecordBatch] = []

    def made() -> Shard:
        t = pa.Table.from_batches(held).combine_chunks()
        terms, tfs = t.column("terms").chunk(0), t.column("tfs").chunk(0)
        first = np.concatenate([[0], np.cumsum(np.diff(terms.offsets.to_numpy()))])
        return Shard(t.column("id").to_numpy(), t.column("n").to_numpy(), first, terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64), documents, tokens)

    for whole in batches:
        at = 0
        while at < whole.num_rows:
            part = whole.slice(at, SHARD - sum(x.num_rows for x in held))
            held.append(part)
            at += part.num_rows
            if sum(x.num_rows for x in held) == SHARD:
                yield made()
                held = []
    if held:
        yield made()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _pass(rows: DataFrame, words: DataFrame, k: int, tmp: Scratch) -> DataFrame:
    """The results of the items of words (item, term, times), few enough for one pass over the documents."""
    asked_rows = words.collect()  # PASS_TERMS at most, or one item's
    names = sorted({r.term for r in asked_rows})
    packed = [x.encode() for x in names]
    at = np.concatenate([[0], np.cumsum([len(x) for x in packed])]).astype(np.int64)
    body = np.frombuffer(b"".join(packed), np.uint8)
    codes = range_hash(prefix_sums(body), at[:-1], at[1:])
    order = np.argsort(codes)
    asked = codes[order]
    number = {names[j]: i for i, j in enumerate(order)}

    corpus = tmp.saved(counted(rows, asked), "counted")
    n = corpus.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    holding = {r.term: r.df for r in corpus.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # of asked terms
    items: dict = {}
    for r in asked_rows:
        if (code := number[r.term]) in holding:
            items.setdefault(r.item, []).append((code, r.times * weight(n.documents, holding[code])))
    queries = [(item, np.asarray([c for c, _ in x], np.int64), np.asarray([w for _, w in x], np.int64)) for item, x in items.items()]

    def search(batches):
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        for shard in shards(batches, n.documents, n.tokens):
            for i, (_, terms, weights) in enumerate(queries):
                ids, scores = best[i]
                places, new, _ = shard.search(terms, weights, k, int(scores[-1]) if len(scores) == k else 1)
                if len(places):
                    ids, scores = np.concatenate([ids, shard.ids[places]]), np.concatenate([scores, new])
                    order = np.lexsort((ids, -scores))[:k]
                    best[i] = ids[order], scores[order]
        for (item, _, _), (ids, scores) in zip(queries, best, strict=True):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), pa.array(ids), pa.array(scores)], ["item", "id", "score"])

    return corpus.filter("id is not null").mapInArrow(search, "item long, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", asked: str = "text") -> DataFrame:
    """item, rank, key and score: for each item the k documents with the highest scores above 0, ties to the smaller key.

    Terms are runs of ASCII letters and digits and of other characters, A-Z in lower case, of whole texts. A term weighs
    w = floor(1000 ln((2N+2) / (2 df+1))), and adds w x ((10^9 tf) div (1000 tf + 8 m)) for each time that the item has it,
    with m = 25 + (75 n N) div L, where N documents have terms, L is their terms, n the document's, df the documents with
    the term and tf its times there. Terms of documents are told by 64-bit hashes.

    Null and empty texts have no terms; documents without terms count for nothing. Documents without a key count in the
    statistics and are no results; those that share a key are results each. Items without a key have none; rows that repeat
    an item's key are one item with the terms of all. Empty tables give no rows; other columns are not read. All
    documents are read once for every PASS_TERMS terms of items; the best of a task's items are what it returns.
    """
    small_batches(docs.sparkSession)
    tmp = Scratch()
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    words = items.filter(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item"), F.explode(F.regexp_extract_all(lowered(F.col(asked)), F.lit(TERM), F.lit(0))).alias("term"))
    words = tmp.saved(words.groupBy("item", "term").agg(F.count("*").alias("times")), "items")
    passes = max(1, -(-words.count() // PASS_TERMS))
    found = None
    for i in range(passes):
        part = _pass(rows, words.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == i), k, tmp)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def sql(k: int = 10, documents: str = "documents", items: str = "benchmark") -> str:
    """The same over `documents` (doc_id, text) and `items` (item_id, text), whose keys are distinct, in DuckDB's SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = f"unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '{TERM}'))"
    return f"""
WITH q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {terms} AS term FROM {items}) GROUP BY ALL),
t AS MATERIALIZED (SELECT doc_id, {terms} AS term FROM {documents}),
d AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM d),
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
r AS (SELECT item_id, p.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // tokens)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d ON d.doc_id = p.doc_id, s GROUP BY item_id, p.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= {k}"""
