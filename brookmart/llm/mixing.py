"""Mixing sources to target weights by hierarchical budgets, with DataFrame functions.

Weights stand on a tree of domains, languages and sources. A budget of tokens is passed down level by level: siblings
share their parent's budget by weight, no child gets more than it has (its tokens times the epochs allowed), and what a
child cannot use goes to its siblings first. A parent's own bound is the sum of its children's, so only what all siblings
together cannot use goes to the parent's siblings. Each leaf then gives a token-prefix of seeded epochs: whole epochs
first, then the documents of one more epoch in a seeded order until the budget is met.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import fresh, saved

#: Characters of the hash that orders an epoch.
DIGITS = 13


def fill(level: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds `budget` to children with columns parent..., child, weight, bound and parent_budget: by weight, within bounds.

    Children are sorted by bound / weight. The first m of them are filled to their bounds where the rest's share per
    weight, (parent_budget - their bounds) / (the rest's weight), still reaches the m-th's bound / weight.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("bound") / F.col("weight"), child)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*parent)
    rated = (
        level.withColumn("full", F.coalesce(F.sum("bound").over(upto), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
        .withColumn("per", (F.col("parent_budget") - F.col("full")) / F.col("rest"))
        .withColumn("filled", F.col("per") >= F.col("bound") / F.col("weight"))
    )
    # Filled children come first in this order; the first that is not sets the share of all after it.
    share = F.min(F.when(~F.col("filled"), F.struct(F.col("bound") / F.col("weight"), child, "per"))).over(every)
    got = F.when(F.col("filled"), F.col("bound")).otherwise(F.floor(share["per"] * F.col("weight")))
    return rated.withColumn("budget", F.least(got, F.col("bound")).cast("long")).drop("full", "rest", "per", "filled", "parent_budget")


def weights_of(level: DataFrame, child: str, weights: Mapping[str, int] | None) -> DataFrame:
    """A column weight: the mapping's, or 1; all positive integers, so that sums are exact."""
    out: Column = F.lit(1)
    for name, w in (weights or {}).items():
        if w <= 0:
            raise ValueError("weights must be positive")
        out = F.when(F.col(child) == name, F.lit(int(w))).otherwise(out)
    return level.withColumn("weight", out.cast("long"))


def mix(
    docs: DataFrame,
    domain: Column,
    budget_share: float = 0.5,
    epochs: int = 2,
    weights: Mapping[str, Mapping[str, int]] | None = None,
    tokens: Column | None = None,
    key: str = "doc_id",
    language: str = "lang",
    source: str = "source",
    text: str = "text",
    seed: int = 1,
    bins: int | None = None,
) -> DataFrame:
    """docs, all columns, with epoch, mix_tokens, and once more for every epoch that takes them.

    domain: each row's domain; weights: 'domain', 'language' and 'source' -> name -> positive integer (1 by default, one
    mapping for all parents); budget_share: the budget as a share of all tokens; epochs: the most that a leaf is read;
    tokens: a row's tokens (by default a quarter of its UTF-8 bytes, rounded up, 1 at least). Null domains, languages and
    sources are a name of their own, ''. A document is taken in the epoch that reads its leaf's budget when the tokens
    before it are below what is left, so a leaf is over its budget by less than a document. bins: parts that a leaf's
    seeded order is cut into (by default one for each 50,000 rows, 64 at least). Repeated rows are rows of
    their own; null keys are ordered by text; an empty table gives no rows. New columns are prefixed by _ if they clash.
    """
    weights = weights or {}
    own = docs.columns
    epoch, mix_tokens = fresh(own, "epoch", "mix_tokens")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = tokens if tokens is not None else F.greatest(F.ceil(F.octet_length(body) / 4), F.lit(1))
    name = F.coalesce(F.col(key).cast("string"), body)
    rows = docs.select(F.struct(*(F.col(f"`{x}`") for x in own)).alias("row"), *(F.coalesce(x.cast("string"), F.lit("")).alias(n) for x, n in ((domain, "d"), (F.col(language), "l"), (F.col(source), "s"))), size.cast("long").alias("t"), name.alias("name"))
    leaf = ["d", "l", "s"]

    leaves = saved(rows.groupBy(*leaf).agg(F.sum("t").alias("tokens"), F.count("*").alias("rows")), "leaves")
    level = leaves.groupBy("d").agg((F.sum("tokens") * epochs).alias("bound"), F.sum("tokens").alias("own")).withColumn("root", F.lit(0))
    level = weights_of(level, "d", weights.get("domain")).withColumn("parent_budget", F.floor(F.sum("own").over(Window.partitionBy("root")) * F.lit(float(budget_share))))  # a row a domain
    top = fill(level, ["root"], "d").select("d", F.col("budget").alias("parent_budget"))
    level = leaves.groupBy("d", "l").agg((F.sum("tokens") * epochs).alias("bound")).join(top, "d")
    mid = fill(weights_of(level, "l", weights.get("language")), ["d"], "l").select("d", "l", F.col("budget").alias("parent_budget"))
    level = leaves.withColumn("bound", F.col("tokens") * epochs).join(mid, ["d", "l"])
    budgets = fill(weights_of(level, "s", weights.get("source")), ["d", "l"], "s").select(*leaf, F.floor(F.col("budget") / F.col("tokens")).cast("long").alias("whole"), (F.col("budget") % F.col("tokens")).alias("left"), "rows")
    budgets = saved(budgets.filter("whole > 0 or left > 0"), "budgets")
    n, count = budgets.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    bins = bins or min(65_536, max(64, count // 50_000))
    side = budgets.drop("rows")
    side = F.broadcast(side) if n <= 100_000 else side

    # The last epoch's order is that of a hash; a leaf's tokens are summed bin by bin, and row by row only in the bin where
    # its budget ends.
    word = F.md5(F.concat(F.lit(f"{seed}:"), F.col("whole").cast("string"), F.lit(":"), "name"))
    placed = rows.join(side, leaf).withColumn("h", F.conv(F.substring(word, 1, DIGITS), 16, 10).cast("long"))
    placed = placed.withColumn("bin", F.floor(F.col("h") / -(-(16**DIGITS) // bins)))
    sums = placed.groupBy(*leaf, "bin").agg(F.first("left").alias("left"), F.sum("t").alias("sum"))
    before = Window.partitionBy(*leaf).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    met = saved(sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))).filter("before < left"), "bins")
    met = met.select(*leaf, "bin", "before", (F.col("before") + F.col("sum") <= F.col("left")).alias("all"))
    met = F.broadcast(met) if n * bins <= 200_000 else met
    last = placed.join(met, [*leaf, "bin"])
    within = Window.partitionBy(*leaf, "bin").orderBy("h", "name", F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1)
    part = last.filter("not all").withColumn("run", F.coalesce(F.sum("t").over(within), F.lit(0)) + F.col("before")).filter("run < left")
    out = ["row.*", F.col("whole").alias(epoch), F.col("t").alias(mix_tokens)]
    whole = placed.filter("whole > 0").withColumn("e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    return whole.select("row.*", F.col("e").alias(epoch), F.col("t").alias(mix_tokens)).unionByName(last.filter("all").select(*out)).unionByName(part.select(*out))


def sql(domain: str, budget_share: float, epochs: int, weights: Mapping[str, Mapping[str, int]], seed: int = 1, documents: str = "documents") -> str:
    """The same over `documents` in DuckDB's SQL: doc_id, epoch and mix_tokens."""

    def case(column: str, of: str) -> str:
        given = "".join(f" WHEN {column} = '{name}' THEN {int(w)}" for name, w in weights.get(of, {}).items())
        return f"CAST(CASE{given} ELSE 1 END AS BIGINT)" if given else "CAST(1 AS BIGINT)"

    def filled(name: str, source: str, parent: str, child: str, keep: str) -> str:
        w = f"PARTITION BY {parent} ORDER BY bound / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        return f"""
{name}_rated AS (SELECT *, (parent_budget - coalesce(CAST(sum(bound) OVER ({w}) AS BIGINT), 0)) / (CAST(sum(weight) OVER (PARTITION BY {parent}) AS BIGINT) - coalesce(CAST(sum(weight) OVER ({w}) AS BIGINT), 0)) AS per FROM ({source})),
{name}_share AS (SELECT *, arg_min(CASE WHEN per < bound / weight THEN per END, CASE WHEN per < bound / weight THEN ROW(bound / weight, {child}) END) OVER (PARTITION BY {parent}) AS share FROM {name}_rated),
{name} AS (SELECT {keep}, least(CASE WHEN per >= bound / weight THEN bound ELSE CAST(floor(share * weight) AS BIGINT) END, bound) AS budget FROM {name}_share)"""

    return f"""
WITH r AS (SELECT doc_id, coalesce({domain}, '') AS d, coalesce(lang, '') AS l, coalesce(source, '') AS s, CAST(greatest(ceil(octet_length(encode(coalesce(text, ''))) / 4), 1) AS BIGINT) AS t, coalesce(CAST(doc_id AS VARCHAR), text, '') AS name FROM {documents}),
leaves AS (SELECT d, l, s, CAST(sum(t) AS BIGINT) AS tokens FROM r GROUP BY d, l, s),{filled("top", f"SELECT d, 0 AS root, CAST(sum(tokens) * {epochs} AS BIGINT) AS bound, {case('d', 'domain')} AS weight, CAST(floor(sum(sum(tokens)) OVER () * {float(budget_share)}) AS BIGINT) AS parent_budget FROM leaves GROUP BY d", "root", "d", "d")},{filled("mid", f"SELECT d, l, CAST(sum(tokens) * {epochs} AS BIGINT) AS bound, {case('l', 'language')} AS weight, any_value(budget) AS parent_budget FROM leaves JOIN top USING (d) GROUP BY d, l", "d", "l", "d, l")},{filled("low", f"SELECT d, l, s, tokens, tokens * {epochs} AS bound, {case('s', 'source')} AS weight, budget AS parent_budget FROM leaves JOIN mid USING (d, l)", "d, l", "s", "d, l, s, tokens")},
b AS (SELECT d, l, s, budget // tokens AS whole, budget % tokens AS rest FROM low),
p AS (SELECT r.*, whole, rest, CAST('0x' || substr(md5('{seed}:' || whole || ':' || name), 1, {DIGITS}) AS BIGINT) AS h FROM r JOIN b USING (d, l, s)),
x AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY d, l, s ORDER BY h, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM p)
SELECT doc_id, whole AS epoch, t AS mix_tokens FROM x WHERE run < rest
UNION ALL SELECT doc_id, e AS epoch, t AS mix_tokens FROM (SELECT doc_id, t, unnest(range(whole)) AS e FROM p)"""
