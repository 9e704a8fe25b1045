"""The dimension store: the newest change wins, lookups read few files, versions are whole."""

import pytest
from pyspark.sql import functions as F

from brookmart.operators import joins
from brookmart.sources.dims import DimStore, empty_dim


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def changes(spark, *rows):
    return spark.createDataFrame(rows, "id string, v string, seq int")


def test_upserts_and_versions(spark, tmp_path):
    store = DimStore(spark, str(tmp_path), 3)
    assert store.read("d") is None and store.near("d", changes(spark, ("1", "", 0)).select("id")) is None
    store.upsert("d", changes(spark, ("1", "a", 1), ("1", "b", 2), ("2", "c", 1), (None, "n", 9)), ["id"], ["seq"], 0)
    for _ in range(2):  # a batch that is run again
        store.upsert("d", changes(spark, ("2", None, 9), ("3", "e", 9)), ["id"], ["seq"], 1)
    assert values(store.read("d"), "id", "v") == [("1", "b"), ("2", None), ("3", "e")]
    assert values(store.read("d", 0), "id", "v") == [("1", "b"), ("2", "c")]
    store.COMPACT = 3
    for n in range(2, 10):  # columns may come later; old versions go
        store.upsert("d", spark.createDataFrame([("1", f"x{n}", "w", n)], "id string, v string, w string, seq int"), ["id"], ["seq"], n)
        assert values(store.read("d"), "id", "v", "w") == [("1", f"x{n}", "w"), ("2", None, None), ("3", "e", None)]
    assert store.versions("d") == [6, 7, 8, 9]
    assert sum(s.bucket >= 0 for s in store.manifest("d")[2]) <= 3 * 3
    with pytest.raises(ValueError, match="comes after"):
        store.upsert("d", changes(spark, ("1", "a", 1)), ["id"], ["seq"], 3)
    assert store.schema("d")["id"].metadata["pk"] and "seq" not in store.schema("d").names


def test_an_older_change_in_a_later_batch_does_not_win(spark, tmp_path):
    """By the place at the source, whether the versions are merged or not; equal places go by the batch."""
    store = DimStore(spark, str(tmp_path), 2)
    store.upsert("d", changes(spark, ("1", "newer", 200), ("2", "same", 5)), ["id"], ["seq"], 0)
    store.upsert("d", changes(spark, ("1", "older", 100), ("2", "later", 5), ("3", "only", None)), ["id"], ["seq"], 1)
    want = [("1", "newer"), ("2", "later"), ("3", "only")]
    assert values(store.read("d"), "id", "v") == want
    store.COMPACT = 1
    store.upsert("d", changes(spark, ("1", "oldest", 50), ("3", "timed", 1)), ["id"], ["seq"], 2)
    store.upsert("d", changes(spark, ("1", "old", 150)), ["id"], ["seq"], 3)
    assert values(store.read("d"), "id", "v") == [*want[:2], ("3", "timed")]


def test_a_lookup_of_ten_keys_reads_few_files(spark, tmp_path):
    store = DimStore(spark, str(tmp_path), 64)
    whole = spark.range(5000).select(F.col("id").cast("string"), F.concat(F.lit("v"), "id").alias("v"), F.lit(1).alias("seq"))
    store.upsert("d", whole, ["id"], ["seq"], 0)
    store.upsert("d", whole.filter("id % 50 = 0").withColumn("v", F.lit("new")).withColumn("seq", F.lit(2)), ["id"], ["seq"], 1)
    keys = spark.createDataFrame([(i,) for i in [*range(100, 110), 9999]] + [(None,)], "k long")
    near = store.near("d", keys)
    assert values(near, "id", "v") == [(str(i), "new" if i == 100 else f"v{i}") for i in range(100, 110)]
    assert len(near.inputFiles()) <= 22 < 100 < len(store.read("d").inputFiles())
    assert "PushedFilters: [In(_key" in near._jdf.queryExecution().toString()
    got = joins.lookup(keys, store.dim("d"), "k", "id", {"v": "name", "none": "gone"})
    assert values(got, "k", "name", "gone") == sorted([*((i, "new" if i == 100 else f"v{i}", None) for i in range(100, 110)), (9999, None, None), (None, None, None)], key=repr)
    store.POINTS = 5  # more keys than that: ranges of the buckets
    again = store.near("d", keys)
    assert values(joins.lookup(keys, store.dim("d"), "k", "id", {"v": "name"}), "k", "name") == values(got, "k", "name")
    assert len(again.inputFiles()) <= 22
    assert values(joins.lookup(keys, store.dim("missing"), "k", "id", {"v": "name"}).filter("name is not null"), "k") == []


def test_a_table_that_grows_gets_more_buckets(spark, tmp_path):
    store = DimStore(spark, str(tmp_path), 2)
    store.ROWS = 50
    for n in range(3):
        rows = spark.range(n * 100, n * 100 + 100).select(F.col("id").cast("string"), F.lit("v").alias("v"), F.lit(n).alias("seq"))
        store.upsert("d", rows, ["id"], ["seq"], n)
    _, buckets, segments = store.manifest("d")
    assert buckets > 2 and max(s.bucket for s in segments) > 1
    assert store.read("d").count() == 300 and store.near("d", spark.createDataFrame([("250",)], "k string")).first().id == "250"


def test_a_write_that_dies_leaves_the_last_version(spark, tmp_path):
    store = DimStore(spark, str(tmp_path), 2)
    store.upsert("d", changes(spark, ("1", "a", 1)), ["id"], ["seq"], 0)
    commit, store._commit = store._commit, lambda *a: (_ for _ in ()).throw(RuntimeError("dies"))
    with pytest.raises(RuntimeError):
        store.upsert("d", changes(spark, ("1", "b", 2)), ["id"], ["seq"], 1)
    assert values(store.read("d"), "id", "v") == [("1", "a")]
    store._commit = commit
    store.upsert("d", changes(spark, ("1", "b", 2)), ["id"], ["seq"], 1)
    assert values(store.read("d"), "id", "v") == [("1", "b")]


def test_keys_of_several_columns_and_created_tables(spark, tmp_path):
    store = DimStore(spark, str(tmp_path), 2)
    assert store.create("e", "id,name", None, "x=1") and not store.create("e", "id")
    assert store.read("e").count() == 0 and store.read("e").columns == ["id", "name"] and store.schema("e")["id"].metadata == {"extend": "x=1", "pk": True}
    store.upsert("e", spark.createDataFrame([("1", "n", 1)], "id string, name string, seq int"), ["id"], ["seq"])
    assert values(store.read("e"), "id", "name") == [("1", "n")]
    pairs = spark.createDataFrame([("a", 1, "x", 1), ("a", 2, "y", 1), ("a", 1, "z", 2), ("a", None, "q", 2)], "p string, q int, v string, seq int")
    store.upsert("p", pairs, ["p", "q"], ["seq"])
    assert values(store.read("p"), "p", "q", "v") == [("a", 1, "z"), ("a", 2, "y")]
    assert not empty_dim(spark, "id,name").schema["id"].nullable
