"""Topic logs: offsets, commits that run again, writers that die, and reading on."""

import json

import pytest
from pyspark.sql import functions as F

from brookmart.sources import log


def rows(spark, values, parts=1):
    return spark.createDataFrame([(v,) for v in values], "value string").coalesce(parts)


def taken(df):
    return [(r.offset, r.value) for r in df.orderBy("offset").collect()]


def run(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_arrival_order_is_exact(spark, tmp_path):
    """Three commits in no time, whose order their files' times would not tell; a record may be null or have line feeds."""
    path = str(tmp_path)
    assert log.read_log(spark, path, "t").count() == 0
    for part in (["c", "b"], ["a", None, "x\ny"], ["", "b"]):
        log.append_log(rows(spark, part), path, "t")
    want = list(enumerate(["c", "b", "a", None, "x\ny", "", "b"]))
    got = log.read_log(spark, path, "t")
    assert taken(got) == want
    times = [r.time for r in got.orderBy("offset").collect()]
    assert times == sorted(times)
    assert taken(log.read_log(spark, path, "t", start=3)) == want[3:] and log.read_log(spark, path, "t", start="latest").count() == 0


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path)
    for _ in range(2):
        log.append_log(rows(spark, ["a", "b"]), path, "t", "job", 0)
    log.append_log(rows(spark, ["c"]), path, "t", "job", 1)
    log.append_log(rows(spark, ["d"]), path, "t", "other-job", 0)
    assert taken(log.read_log(spark, path, "t")) == list(enumerate("abcd"))


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path):
    """Files of a commit that did not come to its index: readers do not see them, and the batch is written once."""
    path = str(tmp_path)
    log.append_log(rows(spark, ["a"]), path, "t", "job", 0)
    bad = rows(spark, [str(i) for i in range(8)]).repartition(4).withColumn("value", F.when(F.col("value") == "5", F.raise_error(F.lit("dies"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="dies"):
        log.append_log(bad, path, "t", "job", 1)
    (tmp_path / "t" / "part-left.parquet").write_bytes(b"half")
    (tmp_path / "t" / "_index" / ".left").write_bytes(b"{")
    assert taken(log.read_log(spark, path, "t")) == [(0, "a")]
    log.append_log(rows(spark, ["b"]), path, "t", "job", 1)
    assert taken(log.read_log(spark, path, "t")) == [(0, "a"), (1, "b")]


def test_records_go_to_their_topics(spark, tmp_path):
    path = str(tmp_path)
    both = spark.createDataFrame([("x", "1"), ("y", "2"), ("x", "3")], "topic string, value string").coalesce(1)
    log.append_log(both, path, None, "job", 0)
    assert taken(log.read_log(spark, path, "x")) == [(0, "1"), (1, "3")] and taken(log.read_log(spark, path, "y")) == [(0, "2")]
    with pytest.raises(Exception, match="no topic"):
        log.append_log(spark.createDataFrame([(None, "1")], "topic string, value string"), path)


def test_a_stream_reads_on_from_its_checkpoint(spark, tmp_path):
    path = str(tmp_path / "logs")
    log.append_log(rows(spark, ["a", "b"]), path, "t")
    source = lambda **o: log.read_log(spark, path, "t", stream=True, **o)
    assert taken(run(spark, source(), tmp_path, "log_all")) == [(0, "a"), (1, "b")]
    log.append_log(rows(spark, ["c"]), path, "t")
    q = source().writeStream.format("memory").queryName("log_on").option("checkpointLocation", str(tmp_path / "on")).trigger(availableNow=True)
    q.start().awaitTermination()
    first = taken(spark.table("log_on"))
    log.append_log(rows(spark, ["d"]), path, "t")
    got = []
    q = source().writeStream.foreachBatch(lambda b, n: got.extend(taken(b))).option("checkpointLocation", str(tmp_path / "each")).trigger(availableNow=True)
    q.start().awaitTermination()
    log.append_log(rows(spark, ["e", "f"]), path, "t")
    q.start().awaitTermination()
    assert first == list(enumerate("abc")) and got == list(enumerate("abcdef"))
    assert taken(run(spark, source(start=4), tmp_path, "log_late")) == [(4, "e"), (5, "f")]
    assert run(spark, log.read_log(spark, path, "none", stream=True), tmp_path, "log_none").count() == 0


def test_a_stream_writes_a_log_exactly_once(spark, tmp_path):
    path = str(tmp_path / "logs")
    log.append_log(rows(spark, ["a", "b"]), path, "in")

    def copy():
        source = log.read_log(spark, path, "in", stream=True).select("value")
        source.writeStream.format(log.NAME).options(path=path, topic="out", writer="copy").option("checkpointLocation", str(tmp_path / "copy")).trigger(availableNow=True).start().awaitTermination()

    copy()
    commits = tmp_path / "copy" / "commits"
    for f in [*commits.glob("[0-9]*"), *commits.glob(".[0-9]*")]:
        f.unlink()  # as if it had ended before it noted the batch
    log.append_log(rows(spark, ["c"]), path, "in")
    copy()  # the batch that is not noted, again
    copy()
    assert taken(log.read_log(spark, path, "out")) == list(enumerate("abc"))
    names = sorted(p.name for p in (tmp_path / "logs" / "out" / "_index").glob("*.json"))
    assert [n.split("-", 2)[2] for n in names] == ["copy-0.json", "copy-1.json"] and json.loads((tmp_path / "logs" / "out" / "_index" / names[0]).read_text())["files"]
