"""What grows with the tables is shared out: state calls by buckets of keys, a stream's files by its rows."""

import random

from pyspark.sql import functions as F
from test_changes import events

from brookmart import flows
from brookmart.operators import changes, pattern
from brookmart.streaming import state


def test_keys_of_a_handover_share_their_buckets_state(spark, tmp_path):
    rnd = random.Random(4)
    taken = [("t", None, {"id": str(i)}, "read", None, 10) for i in range(0, 60, 2)]
    log = [("t", None, {"id": str(rnd.randrange(60))}, "update", None, rnd.randrange(5, 40)) for _ in range(200)]
    streams = []
    for name, rows in (("snapshot", taken), ("log", log)):
        df = events(spark, *rows)
        df.coalesce(1).write.parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(df.schema).parquet(str(tmp_path / name)))
    q = changes.handover(*streams, ["id"], 10, buckets=3).writeStream.format("memory").queryName("shared_buckets").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.after["id"], r.pos) for r in spark.table("shared_buckets").collect()]
    assert sorted(got) == sorted({(r[2]["id"], r[5]) for r in [*taken, *log] if r[3] == "read" or r[5] > 10})
    for key in {k for k, _ in got}:  # in the order of the log
        assert [p for k, p in got if k == key] == sorted(p for k, p in got if k == key)
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress) <= 3


def test_a_streams_files_grow_with_its_rows_and_batches_do_not(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(flows, "FILE_ROWS", 20)
    rows = spark.range(600).withColumnRenamed("id", "event_id")
    for batches in (1, 3):
        path = str(tmp_path / f"files{batches}")
        monkeypatch.setattr(flows, "folder", lambda spark, name, path=path: path)
        stream = flows.streamed(rows, "growth", batches)
        assert spark.read.parquet(path).select(F.input_file_name()).distinct().count() > 15  # of 30; some may have no rows
        name = f"growth_{batches}"
        q = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).agg(F.count("*"), F.countDistinct("event_id")).first()[:] == (600, 600)
        read = [p for p in q.recentProgress if p.numInputRows]
        assert 1 <= len(read) <= batches


class Value:
    """A value or list of a processor's state, and the handle that gives it."""

    def __init__(self):
        self.held, self.timers = None, []

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, x):
        self.held = x

    put = update

    def clear(self):
        self.held = None

    def getValueState(self, *_):
        return Value()

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)


def test_a_key_waits_for_one_time_however_many_rows_it_has():
    p, handle = pattern._Pattern([True, True], 100), Value()
    p.init(handle)
    rows = [(10 * i, f'{{"n":{i}}}', "11", f'{{"n":{i}}}') for i in range(1, 51)]
    assert list(p.run(("k",), rows, 0)) == [] and handle.timers == [10]
    ends = []
    while handle.timers:  # each time asks for the next
        at = handle.timers.pop()
        assert not handle.timers
        ends += [(r.matched, r.rows) for r in p.run(("k",), [], at)]
    want = [(True, f'[{{"n":{i}}},{{"n":{i + 1}}}]') for i in range(1, 50)]
    assert ends == [*want, (False, '[{"n":50}]')]
    b, handle = state._Bounces(("ts", "e", "_row"), "e", "ts", ("ts",), 100), Value()
    b.schema = None
    b.init(handle)
    assert list(b.run([(10 * i, True, str(i)) for i in range(1, 51)], 0)) == [] and handle.timers == [10]
    ends = []
    while handle.timers:
        at = handle.timers.pop()
        assert not handle.timers
        ends += [r._row for r in b.run([], at)]
    assert ends == [str(i) for i in range(1, 51)]


def test_the_windows_of_the_seller_sums_are_made_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def window(i):
        made.add(1)
        return f"w{i}"

    names, measures = flows.rollups.ROLLUPS["product_stats"]
    keys = [F.concat(F.lit(f"{c} "), F.col("id") % 3).alias(c) for c in names]
    sums = [F.col("id").cast("decimal(16,2)").alias(c) if c == "order_amount" else F.col("id").alias(c) for c in measures]
    full = spark.range(40).select(F.udf(window, "string").asNondeterministic()("id").alias("stt"), *keys, *sums)
    monkeypatch.setattr(flows, "product_full", lambda spark, sf_dir: full)
    got = {r.name: r.value for r in flows.dash_seller_sums(spark, "").collect()}
    assert got == {f"tm_name {k}": float(sum(range(k, 40, 3))) for k in range(3)}
    assert made.value == 40
