"""The pattern operator against a look at every start, in batch and as a stream; bounces as a pattern."""

import random

import pytest
from pyspark.sql import functions as F
from test_streaming import collected, drop

from brookmart.operators import visits
from brookmart.operators.pattern import Automaton, Step, match, match_stream
from brookmart.sources import topics

COLUMNS = "mid string, kind string, n long, ts long"


def log(n=300, seed=2, keys=3):
    rnd = random.Random(seed)
    return [(f"m{rnd.randrange(keys)}", rnd.choice("abcx"), i, 1000 * i + rnd.randrange(900)) for i in range(n)]


def brute(rows, kinds, strict, within):
    """Each start for itself."""
    out = []
    for key in sorted({r[0] for r in rows if r[0] is not None}):
        own = sorted((r for r in rows if r[0] == key and r[3] is not None), key=lambda r: r[3])
        for i, r in enumerate(own):
            if r[1] != kinds[0]:
                continue
            found, at, end = [r], i, None
            for k, s in zip(kinds[1:], strict[1:], strict=True):
                later = own[at + 1 :]
                hit = next((j for j, x in enumerate(later) if x[1] == k), None) if not s else (0 if later and later[0][1] == k else None)
                first = hit if hit is not None else (0 if s and later else None)
                if first is None or later[first][3] - r[3] >= within:
                    end = False
                elif hit is None:
                    end = "dies"
                if end is not None:
                    break
                at += hit + 1
                found.append(own[at])
            if end != "dies":
                out.append((key, end is None, tuple(x[2] for x in found)))
    return sorted(out)


def got(df):
    return sorted((r.mid, r.matched, tuple(x.n for x in r.rows)) for r in df.collect())


CASES = [("ab", (True, True), 3000), ("ab", (True, False), 8000), ("abc", (True, False, True), 20_000), ("aba", (True, True, False), 6000), ("a", (True,), 10), ("aa", (True, False), 5000)]


@pytest.mark.parametrize(("kinds", "strict", "within"), CASES)
def test_matches_equal_brute_force(spark, kinds, strict, within):
    rows = [*log(), (None, "a", 900, 5), (None, "b", 901, 6), ("m0", "a", 902, None), ("only", "a", 903, 7)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("et", F.timestamp_millis("ts"))
    steps = [Step(F.col("kind") == k, s) for k, s in zip(kinds, strict, strict=True)]
    found = match(df, "mid", "et", ["ts", "n"], steps, within, ["n", "kind"])
    assert got(found) == brute(rows, kinds, strict, within)
    assert match(df.limit(0), "mid", "et", ["ts"], steps, within, ["n"]).count() == 0


@pytest.mark.parametrize(("kinds", "strict", "within"), CASES[1:3])
def test_matches_of_a_stream_equal_those_of_a_batch(spark, tmp_path, kinds, strict, within):
    rows = log(150)
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    drop(tmp_path / "t", [dict(zip(names, r, strict=True)) for r in [*rows, ("end", "x", 999, 10_000_000)]], 5)
    raw = topics.read_topic(spark, "t", str(tmp_path), stream=True, per_trigger=1).select(F.from_json("value", COLUMNS).alias("r")).select("r.*")
    steps = [Step(F.col("kind") == k, s) for k, s in zip(kinds, strict, strict=True)]
    out = match_stream(raw.withColumn("et", F.timestamp_millis("ts")), "mid", "et", ["ts", "n"], steps, within, ["n", "kind"])
    assert got(collected(spark, out, tmp_path, f"pattern_{kinds}")) == brute(rows, kinds, strict, within)


def test_bounces_are_a_pattern(spark):
    """An entry page, and right after it another one or nothing in time."""
    rnd = random.Random(3)
    rows = [(f"m{rnd.randrange(4)}", rnd.choice(["", "home", None]), i, 2500 * i + rnd.randrange(2000)) for i in range(400)]
    df = spark.createDataFrame(rows, "mid string, last string, n long, ts long").withColumn("et", F.timestamp_millis("ts"))
    entry = F.coalesce(F.length("last"), F.lit(0)) == 0
    found = match(df, "mid", "et", ["ts"], [Step(entry), Step(entry)], 10_000, ["n"])
    want = visits.bounces(df, "mid", entry, "et", ["ts"], "10 seconds")
    assert sorted(r.rows[0].n for r in found.collect()) == sorted(r.n for r in want.collect())


def test_an_automaton_holds_open_matches_only():
    machine = Automaton((True, False), 10)
    ends = [e for t in range(1000) for e in machine.feed(t, (True, False), t)]
    assert len(machine.open) == 10 and ends[0] == (False, [0]) and len(ends) == 990
