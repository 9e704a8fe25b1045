"""Sequences of conditions over a key's rows in time: matches, and matches that ran out of time.

A pattern is a list of steps. A row that meets the first opens a match; the next step waits for the next row, if it is
strict, or for the first later row that meets it. A match ends well when its last step is met less than `within` after
its first; it runs out of time when that much has passed; and it dies without a word when the next row does not meet a
strict step. Every row that meets the first step opens a match of its own, so at most one is open for each row of the
last `within`.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class Step:
    """A condition on a row; strict: it is to be the row right after the step before."""

    condition: Column
    strict: bool = True


@dataclass
class Automaton:
    """The open matches of a key: the time of the first row, the step that is next, and the rows so far."""

    strict: Sequence[bool]
    within: int
    open: list[tuple[int, int, list]] = field(default_factory=list)

    def expire(self, now: int) -> Iterator[tuple[bool, list]]:
        """Matches whose time is over, in the order of their first rows."""
        late = [m for m in self.open if now - m[0] >= self.within]
        if late:
            self.open = [m for m in self.open if now - m[0] < self.within]
        for _, _, rows in late:
            yield False, rows

    def feed(self, time: int, met: Sequence[bool], row) -> Iterator[tuple[bool, list]]:
        """A row: what it ends, as (whether it matched, rows)."""
        yield from self.expire(time)
        still = []
        for first, step, rows in self.open:
            if not met[step]:
                if not self.strict[step]:
                    still.append((first, step, rows))
            elif step + 1 == len(self.strict):
                yield True, [*rows, row]
            else:
                still.append((first, step + 1, [*rows, row]))
        if met[0]:
            if len(self.strict) == 1:
                yield True, [row]
            else:
                still.append((time, 1, [row]))
        self.open = still


def _prepared(rows: DataFrame, key: str, time: str, steps: Sequence[Step]) -> DataFrame:
    """The rows that have a key and a time, with _key, _ms and _met."""
    met = F.array(*(F.coalesce(s.condition, F.lit(False)) for s in steps))
    known = rows.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    return known.withColumns({"_key": F.col(key), "_ms": F.unix_millis(time), "_met": met})


def match(rows: DataFrame, key: str, time: str, order: Sequence[str], steps: Sequence[Step], within_ms: int, keep: Sequence[str]) -> DataFrame:
    """key, matched and rows (the matched rows' `keep` columns, in order) of every match, and of every one that ran out of time
    (matched is false; its rows are those so far). order: columns along which times ascend, as keys' rows follow one
    another. At the end of the data all time is over. Rows without a key or a time are left out; a condition that is null
    is not met. A key's rows are read in order, and of them only open matches are held.
    """
    prepared = _prepared(rows, key, time, steps).select("_key", "_ms", F.struct(*order).alias("_o"), "_met", F.struct(*keep).alias("_row"))
    strict = [s.strict for s in steps]
    made = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("matched", T.BooleanType()), T.StructField("rows", T.ArrayType(prepared.schema["_row"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, at, schema = Automaton(strict, within_ms), None, None

        def out(key, ends) -> list[dict]:
            return [{name: key, "matched": matched, "rows": found} for matched, found in ends]

        name = made[0].name
        for batch in batches:
            schema = pa.schema([(name, batch.schema.field("_key").type), ("matched", pa.bool_()), ("rows", pa.list_(batch.schema.field("_row").type))])
            done: list[dict] = []
            kept = batch.column("_row")
            for i, (k, ms, met) in enumerate(zip(batch.column("_key").to_pylist(), batch.column("_ms").to_pylist(), batch.column("_met").to_pylist(), strict=True)):
                if k != at:
                    done += out(at, ((False, rows) for _, _, rows in machine.open))
                    machine, at = Automaton(strict, within_ms), k
                if machine.open or met[0]:
                    done += out(k, machine.feed(ms, met, kept[i].as_py()))
            yield pa.RecordBatch.from_pylist(done, schema)
        if machine.open:
            yield pa.RecordBatch.from_pylist(out(at, ((False, rows) for _, _, rows in machine.open)), schema)

    return prepared.repartition("_key").sortWithinPartitions("_key", "_o").drop("_o").mapInArrow(run, made)


def placed(row: tuple) -> tuple:
    """Where a waiting row stands: its time, then the values of its order columns, nulls first."""
    return row[0], [(v is not None, v) if v is not None else (False,) for v in json.loads(row[1]).values()]


class _Pattern(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed them, feeds them in order, and keeps what is open."""

    def __init__(self, strict: Sequence[bool], within: int):
        self.strict, self.within = tuple(strict), within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "rows string")  # written whole; a list's rows are packed one by one
        self.open = handle.getValueState("open", "matches string")

    def run(self, key, new: list[tuple], until: int) -> Iterator[Row]:
        held = sorted([*(tuple(x) for x in json.loads(self.waiting.get()[0])), *new] if self.waiting.exists() else new, key=placed)
        before = self.open.get()[0] if self.open.exists() else None
        machine = Automaton(self.strict, self.within, [tuple(m) for m in json.loads(before)] if before else [])
        ends = []
        for ms, _, met, row in (r for r in held if r[0] <= until):
            ends += machine.feed(ms, [c == "1" for c in met], row)
        ends += machine.expire(until)
        left = [r for r in held if r[0] > until]
        if left:
            self.waiting.update((json.dumps(left),))
        elif len(held) > len(new):
            self.waiting.clear()
        now = json.dumps(machine.open) if machine.open else None
        if now is None and before is not None:
            self.open.clear()
        elif now != before:
            self.open.update((now,))
        due = min(itertools.chain((r[0] for r in left), (m[0] + self.within for m in machine.open)), default=None)
        if due is not None:  # the first only, which asks for the next
            self.handle.registerTimer(due)
        for matched, found in ends:
            yield Row(_key=key[0], matched=matched, rows="[" + ",".join(found) + "]")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield from self.run(key, [(r["_ms"], r["_place"], r["_bits"], r["_json"]) for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.run(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def match_stream(rows: DataFrame, key: str, time: str, order: Sequence[str], steps: Sequence[Step], within_ms: int, keep: Sequence[str], delay: str = "1 second") -> DataFrame:
    """The same of a stream. Rows wait until the watermark has passed them, since one that comes late may stand between two
    others; so a match ends when it does in event time. order: numbers or strings that say which of a key's rows of one
    time is first. State of a key is the rows that the watermark has not passed, and its open matches."""
    known = _prepared(rows.withWatermark(time, delay), key, time, steps)
    bits = F.array_join(F.transform("_met", lambda m: F.when(m, "1").otherwise("0")), "")
    packed = known.select("_key", time, "_ms", F.to_json(F.struct(*order), {"ignoreNullFields": "false"}).alias("_place"), bits.alias("_bits"), F.to_json(F.struct(*keep)).alias("_json"))
    made = T.StructType([T.StructField("_key", known.schema["_key"].dataType), T.StructField("matched", T.BooleanType()), T.StructField("rows", T.StringType())])
    found = packed.groupBy("_key").transformWithState(_Pattern([s.strict for s in steps], within_ms), made, outputMode="append", timeMode="eventTime")
    return found.select(F.col("_key").alias(key), "matched", F.from_json("rows", T.ArrayType(rows.select(F.struct(*keep).alias("r")).schema["r"].dataType)).alias("rows"))
