"""Keyed state for streams: the three visitor operators as stateful processors.

A micro-batch has no order within a key, so every processor sorts its rows; bounces also keep rows back until the
watermark has passed them, since a late row may come between two others.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def ascending(rows, columns: tuple[str, ...]) -> list:
    """Rows in the order of some columns; nulls come first, as in the closed forms."""
    return sorted(rows, key=lambda r: tuple((r[c] is not None, r[c]) if r[c] is not None else (False,) for c in columns))


class _RepairIsNew(StatefulProcessor):
    """Counts the rows that claim is_new = '1' and lets the first two keep it."""

    def __init__(self, flag: str, order: tuple[str, ...], keep: int):
        self.flag, self.order, self.keep = flag, order, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        for r in ascending(rows, self.order):
            out = r.asDict()
            if out[self.flag] == "1":
                n += 1
                if n > self.keep:
                    out[self.flag] = "0"
            yield Row(**out)
        self.seen.update((n,))

    def close(self) -> None:
        pass


class _UniqueVisits(StatefulProcessor):
    """Lets an entry page through if its day differs from the one kept, which a day without rows forgets."""

    def __init__(self, day: str, order: tuple[str, ...], ttl_ms: int | None):
        self.day, self.order, self.ttl = day, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "day string", self.ttl) if self.ttl else handle.getValueState("last", "day string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        before = last
        for r in ascending(rows, self.order):
            if r[self.day] != last:
                last = r[self.day]
                yield Row(**r.asDict())
        if last is not None and (last != before):
            self.last.update((last,))

    def close(self) -> None:
        pass


class _Bounces(StatefulProcessor):
    """Keeps rows until the watermark has passed them; then an entry page is a bounce if an entry or a page `within` later
    follows it, or if the watermark is `within` past it and none has come."""

    def __init__(self, names: tuple[str, ...], entry: str, millis: str, order: tuple[str, ...], within_ms: int):
        self.names, self.entry, self.millis, self.order, self.within = names, entry, millis, order, within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)

    def key_of(self, r) -> tuple:
        return tuple((r[i] is not None, r[i]) if r[i] is not None else (False,) for i in map(self.names.index, self.order))

    def settle(self, held: list[tuple], until: int) -> tuple[list[tuple], list[tuple]]:
        """(bounces, rows to keep): decides every row whose follower, or the lack of one, is settled."""
        at, e = self.names.index(self.millis), self.names.index(self.entry)
        held = sorted(held, key=self.key_of)
        out, keep = [], []
        for i, r in enumerate(held):
            after = held[i + 1] if i + 1 < len(held) else None
            if after is not None and after[at] <= until:
                if r[e] and (after[e] or after[at] - r[at] >= self.within):
                    out.append(r)
            elif r[at] + self.within <= until:
                if r[e]:
                    out.append(r)
            else:
                keep.append(r)
        return out, keep

    def run(self, new: list[tuple], until: int) -> Iterator[Row]:
        held = [tuple(x) for x in self.rows.get()] if self.rows.exists() else []
        out, keep = self.settle(held + new, until)
        if keep:
            self.rows.put(keep)
            at = self.names.index(self.millis)
            # The first time only, which asks for the next.
            self.handle.registerTimer(min(due for r in keep for due in (r[at], r[at] + self.within) if due > until))
        else:
            self.rows.clear()
        at = self.names.index("_row")
        for r in out:
            yield Row(_row=r[at])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield from self.run([tuple(r[c] for c in self.names) for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.run([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def repair_is_new(rows: DataFrame, visitor: str, flag: str, order: list[str], keep: int = 2) -> DataFrame:
    """The stream of rows with is_new repaired (see operators.visits); state of a visitor is one number. Rows without a
    visitor are to be kept out. A row without a value in the order columns comes first in its batch."""
    return rows.groupBy(visitor).transformWithState(_RepairIsNew(flag, tuple(order), keep), rows.schema, outputMode="append", timeMode="None")


def unique_visits(entries: DataFrame, visitor: str, day: str, order: list[str], ttl_ms: int | None = None) -> DataFrame:
    """The stream of entry pages that begin a day; a visitor's day is forgotten ttl_ms after it was written, if that is
    given. A time to live runs by the clock, so such a query goes on until it is stopped. Rows without a visitor or a day are
    nobody's visits: they are left out."""
    entries = entries.filter(F.col(visitor).isNotNull() & F.col(day).isNotNull())
    mode = "processingTime" if ttl_ms else "None"
    return entries.groupBy(visitor).transformWithState(_UniqueVisits(day, tuple(order), ttl_ms), entries.schema, outputMode="append", timeMode=mode)


def bounces(pages: DataFrame, visitor: str, entry: str, time: str, millis: str, order: list[str], within_ms: int = 10_000, delay: str = "1 second") -> DataFrame:
    """The stream of bounces. pages: a boolean column entry, an event-time column and its milliseconds. A visitor's state
    holds the rows that aren't settled, which the watermark bounds: what they are ordered and judged by, and the row as JSON,
    since a state that is read and put again keeps plain columns only. Rows without a visitor or a time are left out."""
    pages = pages.filter(F.col(visitor).isNotNull() & F.col(time).isNotNull() & F.col(millis).isNotNull())
    out = T.StructType([f for f in pages.schema.fields if f.name != time])
    names = tuple(dict.fromkeys([*order, entry, millis, "_row"]))
    packed = pages.withColumn("_row", F.to_json(F.struct(*(f.name for f in out)))).withWatermark(time, delay)
    packed = packed.select(*dict.fromkeys([visitor, time, *names]))
    processor = _Bounces(names, entry, millis, tuple(order), within_ms)
    processor.schema = T.StructType([packed.schema[n] for n in names])
    made = T.StructType([T.StructField("_row", T.StringType())])
    found = packed.groupBy(visitor).transformWithState(processor, made, outputMode="append", timeMode="eventTime")
    return found.select(F.from_json("_row", out).alias("r")).select("r.*")


def with_day(rows: DataFrame, millis: str = "ts", name: str = "day") -> DataFrame:
    return rows.withColumn(name, F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd"))
