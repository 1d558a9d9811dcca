"""Keyed rules in strict event-time order: processors for ``transformWithState``.

Rows wait in a list by key until the watermark has passed them, are then taken in order, and leave the list. A row that
comes after its key was advanced beyond its time is late: it is handed on as such and changes nothing. What a rule
remembers stays as long as the key; what waits is bounded by the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, FractionalType, IntegralType, LongType, MapType, StringType, StructField, StructType, TimestampType

from ..operators.contradiction import Rule, Survivors

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
#: Waiting rows that are handed to the state store at once.
CHUNK = 1000


def as_text(name: str, kind: DataType) -> tuple[Column, Column, Callable[[str], Any]]:
    """A column as text, the column back from that text, and how Python reads the text. Exact both ways."""
    c = F.col(f"`{name}`")
    if isinstance(kind, TimestampType):
        return F.unix_micros(c).cast("string"), F.timestamp_micros(c.cast("long")), int
    if isinstance(kind, BinaryType):
        return F.base64(c), F.unbase64(c), str
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.to_json(c, _JSON), F.from_json(c, kind.json(), _JSON), str
    return c.cast("string"), c.cast(kind), int if isinstance(kind, IntegralType) else float if isinstance(kind, FractionalType) else str


class Fold:
    """A rule whose memory is one row of a few values."""

    def __init__(self, schema: StructType, first: tuple, step: Callable[[tuple, dict], tuple[tuple, tuple]]):
        self.schema, self.first, self.step = schema, first, step

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("state", self.schema)

    def begin(self) -> None:
        self.now = tuple(self.held.get()) if self.held.exists() else self.first

    def take(self, row: dict) -> tuple:
        self.now, out = self.step(self.now, row)
        return out

    def end(self) -> None:
        self.held.update(self.now)


class _Held:
    """The places of survivors as a dictionary over a map in the state store: only what is asked is read, only what is new is written."""

    def __init__(self, places, count):
        self.places, self.count, self.known, self.n = places, count, {}, count.get()[0] if count.exists() else 0

    @staticmethod
    def _key(key: tuple) -> tuple:
        return tuple("*" if x is None else f"={x}" for x in key)

    def __len__(self) -> int:
        return self.n

    def __contains__(self, key: tuple) -> bool:
        if key not in self.known and self.places.containsKey(self._key(key)):
            self.known[key] = tuple(self.places.getValue(self._key(key)))
        return key in self.known

    def __getitem__(self, key: tuple) -> tuple:
        return self.known[key]

    def setdefault(self, key: tuple, value: tuple) -> None:
        if key not in self:
            self.known[key], self.n = value, self.n + 1
            self.places.updateValue(self._key(key), value)


class Quarantine:
    """The rule of one proposal after another; its memory is a map from scope and term to the first survivor."""

    def __init__(self, rules: tuple[Rule, ...], id_kind: DataType):
        self.rules = rules
        self.key = StructType([StructField(c, StringType()) for c in ("d", "s", "term")])
        self.value = StructType([StructField("place", LongType()), StructField("id", id_kind)])
        self.number = StructType([StructField("n", LongType())])

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.places, self.count = handle.getMapState("first", self.key, self.value), handle.getValueState("count", self.number)

    def begin(self) -> None:
        self.held = _Held(self.places, self.count)
        self.survivors = Survivors(self.rules, self.held)

    def take(self, row: dict) -> tuple:
        id_, why = self.survivors.take(row["id"], row["title"], row["scope_domain"], row["scope_system"])
        return (row["status"] if why is None else "quarantined", id_)

    def end(self) -> None:
        self.count.update((len(self.held),))


class InOrder(StatefulProcessor):
    """Takes a key's rows by ``order`` as the watermark passes them. One timer a key: the time of its earliest waiting row."""

    def __init__(self, rule, own: list[str], readers: dict[str, Callable], order: list[str], waiting: StructType, n_outputs: int, make: list[str]):
        self.rule, self.own, self.readers, self.order, self.waiting, self.n_outputs, self.make = rule, own, readers, order, waiting, n_outputs, make
        self.marks = StructType([StructField("at", LongType()), StructField("done", LongType())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row = handle, Row(*self.make)
        self.list, self.mark = handle.getListState("waiting", self.waiting), handle.getValueState("mark", self.marks)
        self.rule.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, done = self.mark.get() if self.mark.exists() else (None, None)
        first, some = at, []
        for r in rows:
            values = tuple(r[c] for c in self.own)
            ms = r["_ms"]
            if ms is None or done is not None and ms <= done:
                yield self.row(*values, *[None] * self.n_outputs, True)
                continue
            some.append((*values, ms))
            first = ms if first is None else min(first, ms)
            if len(some) == CHUNK:
                self.list.appendList(some)
                some = []
        if some:
            self.list.appendList(some)
        self._wait(at, first, done)

    def _wait(self, old: int | None, new: int | None, done: int | None) -> None:
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
        self.mark.update((new, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        ready, rest = [], []
        for r in self.list.get():
            (ready if r[-1] <= passed else rest).append(tuple(r))
        named = [({c: None if v is None else self.readers[c](v) for c, v in zip(self.own, r, strict=False) if c in self.readers}, r) for r in ready]
        named.sort(key=lambda x: (x[1][-1], [(x[0][c] is not None, x[0][c]) if x[0][c] is not None else (False,) for c in self.order]))
        self.rule.begin()
        for row, r in named:
            yield self.row(*r[:-1], *self.rule.take(row), False)
        self.rule.end()
        if rest:
            self.list.put(rest)
        else:
            self.list.clear()
        first = min((r[-1] for r in rest), default=None)
        if first is not None:
            self.handle.registerTimer(first)
        self.mark.update((first, passed))

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, keys: dict[str, Column], time: str, delay: str, order: list[str], reads: list[str], outputs: str, rule) -> DataFrame:
    """Rows with ``outputs`` and ``late`` from a rule per key, in order of ``time`` and then ``order``; a late row has no outputs.

    A row waits until the watermark, ``delay`` behind the latest time seen, has passed it. Rows without a time are late.
    Columns pass through as text, so nulls leave integers whole; those of ``order`` and ``reads`` are read for the rule.
    """
    extra = StructType.fromDDL(outputs)
    names = [f.name for f in extra]
    own = [f for f in stream.schema if f.name not in (*names, "late")]
    codec = {f.name: as_text(f.name, f.dataType) for f in own}
    marked = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    # The watermarked column itself does not go on: Spark would drop late rows by it, and they are wanted.
    texts = marked.select(*[codec[f.name][0].alias(f.name) for f in own], *[c.alias(k) for k, c in keys.items()], F.unix_millis("_at").alias("_ms"))
    fields = [StructField(f.name, StringType()) for f in own]
    schema = StructType([*fields, *extra.fields, StructField("late", BooleanType())])
    readers = {c: codec[c][2] for c in dict.fromkeys([*order, *reads])}
    work = InOrder(rule, [f.name for f in own], readers, order, StructType([*fields, StructField("_ms", LongType())]), len(names), schema.names)
    done = texts.groupBy(*keys).transformWithState(work, schema, "append", "EventTime")
    return done.select(*[codec[f.name][1].alias(f.name) for f in own], *names, "late")
