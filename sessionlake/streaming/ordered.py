"""Folds of event streams whose events come late and out of order.

An event waits in state until the watermark has passed its time; then it is applied, in order of time and ``seq``, so what
a fold says never has to be taken back and equals what the table's fold says of the same events. Events that come after
the watermark has passed them are dropped, as everywhere under a watermark. Each waiting event and each part of a fold's
state (a file's path, a person, a pair) is a row of state of its own: an event reads and writes the rows that it names.

The streams need the RocksDB state store (``STORE``), which keeps state on disk and not in memory.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class InOrder(StatefulProcessor):
    """Keeps events (``ts`` in microseconds, ``seq``, ``event`` as JSON) until their time is over, then applies them."""

    def __init__(self, names: list[str]):
        self.names = names

    def row(self, *values) -> Row:
        return Row(**dict(zip(self.names, values)))

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long, seq long", "event string")
        self.start(handle)

    def start(self, handle) -> None:
        raise NotImplementedError

    def apply(self, key: tuple, seq: int, event: dict) -> Iterator[Row]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for ms in {self.hold(row) for row in rows}:
            self.handle.registerTimer(ms)
        return iter([])

    def hold(self, row: Row) -> int:
        self.waiting.updateValue((row["ts_us"], row["seq"]), (row["event"],))
        return row["ts_us"] // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        over = timerValues.getCurrentWatermarkInMs() * 1000
        for ts, seq in sorted(k for k in self.waiting.keys() if k[0] <= over):
            (event,) = self.waiting.getValue((ts, seq))
            self.waiting.removeKey((ts, seq))
            yield from self.apply(key, seq, json.loads(event))

    def close(self) -> None:
        pass


def _folded(events: DataFrame, key: str, fields: list[str], delay: str, fold: type[InOrder], shape: str, mode: str) -> DataFrame:
    told = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("event")
    rows = events.withWatermark("ts", delay).select(key, "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("seq").cast("long").alias("seq"), told)
    kind = events.schema[key].dataType.simpleString()
    out = T._parse_datatype_string(f"{key} {kind}, {shape}")
    return rows.groupBy(key).transformWithState(fold(out.names), out, mode, "EventTime")


class _Paths(InOrder):
    """The path that each file index of a run stands for."""

    def start(self, handle) -> None:
        self.paths = handle.getMapState("paths", "file_index long", "path string")

    def apply(self, key, seq, event):
        at, path = event["file_index"], event["path"]
        if at is not None:
            if path is not None:
                self.paths.updateValue((at,), (path,))
            elif self.paths.containsKey((at,)):
                path = self.paths.getValue((at,))[0]
        yield self.row(*key, seq, event["kind"], at, path)
        if event["kind"] in ("batch_done", "cancelled"):
            self.paths.clear()


def resolved_paths(events: DataFrame, run: str = "run", delay: str = "10 minutes") -> DataFrame:
    """Each event of ``run, ts, seq, kind, file_index, path`` with ``resolved``, as ``fold.resolve_paths`` has it (append)."""
    return _folded(events, run, ["kind", "file_index", "path"], delay, _Paths, "seq long, kind string, file_index long, resolved string", "append")


class _Phases(InOrder):
    """A file's state, progress, completed phases (in order of their ends) and last warning."""

    def start(self, handle) -> None:
        self.now = handle.getValueState("now", "state string, progress double, n long, message string")
        self.ended = handle.getListState("ended", "phase string")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = None
        for last in super().handleExpiredTimer(key, timerValues, expiredTimerInfo):
            pass
        if last is not None:
            yield last

    def apply(self, key, seq, event):
        kind = event["kind"]
        state, progress, n, message = self.now.get() if self.now.exists() else (None, 0.0, 0, None)
        if kind == "start":
            state, progress, n, message = "running", 0.0, 0, None
            self.ended.clear()
        elif state is None:
            if kind in ("error", "warning", "phase_done"):
                return
            state = "running"
        n += 1
        if kind == "error":
            state = "failed"
        elif kind == "done":
            state, progress = ("failed" if state == "failed" else "success"), 1.0
        elif kind == "phase":
            progress = 0.0
        elif kind == "progress":
            progress = float(event["amount"])
        elif kind == "phase_done":
            self.ended.appendValue((event["phase"],))
            progress = 1.0
        elif kind == "warning":
            message = event["message"]
        self.now.update((state, progress, n, message))
        yield self.row(*key, seq, state, progress, n, [p for (p,) in self.ended.get()] if self.ended.exists() else [], message)


def file_states(events: DataFrame, key: str, delay: str = "10 minutes") -> DataFrame:
    """Files' states after the events ``ts, seq, kind, amount, phase, message`` (update mode): ``last_seq, state, progress,
    n_events, completed, message``.

    ``fold.fold_events`` and ``fold.completed_phases`` of one table: errors, warnings and ends of phases of a file that
    nothing else made known are passed over; the end of a phase sets the progress to 1.
    """
    return _folded(events, key, ["kind", "amount", "phase", "message"], delay, _Phases, "last_seq long, state string, progress double, n_events long, completed array<string>, message string", "update")


class _View(InOrder):
    """A viewer's persons by place, and its collisions by pair; changes come out, not the whole view."""

    def start(self, handle) -> None:
        self.persons = handle.getMapState("persons", "place long", "id string, fields string")
        self.places = handle.getMapState("places", "id string, place long", "there boolean")
        self.next = handle.getValueState("next", "place long")
        self.pairs = handle.getMapState("pairs", "a string, b string", "first string, second string, similarity double")

    def apply(self, key, seq, event):
        kind, source, target = event["kind"], event["source"], event["target"]
        if kind == "listed":
            for (place,) in list(self.persons.keys()):
                yield self.row(*key, seq, "person", str(place), None)
            self.persons.clear()
            self.places.clear()
            for p in event["persons"] or []:
                yield self.put(key, seq, self.new_place(), p["id"], p["fields"] or {})
        elif kind == "inspected":
            for place in self.of(event["person"]["id"]):
                who, held = self.persons.getValue((place,))
                yield self.put(key, seq, place, who, json.loads(held) | (event["person"]["fields"] or {}))
        elif kind == "renamed":
            for place in self.of(source):
                _, held = self.persons.getValue((place,))
                self.places.removeKey((source, place))
                yield self.put(key, seq, place, target, json.loads(held))
        elif kind == "merged":
            for place in self.of(source):
                self.persons.removeKey((place,))
                self.places.removeKey((source, place))
                yield self.row(*key, seq, "person", str(place), None)
            for a, b in [k for k in self.pairs.keys() if source in k]:
                self.pairs.removeKey((a, b))
                yield self.row(*key, seq, "collision", f"{a}|{b}", None)
        elif kind == "collision":
            pair = tuple(sorted((source, target)))
            self.pairs.updateValue(pair, (source, target, event["similarity"]))
            yield self.row(*key, seq, "collision", "|".join(pair), json.dumps({"a": source, "b": target, "similarity": event["similarity"]}))

    def of(self, who: str) -> list[int]:
        return sorted(place for name, place in self.places.keys() if name == who)

    def new_place(self) -> int:
        place = self.next.get()[0] if self.next.exists() else 0
        self.next.update((place + 1,))
        return place

    def put(self, key, seq, place: int, who: str, fields: dict) -> Row:
        self.persons.updateValue((place,), (who, json.dumps(fields)))
        self.places.updateValue((who, place), (True,))
        return self.row(*key, seq, "person", str(place), json.dumps({"id": who, "fields": fields}))


def view_changes(events: DataFrame, viewer: str, delay: str = "10 minutes") -> DataFrame:
    """The changes of ``view.registry_view`` as a stream (append): ``viewer, seq, part, key, value``.

    ``part`` is person (``key``: its place) or collision (``key``: the pair); ``value`` is JSON, null where it is gone. Of
    each part and key the last change holds: a sink that replaces rows by them holds the view, persons in order of place,
    collisions in order of ``seq``.
    """
    fields = ["kind", "persons", "person", "source", "target", "similarity"]
    return _folded(events, viewer, fields, delay, _View, "seq long, part string, key string, value string", "append")


def phase_pairs(starts: DataFrame, ends: DataFrame, key: list[str], longest: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Starts and ends of phases (``key, ts``) as a stream of pairs: ``key, started, ended, elapsed_s`` (append).

    A start without an end within ``longest`` comes out once, with nulls, after the watermark has passed its time.
    """
    s = starts.withWatermark("ts", delay).select(*[F.col(c).alias(f"_{c}") for c in key], F.col("ts").alias("started"))
    e = ends.withWatermark("ts", delay).select(*key, F.col("ts").alias("ended"))
    same = F.expr(" AND ".join(f"_{c} = {c}" for c in key) + f" AND ended >= started AND ended <= started + INTERVAL {longest}")
    took = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6
    return s.join(e, same, "leftOuter").select(*[F.col(f"_{c}").alias(c) for c in key], "started", "ended", took.alias("elapsed_s"))
