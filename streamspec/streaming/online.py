"""A specification as a Structured Streaming query.

Each key's trace (or the one trace, without keys) is evaluated by an engine whose state is kept by
Spark between micro-batches, so memory is bounded by what the specification looks back to. Within a
micro-batch events are ordered by time; ``wait`` keeps events back for events that come later, and
what comes later still is late.

Deadlines are evaluated when an event after them arrives, or with ``start``, for events that are
stamped as they arrive, by the clock: a timer of the key wakes it when its next deadline is due.
``idle`` ends the trace of a key that had no event for so long and drops its state.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from streamspec.analysis.checker import Spec, check
from streamspec.streaming.monitor import Monitor, Update


def arrived(events: DataFrame, start: int, order: Column | None = None) -> DataFrame:
    """A streaming table with the times at which events come in: nanoseconds from start, which is in
    microseconds since 1970. Events of a micro-batch have the same time; they go by the order, a whole
    number, or as they are read."""
    now = (F.unix_micros(F.current_timestamp()) - F.lit(start)) * 1000
    return events.withColumns({"__ts": now, "__seq": F.lit(0).cast("bigint") if order is None else order.cast("bigint")})


RESULT = "ts bigint, kind int, stream string, trigger int, value string"


class Traced:
    """The monitor of a key, events that wait, and the latest time seen. All of it is state."""

    def __init__(self, source: str, wait: int, late: str):
        self.monitor, self.wait, self.late = Monitor(source), wait, late
        self.waiting: list[tuple[int, int, dict]] = []
        self.newest, self.passed, self.seen, self.dropped = -1, -1, 0, 0

    def _done(self, update: Update, ts: int) -> Iterator[tuple]:
        names = {n: i for i, n in enumerate(self.monitor.spec.outputs)}
        timed = {at for at, _ in update.timed}
        for at, values, kind in [*((a, v, 1) for a, v in update.timed), (ts, update.event, 0)]:
            for n in sorted(values, key=names.__getitem__):
                yield at, kind, n, None, shown(values[n])
        for at, i, message in update.triggers:
            yield at, int(at in timed and at != ts), None, i, message

    def take(self, events: list[tuple[int, int, dict]]) -> Iterator[tuple]:
        """Events that come in, in any order; what becomes known by them."""
        for ts, seq, values in sorted(events, key=lambda e: e[:2]):
            if ts < max(self.monitor.engine.time, self.passed):
                if self.late == "error":
                    raise ValueError(f"an event at {ts} comes after {max(self.monitor.engine.time, self.passed)}")
                self.dropped += 1
                continue
            self.waiting.append((ts, seq, values))
            self.newest = max(self.newest, ts)
        yield from self.release(self.newest - self.wait)

    def release(self, until: int) -> Iterator[tuple]:
        """Evaluates the events that wait, up to a time."""
        due = sorted((e for e in self.waiting if e[0] <= until), key=lambda e: e[:2])
        self.waiting = [e for e in self.waiting if e[0] > until]
        for ts, _, values in due:
            yield from self._done(self.monitor.accept_event(values, ts), ts)

    def clock(self, now: int) -> Iterator[tuple]:
        """Evaluates the deadlines before a time that has come."""
        if now > self.passed:
            self.passed = now
            yield from self._done(self.monitor.accept_time(now), -1)

    def close(self) -> Iterator[tuple]:
        """Evaluates what waits, and the deadlines up to the last event."""
        yield from self.release(self.newest)
        yield from self._done(self.monitor.accept_time(self.newest, including=True), -1)

    @property
    def due(self) -> int | None:
        return min(self.monitor.engine.next.values(), default=None)


def shown(value) -> str | None:
    """A value as text."""
    if value is None:
        return None
    return str(value).lower() if isinstance(value, bool) else value.hex().upper() if isinstance(value, bytes) else str(value)


def run(spec: Spec | str, events: DataFrame, keys: tuple[str, ...] = (), late: str = "error", wait: int = 0, start: int | None = None, idle: int | None = None) -> DataFrame:
    """A streaming table of all values of outputs and all triggers that fire: keys, ts, kind (1 at a
    deadline), stream and value, or trigger (its number) and its message as value.

    events is a streaming table with __ts, __seq and the inputs. late says what becomes of events
    before what was evaluated already: error, or drop. wait: nanoseconds that events may be out of
    order. start: the microseconds since 1970 that times are counted from, where deadlines go by the
    clock. idle: milliseconds after which a key without events ends.
    """
    checked = check(spec) if isinstance(spec, str) else spec
    source, names = checked.tree.source, list(checked.inputs)
    kinds = {n: s.type.kind for n, s in checked.inputs.items()}
    by = list(keys) or ["__all"]
    rows = events if keys else events.withColumn("__all", F.lit(0))
    timed = start is not None or idle is not None

    def value(name: str, v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return int(v) if kinds[name] in ("Int", "UInt") else v

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own: Traced = pickle.loads(state.get[0]) if state.exists else Traced(source, wait, late)
        out: list[tuple] = []
        now = state.getCurrentProcessingTimeMs() if timed else 0
        if not state.hasTimedOut:
            got = [(int(r["__ts"]), int(r["__seq"]), {n: value(n, r[n]) for n in names}) for b in batches for r in b.to_dict("records")]
            out += own.take(got)
            own.seen = now
        if start is not None:
            out += own.clock((now * 1000 - start) * 1000)
        if state.hasTimedOut and idle is not None and now - own.seen >= idle:
            out += own.close() if start is None else ()
            state.remove()
        else:
            state.update((pickle.dumps(own),))
            waits = [own.seen + idle - now] if idle is not None else []
            if start is not None and own.due is not None:
                waits.append((start + own.due // 1000) // 1000 + 1 - now)
            if timed and waits:
                state.setTimeoutDuration(max(1, min(waits)))
        yield pd.DataFrame([(*key, *r) for r in out], columns=[*by, "ts", "kind", "stream", "trigger", "value"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in by) + ", " + RESULT
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timed else GroupStateTimeout.NoTimeout
    made = rows.groupBy(*by).applyInPandasWithState(step, schema, "engine binary", "append", timeout)
    return made if keys else made.drop("__all")


def triggers(spec: Spec | str, events: DataFrame, keys: tuple[str, ...] = (), **more) -> DataFrame:
    """A streaming table of triggers that fire: keys, ts, kind, trigger, message."""
    made = run(spec, events, keys, **more).where("trigger IS NOT NULL")
    return made.select(*keys, "ts", "kind", "trigger", F.col("value").alias("message"))


class Progress(StreamingQueryListener):
    """Counts the events of streaming queries, and how fast they are evaluated."""

    def __init__(self) -> None:
        self.events, self.seconds, self.batches = 0, 0.0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.events += event.progress.numInputRows
        self.seconds += event.progress.batchDuration / 1000
        self.batches += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def line(self) -> str:
        from streamspec.sinks.text import speed

        return speed(self.events, self.seconds)
