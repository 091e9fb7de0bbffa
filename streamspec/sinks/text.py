"""Triggers, outputs and statistics as lines of text."""

from __future__ import annotations

import datetime
import sys
import time as clock

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamspec.lang.units import NANOS
from streamspec.plans.batch import Result

TIMES = ("hide", "relative", "relative_nanos", "relative_human", "absolute", "absolute_nanos", "absolute_human")
VERBOSITY = ("silent", "progress", "warnings", "triggers", "outputs", "debug")
#: Nanoseconds of the units of a human duration, largest first.
_HUMAN = (("year", 31_557_600), ("month", 2_630_016), ("day", 86_400), ("h", 3600), ("m", 60), ("s", 1))


def human(nanos: int) -> str:
    """A duration in words: 1h 2m 3s 4ms."""
    whole, rest = divmod(nanos, NANOS)
    out = []
    for name, size in _HUMAN:
        n, whole = divmod(whole, size)
        if n:
            out.append(f"{n}{name}" + "s" * (len(name) > 1 and n > 1))
    for name, size in (("ms", 10**6), ("us", 1000), ("ns", 1)):
        n, rest = divmod(rest, size)
        if n:
            out.append(f"{n}{name}")
    return " ".join(out) or "0s"


def rfc3339(nanos: int) -> str:
    whole, rest = divmod(nanos, NANOS)
    day = datetime.datetime.fromtimestamp(whole, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S")
    return f"{day}.{rest:09d}Z" if rest else f"{day}Z"


def speed(events: int, seconds: float) -> str:
    """How fast events were evaluated."""
    if not events or not seconds:
        return f"{events} events"
    return f"{events} events, {events / seconds:.0f} events/s, {1e9 * seconds / events:.0f} ns/event"


def stamped(how: str, ts: int, start: int) -> str | None:
    """A time as text, None to hide it."""
    if how not in TIMES:
        raise ValueError(f"{how} is none of {', '.join(TIMES)}")
    if how == "hide":
        return None
    ts += start if how.startswith("absolute") else 0
    if how.endswith("nanos"):
        return str(ts)
    if how.endswith("human"):
        return (human if how.startswith("relative") else rfc3339)(ts)
    return f"{ts // NANOS}.{ts % NANOS:09d}"


class Printer:
    """Prints what a monitor tells as it comes, in the form of ``lines``."""

    def __init__(self, monitor, time: str = "hide", verbosity: str = "triggers", out=None):
        self.monitor, self.time, self.out, self.events = monitor, time, out or sys.stderr, 0
        self.level = VERBOSITY.index(verbosity)
        self.number = {n: i for i, n in enumerate(monitor.spec.outputs)}

    def __call__(self, update, now: int, start: int) -> None:
        parts = []
        instants = [*update.timed, (now, update.event)]
        for i, (ts, values) in enumerate(instants):
            if self.level >= VERBOSITY.index("outputs"):
                from streamspec.streaming.online import shown

                parts += [(ts, i, 0, self.number[n], f"OutputStream[{self.number[n]}] := {'None' if v is None else shown(v)}.") for n, v in values.items()]
        if self.level >= VERBOSITY.index("triggers"):
            at = {ts: i for i, (ts, _) in reversed(list(enumerate(instants)))}
            parts += [(ts, at.get(ts, len(instants)), 1, i, f"Trigger: {m}") for ts, i, m in update.triggers]
        for ts, *_, text in sorted(parts, key=lambda p: p[:4]):
            prefix = stamped(self.time, ts, start)
            print(text if prefix is None else f"{prefix}: {text}", file=self.out, flush=True)

    def summary(self, seconds: float) -> None:
        if self.level >= VERBOSITY.index("progress"):
            for x, n in zip(self.monitor.spec.triggers, self.monitor.fired, strict=True):
                print(f"{n} x {x.message} ({self.monitor.cycles} cycles)", file=self.out)
            print(speed(self.monitor.cycles, seconds), file=self.out, flush=True)


def stamp(how: str, start: int) -> Column | None:
    """The time of a row as text, None to hide it."""
    if how not in TIMES:
        raise ValueError(f"{how} is none of {', '.join(TIMES)}")
    if how == "hide":
        return None
    ts = F.col("ts") + F.lit(start if how.startswith("absolute") else 0)
    if how.endswith("nanos"):
        return ts.cast("string")
    if how.endswith("human"):
        words = F.udf(human if how.startswith("relative") else rfc3339, "string")  # for terminals, on rows that are shown
        return words(ts)
    return F.concat(F.call_function("div", ts, F.lit(NANOS)).cast("string"), F.lit("."), F.lpad((ts % NANOS).cast("string"), 9, "0"))


def lines(result: Result, start: int = 0, time: str = "hide", verbosity: str = "triggers") -> DataFrame:
    """One column, the lines of a run in order of evaluation."""
    at = VERBOSITY.index(verbosity)
    prefix = stamp(time, start)

    def line(text: Column) -> Column:
        return (text if prefix is None else F.concat(prefix, F.lit(": "), text)).alias("line")

    parts = []
    if at >= VERBOSITY.index("outputs"):
        number = F.create_map(*[F.lit(x) for i, n in enumerate(result.spec.outputs) for x in (n, i)]) if result.spec.outputs else F.create_map()
        log = result.log().withColumn("n", number[F.col("stream")] if result.spec.outputs else F.lit(0))
        parts.append(log.select("ts", "kind", "seq", F.lit(0).alias("o"), "n", line(F.concat(F.lit("OutputStream["), F.col("n").cast("string"), F.lit("] := "), F.coalesce("value", F.lit("None")), F.lit(".")))))
    if at >= VERBOSITY.index("triggers"):
        parts.append(result.triggers().select("ts", "kind", "seq", F.lit(1).alias("o"), F.col("trigger").alias("n"), line(F.concat(F.lit("Trigger: "), F.col("message")))))
    if not parts:
        return result.line.df.sparkSession.createDataFrame([], "line string")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.orderBy("ts", "kind", "seq", "o", "n").select("line")


def show(result: Result, start: int = 0, time: str = "hide", verbosity: str = "triggers", channel: str = "stderr", path: str | None = None) -> None:
    """Writes the lines: to stdout, stderr, nowhere, or a folder."""
    rows = lines(result, start, time, verbosity)
    if channel == "file":
        rows.write.mode("overwrite").text(path)
        return
    if channel == "none":
        return
    out, began = sys.stdout if channel == "stdout" else sys.stderr, clock.perf_counter()
    for r in rows.toLocalIterator():
        print(r.line, file=out)
    if VERBOSITY.index(verbosity) >= VERBOSITY.index("progress"):
        cycles = 0
        for r in result.statistics().collect():  # a row for each trigger
            cycles = r.cycles
            print(f"{r.fired} x {r.message} ({r.cycles} cycles)" if r.message is not None else f"{r.cycles} cycles", file=out)
        print(speed(cycles, clock.perf_counter() - began), file=out)
