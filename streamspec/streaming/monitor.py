"""A monitor for events that the caller hands over one by one."""

from __future__ import annotations

from dataclasses import dataclass, field

from streamspec.analysis.checker import Spec
from streamspec.streaming.engine import Engine


@dataclass
class Update:
    """What changed: outputs at deadlines before an event, in order, and outputs at the event; and the
    triggers that fired, with their times."""

    timed: list[tuple[int, dict]] = field(default_factory=list)
    event: dict = field(default_factory=dict)
    triggers: list[tuple[int, int, str]] = field(default_factory=list)


class Monitor:
    """Streams of a specification as events and time come in. Times are nanoseconds since the start."""

    def __init__(self, spec: Spec | str):
        self.engine = Engine(spec)
        self.spec = self.engine.spec
        self.cycles = 0
        self.fired = [0] * len(self.spec.triggers)

    def _take(self, ts: int, values: dict, out: Update) -> dict:
        self.cycles += 1
        for i, x in enumerate(self.spec.triggers):
            if values.get(x.stream.name):
                self.fired[i] += 1
                out.triggers.append((ts, i, x.message))
        return {n: values[n] for n in self.spec.outputs if n in values}

    def accept_event(self, values: dict, ts: int) -> Update:
        """Evaluates all deadlines before ts, then the event."""
        out = self.accept_time(ts)
        out.event = self._take(ts, self.engine.event(ts, values), out)
        return out

    def accept_time(self, ts: int, including: bool = False) -> Update:
        """Evaluates all deadlines before ts; with including, one at ts too, since no event at ts will come."""
        out = Update()
        for at, values in self.engine.deadlines(ts, including):
            out.timed.append((at, self._take(at, values, out)))
        return out
