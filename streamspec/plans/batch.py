"""Evaluates a specification over a whole trace.

The checked streams are taken in dependency order. Streams that can be evaluated together become
columns of the timeline in one projection; what they need from the past (latest values, offsets,
sliding windows) is added before, once for all streams that need it. Catalyst sees one plan of
projections, windows and aggregations and prunes what is not asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamspec.analysis.checker import Spec, Stream, check
from streamspec.analysis.clocks import Clock, Periodic
from streamspec.analysis.graph import recursive_groups
from streamspec.functions.columns import Columns, sql_type
from streamspec.lang import tree as t
from streamspec.lang.units import nanos
from streamspec.operators import recursion, sliding, temporal
from streamspec.operators.timeline import CHUNK_ROWS, ORDER, Timeline, build
from streamspec.storage import materialise



def active(clock: Clock) -> Column:
    """Whether a stream has a value at a row."""
    if isinstance(clock, Periodic):
        return (F.col("__kind") == 1) & (F.col("__ts") % nanos(clock.period) == 0)
    if clock.always:
        return F.col("__kind") == 0
    out = None
    for term in sorted(map(sorted, clock.terms)):
        one = None
        for name in term:
            here = F.col(f"`{name}`").isNotNull()
            one = here if one is None else one & here
        out = one if out is None else out | one
    return out


class Evaluation:
    """The columns of all streams of a specification over a timeline."""

    def __init__(self, spec: Spec, line: Timeline, exact_windows: bool = False):
        self.spec, self.line, self.exact = spec, line, exact_windows
        self.ready: set[str] = set()
        self.joined = False

    # accesses

    def helper(self, e: t.Expr) -> str | None:
        """The column that an access to the past needs."""
        match e:
            case t.Hold():
                return f"hold {e.target.name}"
            case t.Offset():
                return f"back {e.steps} {e.target.name}"
            case t.Aggregate():
                return f"window {e.number}"
        return None

    def access(self, e: t.Expr) -> Column:
        match e:
            case t.Ident():
                return F.col(f"`{e.name}`")["v"]
            case t.Get():
                return F.col(f"`{e.target.name}`")["v"]
            case t.Aggregate():
                return sliding.value(self.spec.windows[e.number], F.col(f"`window {e.number}`"))
        return F.col(f"`{self.helper(e)}`")["v"]

    def prepare(self, streams: list[Stream], own: frozenset[str] = frozenset()) -> None:
        """Adds what streams need from the past of streams that are complete, those in own left out."""
        holds: dict[str, Column] = {}
        windows: list[tuple[t.Aggregate, int]] = []
        for s in streams:
            for e in t.walk(s.expr):
                name = self.helper(e)
                if name is None or name in self.ready or e.target.name in own and not isinstance(e, t.Aggregate):
                    continue
                self.ready.add(name)
                if isinstance(e, t.Hold):
                    holds[name] = F.col(f"`{e.target.name}`")
                elif isinstance(e, t.Offset):
                    self.line = temporal.back(self.line, e.target.name, e.steps, name)
                else:
                    windows.append((e, nanos(s.clock.period)))
        self.windows(windows)
        self.line = temporal.latest(self.line, holds)

    def windows(self, wanted: list[tuple[t.Aggregate, int]]) -> None:
        """Adds the results of sliding windows, all computed from the timeline as it is.

        The timeline is then read once for each window and once for itself. Where it holds results of
        windows already, it is written first, so that plans do not multiply.
        """
        if not wanted:
            return
        self.line = self.line.with_df(materialise(self.line.df, "timeline")) if self.joined else self.line.settled()
        self.joined, base = True, self.line
        for e, period in wanted:
            found = sliding.aggregate(base, e.target.name, self.spec.windows[e.number], period, self.exact).withColumnRenamed("value", f"window {e.number}")
            self.line = self.line.with_df(self.line.df.join(found, [*base.keys, "__ts", "__kind"], "left"))

    # evaluation

    def run(self) -> Timeline:
        spec = self.spec
        streams = spec.streams()
        inputs = {n: F.when(F.col(f"`{n}`").isNotNull(), F.struct(F.col(f"`{n}`").alias("v"))) for n in spec.inputs}
        self.line = self.line.with_df(self.line.df.withColumns(inputs))
        waiting: list[list[Stream]] = [[streams[n] for n in g] for g in recursive_groups(spec) if not streams[g[0]].is_input]
        done = set(spec.inputs)
        while waiting:
            plain, later = [], []
            for g in waiting:
                own = {s.name for s in g}
                free = all(u.name in done or u.name in own for s in g for u in s.uses)
                recursive = len(g) > 1 or any(u.name in own for u in g[0].uses)
                if free and not recursive:
                    plain.append(g[0])
                else:
                    later.append((g, own, free))
            if plain:
                self.prepare(plain)
                column = Columns(spec, self.access)
                self.line = self.line.with_df(self.line.df.withColumns({s.name: F.when(active(s.clock), F.struct(column(s.expr).alias("v"))) for s in plain}))
                done |= {s.name for s in plain}
                waiting = [g for g, _, _ in later]
                continue
            g, own, _ = next(x for x in later if x[2])
            self.recursive(g, frozenset(own))
            done |= own
            waiting = [x[0] for x in later if x[0] is not g]
        return self.line

    def recursive(self, group: list[Stream], own: frozenset[str]) -> None:
        self.prepare(group, own)
        form = recursion.shape(self.spec, group[0]) if len(group) == 1 else None
        column = Columns(self.spec, self.access)
        if form is not None:
            self.line = recursion.aggregated(self.line, group[0], form, column, active(group[0].clock))
            return
        made = None
        if self.line.chunks > 1 and len(group) == 1 and (linear := recursion.remainder(self.spec, group[0], column)):
            self.line = self.line.settled()
            made = recursion.composed(self.line, group[0], linear, column, active(group[0].clock))
        if made is not None:
            self.line = made
        else:
            self.line = recursion.folded(self.line, self.spec, group, {s.name: active(s.clock) for s in group}, self.access)


@dataclass
class Result:
    """What a run gives, as DataFrames; times are nanoseconds since the first event.

    keys: columns that divided the trace.
    """

    spec: Spec
    line: Timeline

    @property
    def instant(self) -> list[Column]:
        """ts, kind (0 for events, 1 for deadlines) and seq (order of events), with the prefix __ where a stream has the name."""
        taken = {*self.spec.inputs, *self.spec.outputs, *self.line.keys}
        return [F.col(n).alias(n if n[2:] in taken else n[2:]) for n in ORDER]

    def values(self, *names: str) -> DataFrame:
        """ts, kind, seq and columns of streams: null where a stream has no value or stored none."""
        names = names or tuple(self.spec.outputs)
        return self.line.df.select(*self.line.keys, *self.instant, *[F.col(f"`{n}`")["v"].alias(n) for n in names])

    def stream(self, name: str) -> DataFrame:
        """ts and value of the instants at which a stream was evaluated."""
        c = F.col(f"`{name}`")
        return self.line.df.where(c.isNotNull()).select(*self.line.keys, F.col("__ts").alias("ts"), F.col("__seq").alias("seq"), c["v"].alias("value"))

    def triggers(self) -> DataFrame:
        """ts, trigger (its number) and message of every trigger that fired, in no order."""
        found = F.array(*[
            F.struct(F.lit(i).alias("trigger"), F.lit(x.message).alias("message"), F.coalesce(F.col(f"`{x.stream.name}`")["v"], F.lit(False)).alias("fired"))
            for i, x in enumerate(self.spec.triggers)
        ]) if self.spec.triggers else F.array().cast("array<struct<trigger:int,message:string,fired:boolean>>")
        rows = self.line.df.select(*self.line.keys, *[F.col(n).alias(n[2:]) for n in ORDER], F.explode(F.filter(found, lambda x: x["fired"])).alias("x"))
        return rows.select(*self.line.keys, *[n[2:] for n in ORDER], "x.trigger", "x.message")

    def log(self) -> DataFrame:
        """ts, stream and value (as text) of every evaluation of an output."""
        items = [F.struct(F.lit(n).alias("stream"), F.col(f"`{n}`").isNotNull().alias("there"), self._text(n).alias("value")) for n in self.spec.outputs]
        none = F.array().cast("array<struct<stream:string,there:boolean,value:string>>")
        rows = self.line.df.select(*self.line.keys, *[F.col(n).alias(n[2:]) for n in ORDER], F.explode(F.filter(F.array(*items), lambda x: x["there"]) if items else none).alias("x"))
        return rows.select(*self.line.keys, *[n[2:] for n in ORDER], "x.stream", "x.value")

    def _text(self, name: str) -> Column:
        v = F.col(f"`{name}`")["v"]
        kind = self.spec.outputs[name].type
        return F.to_json(v) if sql_type(kind).startswith("struct") else F.hex(v) if kind.kind == "Bytes" else v.cast("string")

    def statistics(self) -> DataFrame:
        """How often each trigger fired, 0 included, and the number of evaluation cycles."""
        cycles = self.line.df.agg(F.count(F.lit(1)).alias("cycles"))
        sums = [F.sum(F.coalesce(F.col(f"`{x.stream.name}`")["v"], F.lit(False)).cast("bigint")).alias(f"t{i}") for i, x in enumerate(self.spec.triggers)]
        if not sums:
            return cycles.select(F.lit(None).cast("int").alias("trigger"), F.lit(None).cast("string").alias("message"), F.lit(0).cast("bigint").alias("fired"), "cycles")
        one = self.line.df.agg(F.count(F.lit(1)).alias("cycles"), *sums)
        rows = F.array(*[F.struct(F.lit(i).alias("trigger"), F.lit(x.message).alias("message"), F.coalesce(F.col(f"t{i}"), F.lit(0)).alias("fired")) for i, x in enumerate(self.spec.triggers)])
        return one.select(F.explode(rows).alias("x"), "cycles").select("x.*", "cycles")


def evaluate(spec: Spec | str, trace: DataFrame, keys: tuple[str, ...] = (), exact_windows: bool = False, chunk_rows: int = CHUNK_ROWS) -> Result:
    """Runs a specification over a trace: __ts (nanoseconds since the first event), __seq (order of
    events) and a column for each input, null where an event has none; keys divide the trace into
    independent ones. ``sources.trace`` makes traces."""
    spec = check(spec) if isinstance(spec, str) else spec
    missing = [n for n in ("__ts", "__seq", *keys, *spec.inputs) if n not in trace.columns]
    if missing:
        raise ValueError(f"the trace has no column {', '.join(missing)}")
    periods = sorted({nanos(s.clock.period) for s in spec.streams().values() if isinstance(s.clock, Periodic)})
    if 0 in periods:
        raise ValueError("a period is shorter than a nanosecond")
    cols = [F.col(f"`{n}`").cast(sql_type(s.type)).alias(n) for n, s in spec.inputs.items()]
    events = trace.select(*keys, F.col("__ts").cast("bigint"), F.col("__seq").cast("bigint"), *cols)
    line = build(events, periods, keys, chunk_rows)
    return Result(spec, Evaluation(spec, line, exact_windows).run())
