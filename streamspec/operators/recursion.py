"""Streams that depend on their own past.

Common recursions are running aggregates and stay in Spark: ``x[-1].defaults(to: c) + e``, the same
with min, max, && and ||, latches ``if p then e else x[-1].defaults(to: c)``, and toggles
``!x[-1].defaults(to: c)``. Remainders of linear recursions, ``(x[-1].defaults(to: c) * a + b) % m``
with a and b free of x, are composed: each chunk is one such step, the steps of chunks are chained,
and chunks then run side by side from their own starting values. Anything else is a fold: a Python
function, generated from the expressions, reads the ordered timeline, batch by batch, and keeps
as many past values as offsets need. A fold is sequential by its nature: with keys a task for each key;
without, chunk after chunk, each from the past values that the one before it left, over the rows and
columns that can change them. From these chunks then run side by side.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from streamspec.analysis.checker import Spec, Stream
from streamspec.functions.columns import Columns, sql_type
from streamspec.functions.python import NAMES, Source
from streamspec.lang import tree as t
from streamspec.operators.temporal import running
from streamspec.operators.timeline import CHUNK, ORDER, Timeline
from streamspec.storage import drop_path, materialise, scratch


def _bare(e: t.Expr) -> t.Expr:
    while isinstance(e, t.Paren):
        e = e.value
    return e


def _own_last(e: t.Expr, name: str) -> t.Expr | None:
    """c if e is name[-1].defaults(to: c)."""
    e = _bare(e)
    if isinstance(e, t.Default):
        v = _bare(e.value)
        if isinstance(v, t.Offset) and v.target.name == name and v.steps == 1:
            return e.other
    return None


def _constant(e: t.Expr, spec: Spec) -> bool:
    return not any(isinstance(x, (t.Hold, t.Get, t.Offset, t.Aggregate)) or isinstance(x, t.Ident) and x.name not in spec.constants for x in t.walk(e))


def _free(e: t.Expr, name: str) -> bool:
    return not any(isinstance(x, t.Ident) and x.name == name for x in t.walk(e))


def shape(spec: Spec, s: Stream) -> tuple[str, t.Expr, t.Expr | None, t.Expr | None] | None:
    """(form, start, value, condition) of a recursion that is a running aggregate."""
    e, name = _bare(s.expr), s.name

    def fits(c: t.Expr | None, *others: t.Expr) -> bool:
        return c is not None and _constant(c, spec) and all(_free(o, name) for o in others)

    match e:
        case t.Binary(op="+" | "&&" | "||"):
            for mine, other in ((e.left, e.right), (e.right, e.left)):
                if fits(c := _own_last(mine, name), other):
                    return {"+": "sum", "&&": "and", "||": "or"}[e.op], c, other, None
        case t.Call(name="min" | "max", self_=None):
            for mine, other in ((e.args[0][1], e.args[1][1]), (e.args[1][1], e.args[0][1])):
                if fits(c := _own_last(mine, name), other):
                    return e.name, c, other, None
        case t.Ite():
            if fits(c := _own_last(e.other, name), e.cond, e.then):
                return "latch", c, e.then, e.cond
            if fits(c := _own_last(e.then, name), e.cond, e.other):
                return "latch-else", c, e.other, e.cond
        case t.Unary(op="!"):
            if fits(c := _own_last(e.value, name)):
                return "toggle", c, None, None
    return None


def aggregated(line: Timeline, s: Stream, form: tuple, column: Columns, active: Column) -> Timeline:
    """Adds the column of a stream whose recursion is a running aggregate."""
    kind, start, value, cond = form
    c = column(start)
    if kind == "toggle":
        line = running(line, {"__r": (F.when(active, F.lit(1)), "count")})
        out = F.when(F.col("__r") % 2 == 1, ~c).otherwise(c)
    elif kind in ("latch", "latch-else"):
        hit = column(cond) if kind == "latch" else ~column(cond)
        line = running(line, {"__r": (F.when(active & hit, F.struct(column(value).alias("v"))), "last")})
        out = F.when(F.col("__r").isNotNull(), F.col("__r")["v"]).otherwise(c)
    else:
        function = {"sum": "sum", "min": "min", "max": "max", "and": "min", "or": "max"}[kind]
        line = running(line, {"__r": (F.when(active, column(value)), function)})
        r = F.col("__r")
        out = {"sum": lambda: c + r, "min": lambda: F.least(c, r), "max": lambda: F.greatest(c, r), "and": lambda: c & r, "or": lambda: c | r}[kind]()
    return line.with_df(line.df.withColumn(s.name, F.when(active, F.struct(out.alias("v")))).drop("__r"))


Linear = tuple[Column, Column]


def remainder(spec: Spec, s: Stream, column: Columns) -> tuple[t.Expr, int, Linear] | None:
    """Start, modulus, and the columns a and b of a stream that is the remainder of a times its last
    value plus b; both are free of the stream."""
    e, starts = _bare(s.expr), []
    if s.type.kind not in ("Int", "UInt") or not isinstance(e, t.Binary) or e.op != "%":
        return None
    m = _bare(e.right)
    m = spec.constants[m.name][0] if isinstance(m, t.Ident) and m.name in spec.constants else m
    if not isinstance(m, t.Lit) or not 0 < m.value <= 2**31:
        return None
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def linear(x: t.Expr) -> Linear | None:
        x = _bare(x)
        if (start := _own_last(x, s.name)) is not None:
            starts.append(start)
            return one, zero
        if _free(x, s.name):
            return zero, column(x)
        if isinstance(x, t.Binary) and x.op == "+":
            left, right = linear(x.left), linear(x.right)
            return left and right and (left[0] + right[0], left[1] + right[1])
        if isinstance(x, t.Binary) and x.op == "*":
            for own, other in ((x.left, x.right), (x.right, x.left)):
                if _free(other, s.name) and (found := linear(own)):
                    return found[0] * column(other), found[1] * column(other)
        return None

    found = linear(e.left)
    if found is None or len(starts) != 1 or not _constant(starts[0], spec):
        return None
    return starts[0], int(m.value), found


def _whole(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("bigint"))


def composed(line: Timeline, s: Stream, form: tuple[t.Expr, int, Linear], column: Columns, active: Column) -> Timeline | None:
    """Adds the column of a remainder by chunks; None where a value is negative or so large that a step
    could overflow, which only the fold tells apart."""
    start, m, (a, b) = form
    parts, limit = line.parts, 2**31
    here = F.coalesce(active, F.lit(False))
    df = line.df.withColumns({"__on": here, "__a": F.when(here, a), "__b": F.when(here, b), "__c": column(start)})
    line = line.with_df(materialise(df, "steps"))
    low, high, first = line.df.agg(F.least(F.min("__a"), F.min("__b"), F.min("__c")), F.greatest(F.max("__a"), F.max("__b")), F.max("__c")).first()
    if low is None or low < 0 or high >= limit or first >= limit:
        return None
    rows = line.with_df(line.df.select(*[F.col(f"`{p}`") for p in parts], *ORDER, "__a", "__b")).dealt().sortWithinPartitions(*parts, *ORDER)
    schema = rows.select(*[F.col(f"`{p}`") for p in parts]).schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """a and b of each part."""
        part, pair = None, [1, 0]

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{**dict(zip(parts, part, strict=True)), "__ca": pair[0], "__cb": pair[1]}], steps_schema)

        for batch in batches:
            own = zip(*[batch.column(p).to_pylist() for p in parts], strict=True)
            for key, x, y in zip(own, batch.column("__a").to_pylist(), batch.column("__b").to_pylist(), strict=True):
                if key != part:
                    if part is not None:
                        yield done()
                    part, pair = key, [1, 0]
                if x is not None:
                    pair = [pair[0] * x % m, (pair[1] * x + y) % m]
        if part is not None:
            yield done()

    from pyspark.sql.pandas.types import to_arrow_schema

    steps = StructType([*schema.fields, StructField("__ca", LongType()), StructField("__cb", LongType())])
    steps_schema = to_arrow_schema(steps)
    per = materialise(rows.select(*[F.col(f"`{p}`") for p in parts], "__a", "__b").mapInArrow(step, steps), "composed")
    keys = list(line.keys)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a part starts from: the last value before it, null for none but the default."""
        key, x = None, first
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if tuple(r[k] for k in keys) != key:
                    key, x = tuple(r[k] for k in keys), first
                out.append(x)
                x = (r["__ca"] * x + r["__cb"]) % m
            yield pa.RecordBatch.from_pydict({**{p: batch.column(p) for p in parts}, "__x": pa.array(out, pa.int64())})

    # A row for each part: in one task without keys, since there are at most so many chunks.
    ordered = (per.repartition(*map(F.col, keys)) if keys else per.repartition(1)).sortWithinPartitions(*parts)
    starts = materialise(ordered.mapInArrow(chain, StructType([*schema.fields, StructField("__x", LongType())])), "starts")
    joined = line.df.join(starts if keys else F.broadcast(starts), parts)
    joined = line.with_df(joined).dealt().sortWithinPartitions(*parts, *ORDER)
    rest = [n for n in line.df.columns if n not in ("__a", "__b", "__c")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, v = None, 0
        for batch in batches:
            out = []
            own = zip(*[batch.column(p).to_pylist() for p in parts], strict=True)
            for key, x, y, v0 in zip(own, batch.column("__a").to_pylist(), batch.column("__b").to_pylist(), batch.column("__x").to_pylist(), strict=True):
                if key != part:
                    part, v = key, v0
                if x is not None:
                    v = (v * x + y) % m
                out.append(v)
            yield pa.RecordBatch.from_pydict({**{n: batch.column(n) for n in rest}, "__v": pa.array(out, pa.int64())})

    made = joined.select(*[F.col(f"`{n}`") for n in (*rest, "__a", "__b", "__x")])
    out = made.mapInArrow(run, StructType([*made.select(*[F.col(f"`{n}`") for n in rest]).schema.fields, StructField("__v", LongType())]))
    return line.with_df(out.withColumn(s.name, F.when(F.col("__on"), F.struct(F.col("__v").alias("v")))).drop("__on", "__v"))


def program(spec: Spec, group: list[Stream], inputs: Callable[[t.Expr], str]) -> str:
    """Python source of one step of a fold. Values at this instant are v0, v1, ...; past ones are in
    p0, p1, ..., newest first. inputs names the values that come from the timeline."""
    at = {s.name: i for i, s in enumerate(group)}
    lines = ["def step(row, active, past):"]
    lines += [f"    v{i} = None; f{i} = active[{i}]; p{i} = past[{i}]" for i in range(len(group))]

    def access(e: t.Expr) -> str:
        name = e.name if isinstance(e, t.Ident) else e.target.name
        if name not in at or isinstance(e, t.Aggregate):
            return inputs(e)
        i = at[name]
        if isinstance(e, t.Ident):
            return f"v{i}"
        if isinstance(e, t.Get):
            return f"(v{i} if f{i} else None)"
        if isinstance(e, t.Hold):
            return f"(v{i} if f{i} else p{i}[0] if p{i} else None)"
        return f"(p{i}[{e.steps - 1}] if len(p{i}) >= {e.steps} else None)"

    write = Source(spec, access)
    for s in sorted(group, key=lambda s: s.layer):
        lines += [f"    if f{at[s.name]}:", f"        v{at[s.name]} = {write(s.expr)}"]
    for i in range(len(group)):
        lines.append(f"    if f{i}: p{i}.appendleft(v{i})")
    lines.append(f"    return ({', '.join(f'v{i}' for i in range(len(group)))},)")
    return "\n".join(lines)


def folded(line: Timeline, spec: Spec, group: list[Stream], active: dict[str, Column], access: Callable[[t.Expr], Column]) -> Timeline:
    """Adds the columns of streams that only a fold can compute."""
    own = {s.name for s in group}
    needed: dict[str, Column] = {}
    keys: dict[str, str] = {}

    def inputs(e: t.Expr) -> str:
        key = str(e) if not isinstance(e, t.Aggregate) else f"{e}#{e.number}"
        if key not in keys:
            keys[key] = f"__i{len(keys)}"
            needed[keys[key]] = access(e)
        return f"row[{int(keys[key][3:])}]"

    source = program(spec, group, inputs)
    depth = {s.name: 1 for s in group}
    for s in group:
        for u in s.uses:
            if u.name in own:
                depth[u.name] = max(depth[u.name], u.steps)
    depths, names = [depth[s.name] for s in group], [s.name for s in group]
    flags = [f"__a{i}" for i in range(len(group))]
    by = list(line.keys)
    chunked = line.chunks > 1 and not by
    line = line.settled() if chunked else line
    df = line.df.withColumns({**needed, **{f: F.coalesce(active[n], F.lit(False)) for f, n in zip(flags, names, strict=True)}})
    rest, values = list(line.df.columns), [f"__v{i}" for i in range(len(group))]
    ins = list(needed)

    def columns(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
        return zip(*[batch.column(c).to_pylist() for c in names], strict=True) if names else iter([()] * batch.num_rows)

    def compiled() -> Callable:
        space = dict(NAMES)
        exec(source, space)
        return space["step"]

    def leaves(start: bytes) -> Callable:
        """The past values after a chunk, from those before it."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step, past = compiled(), pickle.loads(start)
            for batch in batches:
                for row, mark in zip(columns(batch, ins), columns(batch, flags), strict=True):
                    step(row, mark, past)
            yield pa.RecordBatch.from_pydict({"past": pa.array([pickle.dumps(past)], pa.binary())})

        return read

    starts = [pickle.dumps([deque(maxlen=d) for d in depths])]
    if chunked:
        # A folder for each chunk, so that a chunk is read by itself, and a task for it.
        path, spark = scratch(df.sparkSession, "fold"), df.sparkSession
        acting = df.where(reduce(Column.__or__, map(F.col, flags))).select(CHUNK, *ORDER, *flags, *ins)
        line.with_df(acting).dealt().write.partitionBy(CHUNK).parquet(path)
        rows = spark.read.schema(acting.schema).parquet(path)
        for i in range(line.chunks - 1):
            own = rows.where(F.col(CHUNK) == i).coalesce(1).sortWithinPartitions(*ORDER)
            found = own.select(*flags, *ins).mapInArrow(leaves(starts[-1]), "past binary").first()
            starts.append(bytes(found[0]) if found else starts[-1])
        drop_path(spark, path)
        df = line.with_df(df).dealt().sortWithinPartitions(CHUNK, *ORDER)
    else:
        df = df.repartition(*([line.tasks] if line.chunks > 1 else []), *map(F.col, by)) if by else df.repartition(1)
        df = df.sortWithinPartitions(*by, *ORDER)
    parts = line.parts if chunked else by

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, past, key = compiled(), None, None
        for batch in batches:
            out = []
            for row, mark, own in zip(columns(batch, ins), columns(batch, flags), columns(batch, parts), strict=True):
                if past is None or own != key:
                    past, key = pickle.loads(starts[own[0] if chunked else 0]), own
                out.append(step(row, mark, past))
            cols = list(zip(*out, strict=True)) if out else [()] * len(values)
            arrays = {c: batch.column(c) for c in [*rest, *flags]}
            for name, c in zip(values, cols, strict=True):
                arrays[name] = pa.array(list(c), arrow[name])
            yield pa.RecordBatch.from_pydict(arrays)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = ", ".join(f"{v} {sql_type(s.type)}" for v, s in zip(values, group, strict=True))
    made = StructType.fromDDL(kinds)
    arrow = {f.name: to_arrow_type(f.dataType) for f in made}
    schema = StructType([*df.select(*[f"`{c}`" for c in rest], *flags).schema.fields, *made.fields])
    out: DataFrame = df.select(*[f"`{c}`" for c in [*rest, *flags, *ins]]).mapInArrow(run, schema)
    done = {n: F.when(F.col(f), F.struct(F.col(v).alias("v"))) for n, f, v in zip(names, flags, values, strict=True)}
    return line.with_df(out.withColumns(done).drop(*flags, *values))
