"""Access to the past: the latest value, the k-th value before, running aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamspec.operators.timeline import CHUNK, ORDER, Timeline

#: Offsets up to this look back in one window, and chunks leave so many values; longer ones number the values.
NEAR = 4


def _earlier(line: Timeline):
    """The chunks before one, over one row for each chunk (of each key)."""
    own = Window.partitionBy(*line.keys) if line.keys else Window
    return own.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def _carried(line: Timeline, df: DataFrame, rest: DataFrame, how: str = "left") -> DataFrame:
    """df with what each chunk gets from those before it. Without keys that is a row for each of a
    bounded number of chunks; with keys both sides are partitioned by key and chunk already."""
    return df.join(rest if line.keys else F.broadcast(rest), line.parts, how)


def _at_ends(line: Timeline, streams: dict[str, Column]) -> DataFrame:
    """The last values of columns in each chunk (of each key): a row for each, found in a task for each. An
    aggregate would sort the rows of a whole split of the timeline, since its buffers are no numbers."""
    own = [F.col(f"`{p}`") for p in line.parts]
    few = line.with_df(line.df.select(*own, *ORDER, *[c.alias(n) for n, c in streams.items()]))
    over = line.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {n: F.last(F.col(f"`{n}`"), True).over(over) for n in streams}
    rows = few.dealt().withColumns({**last, "__end": F.lead(F.lit(True)).over(line.window()).isNull()})
    return rows.where("__end").select(*own, *[F.col(f"`{n}`") for n in streams])


def latest(line: Timeline, streams: dict[str, Column], before: bool = False) -> Timeline:
    """Adds columns with the latest value of struct columns, at a row or before it; names to columns."""
    if not streams:
        return line
    end = -1 if before else Window.currentRow
    over = line.window().rowsBetween(Window.unboundedPreceding, end)
    local = {n: F.last(c, True).over(over) for n, c in streams.items()}
    if line.chunks == 1:
        return line.with_df(line.df.withColumns(local))
    line = line.settled()
    rest = _at_ends(line, streams).select(*line.parts, *[F.last(F.col(f"`{n}`"), True).over(_earlier(line)).alias(f"__c {n}") for n in streams])
    df = _carried(line, line.dealt().withColumns(local), rest)
    df = df.withColumns({n: F.coalesce(F.col(f"`{n}`"), F.col(f"`__c {n}`")) for n in streams}).drop(*[f"__c {n}" for n in streams])
    return line.with_df(df)


def _near(line: Timeline, stream: str, steps: int, name: str) -> Timeline:
    """back for few steps: one window, however many steps, over rows that need no other order."""
    own = F.col(f"`{stream}`")
    by = ", ".join(f"`{p}`" for p in line.parts) or "0"
    here = F.expr(f"lag(`{stream}`, {steps}) IGNORE NULLS OVER (PARTITION BY {by} ORDER BY {', '.join(ORDER)})")
    if line.chunks == 1:
        df = line.df.withColumn(name, here)
        return line.with_df(df.withColumn(name, F.when(own.isNotNull(), F.col(f"`{name}`"))))
    # What is not in a row's own chunk is among the last values of so many chunks with values before it.
    line = line.settled()
    few = line.with_df(line.df.where(own.isNotNull()).select(*[F.col(f"`{p}`") for p in line.parts], *ORDER, own.alias("__o")))
    newest = Window.partitionBy(*line.parts).orderBy(*[F.col(c).desc() for c in ORDER])
    ends = few.dealt().withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= steps)
    per = ends.groupBy(*line.parts).agg(F.array_sort(F.collect_list(F.struct("__r", "__o"))).alias("__o"))
    before = (Window.partitionBy(*line.keys) if line.keys else Window).orderBy(CHUNK).rowsBetween(-steps, -1)
    rest = per.select(*line.parts, F.flatten(F.reverse(F.collect_list("__o").over(before))).alias("__left"))
    count = F.count(own).over(line.window().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = _carried(line, line.dealt().withColumns({name: here, "__k": count}), rest)
    left = F.get("__left", (F.lit(steps) - F.col("__k")).cast("int"))["__o"]
    df = df.withColumn(name, F.when(own.isNotNull(), F.coalesce(F.col(f"`{name}`"), left)))
    return line.with_df(df.drop("__left", "__k"))


def back(line: Timeline, stream: str, steps: int, name: str) -> Timeline:
    """Adds a column with the value that a struct column had steps values before, at its own rows."""
    own = F.col(f"`{stream}`")
    if steps <= NEAR:
        return _near(line, stream, steps, name)
    if line.chunks == 1:
        here = F.lag(own, steps).over(line.window(own.isNotNull()))
        return line.with_df(line.df.withColumn(name, F.when(own.isNotNull(), here)))
    # Values are numbered over all chunks; each row is joined with the number that it looks back to.
    line = line.settled()
    counted = line.df.groupBy(*line.parts).agg(F.count(own).alias("__n"))
    earlier = counted.select(*line.parts, F.coalesce(F.sum("__n").over(_earlier(line)), F.lit(0)).alias("__before"))
    local = F.count(own).over(line.window().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = _carried(line, line.dealt().withColumn("__k", local), earlier, "inner")
    df = df.withColumn("__k", F.when(own.isNotNull(), F.col("__k") + F.col("__before"))).drop("__before")
    past = df.where(own.isNotNull()).select(*line.keys, (F.col("__k") + steps).alias("__k"), own.alias(name))
    return line.with_df(df.join(past, [*line.keys, "__k"], "left").drop("__k"))


def running(line: Timeline, values: dict[str, tuple[Column, str]]) -> Timeline:
    """Adds columns with running aggregates of columns, null ones left out. Functions: sum, min, max,
    count, last; the columns are null before the first value."""
    functions = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    over = line.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def agg(f: str, c: Column) -> Column:
        return F.last(c, True) if f == "last" else functions[f](c)

    if line.chunks == 1:
        return line.with_df(line.df.withColumns({n: agg(f, c).over(over) for n, (c, f) in values.items()}))
    line = line.settled()
    lasts, sums = {n: c for n, (c, f) in values.items() if f == "last"}, {n: functions[f](c) for n, (c, f) in values.items() if f != "last"}
    per = line.df.groupBy(*line.parts).agg(*[c.alias(n) for n, c in sums.items()]) if sums else _at_ends(line, lasts)
    if sums and lasts:
        per = per.join(_at_ends(line, lasts), line.parts)
    merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, True)}
    rest = per.select(*line.parts, *[merge[f](F.col(f"`{n}`")).over(_earlier(line)).alias(f"__c {n}") for n, (_, f) in values.items()])
    df = _carried(line, line.dealt().withColumns({n: agg(f, c).over(over) for n, (c, f) in values.items()}), rest)
    both = {}
    for n, (_, f) in values.items():
        a, b = F.col(f"`{n}`"), F.col(f"`__c {n}`")
        both[n] = {
            "sum": F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).otherwise(a + b),
            "count": F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
            "min": F.least(a, b), "max": F.greatest(a, b), "last": F.coalesce(a, b),
        }[f]
    return line.with_df(df.withColumns(both).drop(*[f"__c {n}" for n in values]))
