"""Sliding windows: the values of a stream in the time before each deadline.

A window of length D is D / 64 long panes; a value belongs to a deadline d if it is not later than d
and its pane is at most 63 before that of d. Panes are numbered in floating point by default, since
that is how results are defined; ``exact`` numbers them in whole nanoseconds.

There is no range join. A window is 63 whole panes and the part of its deadline's own pane that is
over by then. Values are first aggregated, with partial results in each task, by pane and, where a
deadline in the pane still sees them, by the first such deadline. The open part is a running merge
in the pane; whole panes are merged once for all deadlines of a pane, over a frame of 63 panes, in
slabs of panes that overlap by a frame. So the work follows the number of values, deadlines and
panes, whatever the period, and panes are merged from the oldest to the newest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from streamspec.analysis.checker import Window
from streamspec.lang.units import nanos
from streamspec.operators.temporal import back
from streamspec.operators.timeline import ORDER, Timeline

PANES = 64
#: Panes in a slab; each slab also gets the last panes of the one before.
SLAB = 4096


def seconds_of(ts: Column) -> Column:
    """Nanoseconds as seconds, the whole and the fraction added."""
    return F.call_function("div", ts, F.lit(10**9)).cast("double") + (ts % 10**9).cast("double") / 1e9


def pane(ts: Column, length: int, exact: bool) -> Column:
    """The number of the pane of a time."""
    if exact:
        return F.call_function("div", ts, F.lit(length))
    return F.floor(seconds_of(ts) / seconds_of(F.lit(length).cast("bigint"))).cast("bigint")


def _partial(function: str, v: Column, is_bool: bool) -> dict[str, Column]:
    """What is kept of the values of a pane."""
    number = v.cast("bigint") if is_bool else v
    return {
        "count": {"n": F.count(v)},
        "sum": {"n": F.count(v), "s": F.sum(number)},
        "avg": {"n": F.count(v), "s": F.sum(number)},
        "min": {"s": F.min(v)},
        "max": {"s": F.max(v)},
        "forall": {"s": F.bool_and(v)},
        "exists": {"s": F.bool_or(v)},
    }[function]


#: How partial results are merged: n, s and f of the functions.
_MERGE = {
    "count": {"n": F.sum},
    "sum": {"n": F.sum, "s": F.sum},
    "avg": {"n": F.sum, "s": F.sum},
    "min": {"s": F.min},
    "max": {"s": F.max},
    "forall": {"s": F.bool_and},
    "exists": {"s": F.bool_or},
    "integral": {"s": F.sum, "f": F.min},
}


def _both(merge, a: Column, b: Column) -> Column:
    """Two partial results as one; null is none."""
    if merge is F.sum:
        return F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).otherwise(a + b)
    return (F.least if merge in (F.min, F.bool_and) else F.greatest)(a, b)


def _partials(line: Timeline, target: str, window: Window) -> tuple[DataFrame, dict[str, Column]]:
    """The values of a stream with their times, and what is kept of several."""
    own, keys = F.col(f"`{target}`"), [F.col(f"`{k}`") for k in line.keys]
    if window.function != "integral":
        values = line.df.where(own.isNotNull()).select(*keys, "__ts", own["v"].alias("v"))
        return values, _partial(window.function, F.col("v"), window.source_type.kind == "Bool")
    line = back(line, target, 1, "__previous")
    line = back(line.with_df(line.df.withColumn("__time", F.when(own.isNotNull(), F.struct(F.col("__ts").alias("v"))))), "__time", 1, "__previous_time")
    step = (F.col("__ts") - F.col("__previous_time")["v"]).cast("double") / 1e9
    area = (own["v"].cast("double") + F.col("__previous")["v"].cast("double")) / 2 * step
    values = line.df.where(own.isNotNull()).select(*keys, *ORDER, F.coalesce(area, F.lit(0.0)).alias("v"))
    # The first value of a window has no part of the area before it.
    return values, {"s": F.sum("v"), "f": F.min(F.struct(*ORDER, "v"))}


def aggregate(line: Timeline, target: str, window: Window, period: int, exact: bool = False) -> DataFrame:
    """ts, keys and value of the deadlines (multiples of period); null where a window has no values."""
    length = max(1, nanos(window.duration) // PANES)
    names, merge = list(line.keys), _MERGE[window.function]
    values, partial = _partials(line, target, window)
    first = F.call_function("div", F.col("__ts") + (period - 1), F.lit(period))
    values = values.select("*", pane(F.col("__ts"), length, exact).alias("__pane"), first.alias("__j"))
    # Only deadlines in a value's own pane see the pane while it is open.
    seen = pane(F.col("__j") * period, length, exact) == F.col("__pane")
    groups = values.withColumn("__j", F.when(seen, F.col("__j"))).groupBy(*names, "__pane", "__j").agg(*[c.alias(n) for n, c in partial.items()])
    deadlines = line.df.where((F.col("__kind") == 1) & (F.col("__ts") % period == 0)).select(
        *names, pane(F.col("__ts"), length, exact).alias("__pane"), F.call_function("div", F.col("__ts"), F.lit(period)).alias("__j"), F.lit(True).alias("__due")
    )
    rows = groups.unionByName(deadlines, allowMissingColumns=True)
    rows = rows.groupBy(*names, "__pane", "__j").agg(*[f(n).alias(n) for n, f in merge.items()], F.max("__due").alias("__due"))
    # The open part of a deadline's own pane.
    over = Over.partitionBy(*names, "__pane").orderBy("__j").rowsBetween(Over.unboundedPreceding, Over.currentRow)
    opened = rows.where("__j IS NOT NULL").select(*names, "__pane", "__j", "__due", *[f(n).over(over).alias(f"open {n}") for n, f in merge.items()]).where("__due").drop("__due")
    # The whole panes before it.
    whole = rows.groupBy(*names, "__pane").agg(*[f(n).alias(n) for n, f in merge.items()], F.max("__due").alias("__due"))
    slab = F.call_function("div", F.col("__pane"), F.lit(SLAB))
    both = F.when(F.col("__pane") % SLAB > SLAB - PANES, F.array(slab, slab + 1)).otherwise(F.array(slab))
    whole = whole.withColumn("__slab", F.explode(both))
    frame = Over.partitionBy(*names, "__slab").orderBy("__pane").rangeBetween(1 - PANES, -1)
    whole = whole.select(*names, "__pane", "__slab", "__due", *[f(n).over(frame).alias(f"whole {n}") for n, f in merge.items()])
    whole = whole.where(F.col("__due") & (F.col("__slab") == slab)).drop("__due", "__slab")
    done = {n: _both(f, F.col(f"`whole {n}`"), F.col(f"`open {n}`")) for n, f in merge.items()}
    s, n = done.get("s"), done.get("n")
    match window.function:
        case "count":
            out = n
        case "avg":
            out = s / n if window.type.kind == "Float" else F.call_function("div", s, n)
        case "integral":
            out = s - done["f"]["v"]
        case _:
            out = s
    return opened.join(whole, [*names, "__pane"]).select(*names, (F.col("__j") * period).alias("__ts"), F.lit(1).alias("__kind"), out.alias("value"))


#: What a window without values gives; None for no value.
EMPTY = {"count": 0, "sum": 0, "integral": 0.0, "forall": True, "exists": False}


def value(window: Window, column: Column) -> Column:
    """The result of a window from its column, null where there were no values."""
    out = column
    if window.function in EMPTY:
        empty = EMPTY[window.function]
        kind = {"bool": "boolean", "int": "bigint", "float": "double"}[type(empty).__name__]
        if window.function == "sum" and window.type.kind == "Float":
            kind = "double"
        out = F.coalesce(column, F.lit(empty).cast(kind))
    return F.when(F.col("__ts") >= nanos(window.duration), out) if window.exactly else out
