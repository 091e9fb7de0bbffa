"""Traces: events in order, from any DataFrame.

A trace has ``__ts`` (nanoseconds since the first event), ``__seq`` (order among events at the same
time) and a column for each input, null where an event has no value.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamspec.lang.units import NANOS, seconds
from streamspec.storage import materialise


@dataclass
class Trace:
    """Events, and the time of the first one in nanoseconds, which absolute times are counted from."""

    df: DataFrame
    start: int = 0


def nanos_of(column: Column) -> Column:
    """Times as text to nanoseconds: seconds with up to 9 decimals; whole numbers are nanoseconds."""
    text = F.trim(column)
    part = F.split(text, r"\.")
    whole, frac = F.element_at(part, 1), F.element_at(part, 2)
    digits = F.rpad(F.substring(frac, 1, 9), 9, "0").cast("bigint")
    return F.when(F.size(part) == 1, whole.cast("bigint")).otherwise(F.when(whole == "", F.lit("0")).otherwise(whole).cast("bigint") * NANOS + digits)


def duration(text: str) -> int:
    """A duration such as 100ms in nanoseconds; several add up: 1min 30s."""
    import re

    total = Fraction(0)
    parts = re.findall(r"([0-9]+(?:\.[0-9]+)?)\s*([^\W\d_]+)", text)
    if not parts or re.sub(r"[0-9.]+\s*[^\W\d_]+|\s", "", text):
        raise ValueError(f"{text!r} is no duration")
    for number, unit in parts:
        s = seconds(Fraction(number), {"sec": "s", "m": "min", "usec": "us", "msec": "ms", "nsec": "ns"}.get(unit, unit))
        if s is None:
            raise ValueError(f"{unit!r} is no unit of time")
        total += s
    return int(total * NANOS)


def _part(order: str) -> Column:
    """The partition in which monotonically_increasing_id numbered a row."""
    return F.shiftright(F.col(order), 33)


def _rises(rows: DataFrame) -> DataFrame:
    """rows with an error where __ts is less than in the row before, in the order of __seq.

    Neighbours are compared in each partition, partitions by one row for each of them.
    """
    per = rows.groupBy(_part("__seq").alias("p")).agg(F.min_by("__ts", "__seq").alias("first"), F.max("__ts").alias("most"))
    before = F.max("most").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    if not per.select((F.col("first") < before).alias("back")).where("back").isEmpty():
        raise ValueError("time goes back")
    before = F.lag("__ts").over(Window.partitionBy(_part("__seq")).orderBy("__seq"))
    return rows.withColumn("__ts", F.when(before > F.col("__ts"), F.raise_error(F.lit("time goes back")).cast("bigint")).otherwise(F.col("__ts")))


def from_columns(df: DataFrame, time: Column, order: list[Column] | None = None, relative: bool = True, check_order: bool = False) -> Trace:
    """A trace from a table: time in nanoseconds as a column, order among equal times.

    Without an order equal times are taken in the order of the rows, which is only defined for a
    single file. check_order makes a row earlier than the one before it, in that order, an error.
    """
    raw = F.monotonically_increasing_id() if order is None else F.struct(*order)
    rows = df.withColumns({"__ts": time.cast("bigint"), "__seq": raw})
    if order is not None:
        rows = rows.withColumn("__seq", F.row_number().over(Window.partitionBy("__ts").orderBy("__seq")).cast("bigint"))
    elif check_order:
        rows = _rises(rows)
    start = 0
    if relative:
        start = rows.agg(F.min("__ts")).first()[0] or 0
        rows = rows.withColumn("__ts", F.col("__ts") - F.lit(start))
    return Trace(rows, start)


def delayed(df: DataFrame, delay: str, order: list[Column] | None = None) -> Trace:
    """A trace with a clock of its own: events come delay after each other, the first one at delay.

    Rows are numbered in their partitions; a row for each partition tells what came before. An order
    is a sort, whose result is written so that both see the same partitions.
    """
    rows = df if order is None else df.orderBy(*order)
    rows = rows.withColumn("__seq", F.monotonically_increasing_id())
    if order is not None:
        rows = materialise(rows, "ordered")
    rows = rows.withColumn("__part", _part("__seq"))
    counts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = F.broadcast(counts.select("__part", before.alias("__before")))  # a row for each partition of the input
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__seq"))
    rows = rows.join(counts, "__part").withColumn("__seq", (F.col("__before") + own).cast("bigint")).drop("__part", "__before")
    return Trace(rows.withColumn("__ts", F.col("__seq") * duration(delay)))
