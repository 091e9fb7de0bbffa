"""CSV traces: a header names the inputs, ``#`` is no value, one column has the time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamspec.analysis.checker import Spec
from streamspec.analysis.types import Type
from streamspec.functions.columns import sql_type
from streamspec.sources.trace import Trace, delayed, from_columns, nanos_of

#: Names of the time column, in any case; the cell without a value.
TIME_COLUMNS = ("time", "ts", "timestamp")
NONE = "#"


def time_column(header: list[str], number: int | None = None) -> str | None:
    """The column with the time: by its number from 1 on, or by its name."""
    if number is not None:
        if not 1 <= number <= len(header):
            raise ValueError(f"there is no column {number}")
        return header[number - 1]
    return next((h for h in header if h.strip().lower() in TIME_COLUMNS), None)


def parsed(cell: Column, kind: Type, name: str) -> Column:
    """A cell as a value; cells that are none of the type are an error."""
    text = F.trim(cell)
    match kind.kind:
        case "Bool":
            value = F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))
        case "UInt":
            value = F.coalesce(F.expr(f"try_cast(trim(`{name}`) AS bigint)"), F.when(text.rlike(r"^0+\.0*$"), F.lit(0).cast("bigint")))
            value = F.when(value >= 0, value)
        case "Int":
            value = F.expr(f"try_cast(trim(`{name}`) AS bigint)")
        case "Float":
            value = F.expr(f"try_cast(trim(`{name}`) AS double)")
            value = F.when(~F.isnan(value), value)
        case "Bytes":
            value = cell.cast("binary")
        case "String":
            value = cell
        case _:
            raise ValueError(f"{name}: CSV files have no {kind}")
    wrong = F.raise_error(F.concat(F.lit(f"{name}: not a {kind}: "), cell)).cast(sql_type(kind))
    return F.when(text == NONE, F.lit(None)).otherwise(F.when(value.isNull(), wrong).otherwise(value))


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a file or folder of files with equal headers."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def read(spark: SparkSession, path: str, spec: Spec, number: int | None = None, delay: str | None = None, check_order: bool = True) -> Trace:
    """A trace from a CSV file. With delay, times are made up; otherwise they are in a column.

    Columns match inputs by name, further ones are not read.
    """
    names = header(spark, path)
    missing = [n for n in spec.inputs if n not in names]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    schema = ", ".join(f"`{n}` string" for n in names)
    raw = spark.read.schema(schema).option("header", True).option("nullValue", "\x00").option("emptyValue", "").option("ignoreTrailingWhiteSpace", True).csv(path)
    time = time_column(names, number)
    return typed(raw, spec, time, delay, check_order)


def typed(raw: DataFrame, spec: Spec, time: str | None, delay: str | None = None, check_order: bool = True) -> Trace:
    """A trace from a table of cells as text."""
    values = [parsed(F.col(f"`{n}`"), s.type, n).alias(n) for n, s in spec.inputs.items()]
    if delay is not None:
        return delayed(raw.select(*values), delay)
    if time is None:
        raise ValueError("no column has the time")
    made = raw.select(*values, nanos_of(F.col(f"`{time}`")).alias("__time"))
    trace = from_columns(made, F.col("__time"), check_order=check_order)
    return Trace(trace.df.drop("__time"), trace.start)
