"""Guesses the schema of a trace: which types the cells of each column can be, and which columns can be clocks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Candidate types and what a cell must look like, with {c} for the cell.
CANDIDATES = {
    "Bool": "{c} IN ('true', 'false')",
    "Int64": "{c} RLIKE '^[+-]?[0-9]+$' AND try_cast({c} AS bigint) IS NOT NULL",
    "UInt64": "{c} RLIKE '^[+]?[0-9]+$' AND try_cast({c} AS decimal(20,0)) BETWEEN 0 AND 18446744073709551615",
    "Float64": "{c} RLIKE '^[ +-]*([0-9.]|[iI][nN])' AND try_cast({c} AS double) IS NOT NULL AND NOT isnan(try_cast({c} AS double))",
    "String": "true",
}


def instant(cell: str) -> str:
    """SQL for a time as text: whole nanoseconds, seconds with decimals, or a date and time; nanoseconds."""
    return (
        f"CASE WHEN {cell} RLIKE '[0-9]' THEN coalesce(CASE WHEN {cell} RLIKE '^[0-9]+$' THEN try_cast({cell} AS decimal(38,9)) END, "
        f"try_cast({cell} AS decimal(28,9)) * 1000000000, "
        f"CAST(unix_micros(try_cast({cell} AS timestamp)) AS decimal(28,0)) * 1000) END"
    )


def infer(cells: DataFrame, order: Column | None = None, chunk: int = 1_000_000) -> DataFrame:
    """column, types and clock for each column of cells as text; ``#`` and null are no value.

    One aggregation tells the types, and which columns hold nothing but times. Only for those, on
    narrow rows, are neighbours compared, in chunks of the order (a whole number, by default the order
    of the rows), and the chunks' first and last times.
    """
    spark, names = cells.sparkSession, cells.columns
    aggs = []
    for i, n in enumerate(names):
        there = F.col(f"`{n}`").isNotNull() & (F.col(f"`{n}`") != "#")
        for kind, test in CANDIDATES.items():
            if kind != "String":
                aggs.append(F.coalesce(F.bool_and(F.when(there, F.expr(test.format(c=f"`{n}`")))), F.lit(True)).alias(f"{i} {kind}"))
        aggs.append(F.coalesce(F.bool_and(there & F.expr(instant(f"`{n}`")).isNotNull()), F.lit(False)).alias(f"{i} time"))
    told = cells.agg(*aggs).first()
    timed = [i for i in range(len(names)) if told[f"{i} time"]]
    rising = _rising(cells, order, chunk, [names[i] for i in timed]) if timed else {}
    rows = [(n, [k for k in CANDIDATES if k == "String" or told[f"{i} {k}"]], rising.get(n, False)) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "`column` string, types array<string>, clock boolean")


def _rising(cells: DataFrame, order: Column | None, chunk: int, names: list[str]) -> dict[str, bool]:
    """Whether the times of columns rise strictly in the order of the rows."""
    at = F.monotonically_increasing_id() if order is None else order
    rows = cells.select(at.alias("__order"), *[F.expr(instant(f"`{n}`")).alias(f"t{i}") for i, n in enumerate(names)])
    rows = rows.withColumn("__chunk", F.shiftright("__order", 33) if order is None else F.call_function("div", F.col("__order"), F.lit(chunk)))
    over, times = Window.partitionBy("__chunk").orderBy("__order"), [f"t{i}" for i in range(len(names))]
    rows = rows.withColumns({f"r{t}": F.coalesce(F.col(t) > F.lag(t).over(over), F.lit(True)) for t in times})
    per = rows.groupBy("__chunk").agg(*[x for t in times for x in (F.bool_and(f"r{t}").alias(f"r{t}"), F.min(t).alias(f"first {t}"), F.max(t).alias(f"last {t}"))])
    chunks = Window.orderBy("__chunk")  # a row for each chunk
    steps = per.select(*[(F.col(f"r{t}") & F.coalesce(F.col(f"first {t}") > F.lag(f"last {t}").over(chunks), F.lit(True))).alias(t) for t in times])
    one = steps.agg(*[F.bool_and(t).alias(t) for t in times]).first()
    return {n: bool(one[f"t{i}"]) for i, n in enumerate(names)}


def describe(spark: SparkSession, path: str) -> str:
    """JSON about a CSV file: its kind, its digest, the candidate types and clocks of its columns."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    found = infer(raw).collect()  # a row for each column
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 512)).first()[0]
    return json.dumps({
        "kind": "csv", "sha512": digest,
        "streams": [{"name": r["column"], "types": r["types"]} for r in found],
        "clocks": [r["column"] for r in found if r["clock"]],
    })
