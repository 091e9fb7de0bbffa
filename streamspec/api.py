"""The library's front door."""

from __future__ import annotations

from pyspark.sql import SparkSession

from streamspec.analysis.checker import Spec, check
from streamspec.lang.diagnostics import SpecError
from streamspec.lang.parser import parse
from streamspec.plans.batch import Result, evaluate
from streamspec.sources import csv
from streamspec.sources.trace import Trace, from_columns

__all__ = ["Result", "Spec", "SpecError", "Trace", "check", "evaluate", "from_columns", "monitor_csv", "parse"]


def monitor_csv(spark: SparkSession, spec: str, path: str, time_column: int | None = None, delay: str | None = None) -> tuple[Result, int]:
    """Runs a specification over a CSV file; the result and the time of the first event."""
    checked = check(spec)
    trace = csv.read(spark, path, checked, time_column, delay)
    return evaluate(checked, trace.df), trace.start
