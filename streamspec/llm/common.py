"""Helpers that the operators share: written tables, Arrow batches, remembered results."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamspec.storage import discard, drop_path, exists, materialise, scratch

__all__ = ["WS", "Memo", "bucketed", "crc_bucket", "discard", "drop_path", "exists", "map_rows", "materialise", "scratch", "texts_of"]

#: ASCII white space, as the contracts define it, for Java's and Python's regular expressions.
WS = r"[\x20\x09-\x0D]+"


def bucketed(df: DataFrame, buckets: int, key: str, name: str) -> DataFrame:
    """df, written once to the shared folder by hash buckets of key, and read back: a join on key
    then moves only the other side."""
    table = f"streamspec_{name}_{uuid.uuid4().hex}"
    df.write.option("path", scratch(df.sparkSession, name)).option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """An Arrow string column as Python strings, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str | object, step: int = 256) -> DataFrame:
    """df through a Python function of Arrow batches.

    make() runs once in each task and returns the function, which turns a batch of at most
    step rows into columns. Small steps bound the memory that very long texts take.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                yield pa.RecordBatch.from_pydict(fn(batch.slice(at, step)))

    return df.mapInArrow(run, schema)


def crc_bucket(column, modulus: int):
    """crc32 of the identifier written as text, modulo modulus."""
    return F.pmod(F.crc32(column.cast("string")), F.lit(modulus))


class Memo(dict):
    """What a function gave for an argument, kept for the first `most` arguments."""

    def __init__(self, fn: Callable, most: int = 200_000):
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, key):
        value = self.fn(key)
        if len(self) < self.most:
            self[key] = value
        return value
