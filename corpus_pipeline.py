"""A corpus from documents to packed sequences: five stages, each on all that the one before kept.

Defined results: null and empty texts, and texts of fewer words than the rules ask for, go in the
first stage; of documents with equal texts, and of near duplicates, the one with the smallest
identifier stays (null last, then the first by file and row), so repeated rows leave one; very long
texts are read whole by every stage and cut only into pieces; a row with a null identifier is a
document like any other; an empty table gives no pieces; further columns, whatever their names, go
through all stages but the last and change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from streamspec.llm import exact_dedup, near_dedup, packing, pii, quality_rules
from streamspec.llm.common import discard, materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the first stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by shingles of five words at 0.8, the first stays."""
    return near_dedup.keep_one(docs, k=5, percent=80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the names of its kinds."""
    return pii.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    import public_tokenizers

    placed = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("pii", private),
    ("packing", pack),
]

#: SQL cannot tokenise, so the pipeline is tested against a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return docs
