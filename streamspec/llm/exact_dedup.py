"""Exact deduplication by a stateful stream, with DataFrame operations alone.

Rows arrive as (digest, identifier, locator) in a table of the shared folder, which a stream reads in
several batches. Its state is keyed by digest, lives in RocksDB on disk and never expires; a key
keeps the digest, the stable identifier of the row that stays and the locator (file and row) of its
content. Digests that were hit more than once are then checked on the full bytes of the text;
digests that different texts share, if there ever are any, are divided by the bytes.

With a folder for the state, the state outlives the call: a later call with the same folder streams
only its own rows, which meet the keys of all rows before. The verdicts are then about the rows of
that call, among all rows so far; what earlier rows hold is read again by their locators where a
digest is hit, so their files have to stay. Without a folder the state is dropped with the call.

The first aggregation combines within each task before rows move, so a text that a third of all
rows repeat costs a row for each task. Full texts move only to be compared, as one smallest and one
largest text for each digest and task.

Defined results: null counts as the empty text; empty texts equal each other; the row with the
smallest identifier stays, null identifiers last, and among rows with equal identifiers the first by
file and row, so exactly one row of a group has ``kept`` (with a lasting state, at most one in all
calls' last verdicts); an empty table gives an empty one; columns of the input with any other names
are ignored by ``deduplicate`` and kept by ``keep_first``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from streamspec.llm.common import WS, drop_path, exists, materialise, scratch

#: Up to so many repeated digests (of 32 bytes) the check of full bytes broadcasts them to skip all
#: other texts; beyond, it compares all texts.
BROADCAST_DIGESTS = 200_000
#: Batches that a call's rows are streamed in.
BATCHES = 2
#: The column that holds a row's place while an operator works; ``located`` tells another name where it is taken.
AT = "__streamspec_at"
#: What may be between files and a table whose rows are rows of the files, each once at most.
_ROW_BY_ROW = frozenset(("LogicalRelation", "Project", "Filter", "SubqueryAlias", "GlobalLimit", "LocalLimit", "Sort"))
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A store that stays open holds some 4 MB of disk; a partition's next batch loads it again.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as empty."""
    return F.coalesce(F.regexp_replace(text, WS, " "), F.lit(""))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    """Settings for the queries that start inside."""
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _row_by_row(plan) -> bool:
    """Whether each row of a plan is one row of a file, and no row of a file is there twice."""
    children = plan.children()
    if plan.getClass().getSimpleName() not in _ROW_BY_ROW or children.size() > 1:
        return False
    return all(_row_by_row(children.apply(i)) for i in range(children.size()))


def located(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the file and row that hold a row, and the name of that column. What is not read from
    files, or could hold a row of a file twice, is written first."""
    name, taken = AT, {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name)
    if _row_by_row(docs._jdf.queryExecution().analyzed()):
        try:
            return docs.select("*", at), name
        except AnalysisException:  # a file format without row numbers
            pass
    return materialise(docs, "located").select("*", at), name


def _schema(rows: DataFrame) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in rows.schema])


def arrivals(docs: DataFrame, at: str, id_col: str, text_col: str, digest: Callable[[Column], Column], folder: str) -> DataFrame:
    """What the stream reads: digest, identifier, locator of this call's rows, written to the folder."""
    rows = docs.select(digest(normalised(F.col(text_col))).alias("digest"), F.col(id_col).alias("id"), F.col(at).alias("at"))
    path = f"{folder}/arrivals/{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(_schema(rows)).parquet(path)


def told(spark: SparkSession, folder: str, kinds: StructType) -> DataFrame:
    """digest, keep (identifier and locator of the row that stays) and n, as the stream told them so
    far. A later batch tells a key's state anew: its row only gets smaller, its count larger."""
    path = f"{folder}/keepers"
    made = spark.read.schema(kinds).parquet(f"{path}/*") if exists(spark, path) else spark.createDataFrame([], kinds)
    return made.groupBy("digest").agg(F.min("keep").alias("keep"), F.max("n").alias("n"))


def _states(rows: DataFrame) -> DataFrame:
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "at"))
    return rows.groupBy("digest").agg(first.alias("keep"), F.count(F.lit(1)).alias("n"))


def stream(rows: DataFrame, folder: str, batches: int) -> None:
    """Streams what arrived in a folder through the state that is in it; rows are the latest arrivals,
    earlier ones are not read again."""
    spark = rows.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/keepers/{number}")

    files = max(1, -(-len(rows.inputFiles()) // batches))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/arrivals/*")
    with _conf(spark, _STATE):
        query = _states(source).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()


def _earlier(spark: SparkSession, places: DataFrame, docs: DataFrame, at: str, text_col: str) -> DataFrame:
    """at and text of rows of earlier calls by their locators; the files' names come to the driver, as
    those of any table that is read do."""
    own = docs.select(F.col(at)["file"].alias("file")).distinct()
    files = [r.file for r in places.select("at.file").distinct().join(own, "file", "left_anti").collect()]
    kind = docs.schema[at].dataType
    if not files:
        return spark.createDataFrame([], StructType([StructField("at", kind), StructField("text", StringType())]))
    held = spark.read.parquet(*files).select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"), F.col(text_col).alias("text"))
    return held.join(places.select("at").distinct(), "at", "left_semi")


def collisions(docs: DataFrame, text_col: str, hit: DataFrame, earlier: DataFrame | None, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests that different texts share, found by comparing full bytes wherever a digest was hit."""
    norm = normalised(F.col("text"))
    texts = docs.select(F.col(text_col).alias("text"))
    texts = texts if earlier is None else texts.unionByName(earlier.select("text"))
    texts = texts.select(digest(norm).alias("digest"), norm.cast("binary").alias("bytes"))
    if hit.count() <= BROADCAST_DIGESTS:
        texts = texts.join(F.broadcast(hit), "digest", "left_semi")
    extremes = texts.groupBy("digest").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
    return materialise(extremes.where(F.col("low") != F.col("high")).select("digest"), "collisions")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, state: str | None = None, batches: int = BATCHES) -> DataFrame:
    """A row for each row of docs: its identifier, digest, locator, and keep_id, group_size and kept.

    keep_id is the identifier of the row that stays. Another digest function than SHA-256 may be
    weaker: the check on full bytes keeps the result exact. state: a folder that keeps the state for
    later calls, each with rows of its own; they have to name the same columns and digest function.
    """
    return _deduplicate(*located(docs), id_col, text_col, digest, state, batches)


def _deduplicate(docs: DataFrame, at: str, id_col: str, text_col: str, digest: Callable[[Column], Column] = sha256, state: str | None = None, batches: int = BATCHES) -> DataFrame:
    """deduplicate for a table with its locators in the column at."""
    spark = docs.sparkSession
    folder = state or scratch(spark, "state")
    lasting = state is not None and exists(spark, f"{folder}/checkpoint")
    try:
        rows = arrivals(docs, at, id_col, text_col, digest, folder)
        kinds = _schema(_states(rows))
        before = told(spark, folder, kinds)  # the files that there are by now
        stream(rows, folder, batches)
        states = materialise(told(spark, folder, kinds), "keepers")
    finally:
        if state is None:
            drop_path(spark, f"{folder}/checkpoint")
            drop_path(spark, f"{folder}/keepers")
    hit, earlier = states.where("n > 1"), None
    if lasting:
        # Only what this call's rows hit, and the content of the row that stayed before.
        hit = materialise(hit.join(rows.select("digest").distinct(), "digest", "left_semi"), "hits")
        earlier = _earlier(spark, before.join(hit.select("digest"), "digest", "left_semi").select("keep.at"), docs, at, text_col)
    shared = collisions(docs, text_col, materialise(hit.select("digest"), "hits"), earlier, digest)
    if state is not None:
        # Later calls compare with the row that stays alone, so they have to know the digests of several texts.
        shared.write.mode("append").parquet(f"{folder}/shared")
        shared = spark.read.schema(_schema(shared)).parquet(f"{folder}/shared").distinct()
    if shared.isEmpty():
        return _verdicts(rows.join(states, "digest"))
    return _divided(docs, at, id_col, text_col, digest, rows, states, shared, folder if lasting else None)


def _verdicts(rows: DataFrame) -> DataFrame:
    return rows.select("id", "digest", "at", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("keep.at")).alias("kept"))


def _divided(docs: DataFrame, at: str, id_col: str, text_col: str, digest, rows: DataFrame, states: DataFrame, shared: DataFrame, folder: str | None) -> DataFrame:
    """deduplicate where some digests are shared: their rows are grouped by the bytes themselves."""
    norm, spark = normalised(F.col("text")), docs.sparkSession
    own = docs.select(F.col(at).alias("at"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    full = own.select(digest(norm).alias("digest"), norm.alias("bytes"), "id", "at").join(shared, "digest", "left_semi")
    every = full
    if folder:
        before = spark.read.schema(rows.schema).parquet(f"{folder}/arrivals/*").join(shared, "digest", "left_semi")
        held = _earlier(spark, before, docs, at, text_col)
        every = full.unionByName(before.join(held, "at").select("digest", norm.alias("bytes"), "id", "at"))
    keep = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "at")).alias("keep")
    groups = every.groupBy("digest", "bytes").agg(keep, F.count(F.lit(1)).alias("n"))
    rest = rows.join(shared, "digest", "left_anti").join(states, "digest")
    return _verdicts(rest).unionByName(_verdicts(full.join(groups, ["digest", "bytes"])))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that repeat the text of another one."""
    names = docs.columns
    docs, at = located(docs)
    dropped = materialise(_deduplicate(docs, at, id_col, text_col).where(~F.col("kept")).select(F.col("at").alias(at)), "dropped")
    return docs.join(dropped, at, "left_anti").select(*[F.col(f"`{n}`") for n in names])
