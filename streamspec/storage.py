"""Tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir`` of the session. Only where none is set and all of Spark runs in
one process, as in tests, it is a temporary one of this machine: on a cluster each executor would
write to its own disk, so that is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not (master.startswith("local[") and master.endswith("]")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="streamspec-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/streamspec/{name}-{uuid.uuid4().hex}"


def _in_store(spark: SparkSession, path: str):
    """A path and the store that it is in, through Hadoop."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder, whatever store it is in."""
    p, store = _in_store(spark, path)
    store.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p, store = _in_store(spark, path)
    return store.exists(p)


def clear(spark: SparkSession) -> None:
    """Deletes all scratch tables of a shared folder. Call it when no result of any query is read any more."""
    drop_path(spark, f"{shared_dir(spark)}/streamspec")
    for table in spark.catalog.listTables():
        if table.name.startswith("streamspec_"):
            spark.sql(f"DROP TABLE IF EXISTS `{table.name}`")


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df, written once to the shared folder and read back: later uses neither recompute it nor
    depend on the executors that made it, and its size is known to the planner."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[made] = path
    return made


#: Where the tables of materialise are.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of materialise that no result reads any more; others are left alone."""
    for df in tables:
        if df is not None and (path := _WRITTEN.pop(df, None)):
            drop_path(df.sparkSession, path)
