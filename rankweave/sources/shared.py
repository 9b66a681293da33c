"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Tasks for each core of the cluster among which rows are dealt whose work takes far longer than their reading.
TASKS_A_CORE = 4


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, deleted when the driver's JVM ends.

    Where the session names no such folder, a temporary one is used in local
    mode only: on a cluster every executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rankweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/rankweave-{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def kept(df: DataFrame, name: str, after: Sequence[DataFrame] = ()) -> DataFrame:
    """``df`` written once as Parquet and read back: what follows reads it instead of making it again, and a lost executor costs a reread.

    The tables ``after`` which it comes, made by ``kept`` themselves and not read
    any more once it is written, are deleted: rounds don't pile up tables.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    for old in after:
        release(old)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over TASKS_A_CORE tasks a core, for work that takes far longer than reading: a small file, well packed, is read by few."""
    return df.repartition(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)


def release(df: DataFrame) -> None:
    """Deletes the folder of a table that ``kept`` made; other tables' files stay."""
    context = df.sparkSession.sparkContext
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if folder.rsplit("/", 1)[-1].startswith("rankweave-"):
            where = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
