"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII capitals and their lower-case forms.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Fixed value: a word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a temporary folder is used in local mode
    only; on a cluster that would be machine-local, so it is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="rankweave-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/rankweave-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Cuts the lineage, so a lost executor costs a reread and not a rerun.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a small table that one task takes.
EACH = 20_000


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, made from about ``rows`` rows, in as many tasks as these need; with more rows than all tasks would take, nothing changes."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // EACH))
    return df.coalesce(n) if n < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; ``lower`` alone is the same on pure ASCII, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cuts(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to ``most``, about; a larger row stands alone at the worst."""
    at = np.flatnonzero(np.diff(size.cumsum() // most)) + 1
    ends = [*at.tolist(), len(size)]
    return ((i, j) for i, j in zip([0, *at.tolist()], ends) if i < j)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of a text or list column."""
    for batch in batches:
        c = batch.column(column)
        length = pc.list_value_length(c) if pa.types.is_list(c.type) else pc.binary_length(c)
        for i, j in cuts(length.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), most):
            yield batch.slice(i, j - i)


#: Slots over which the rows of a large group are dealt where a figure of the group is joined back.
SLOTS = 64


def slot_of(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SLOTS)).cast("int")


def occupied(slot: str) -> Column:
    """Aggregate: the set of slots that a group's rows lie in, as bits of a long."""
    return F.bit_or(F.expr(f"shiftleft(1L, {slot})"))


def each_slot(bits: str) -> Column:
    """A row per slot of the set; on key and slot it meets the group's rows, which stay dealt out."""
    return F.explode(F.expr(f"filter(sequence(0, {SLOTS - 1}), s -> (shiftrightunsigned({bits}, s) & 1L) = 1L)"))


def fresh_names(taken: list[str], *names: str) -> list[str]:
    """Names like ``names`` that none of the columns ``taken`` has, in whatever case."""
    lower = {c.lower() for c in taken}
    mark = "_"
    while any(f"{mark}{n}".lower() in lower for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def fixed_bytes(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of values of one width as a matrix of bytes."""
    fixed = column.cast(pa.binary(width))
    return np.frombuffer(fixed.buffers()[1], np.uint8)[fixed.offset * width : (fixed.offset + len(fixed)) * width].reshape(-1, width)


def from_fixed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as a binary column."""
    n, width = rows.shape
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())
