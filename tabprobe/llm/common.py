"""Helpers that the operators share: names, words, checks of size."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a longest run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a table whose size has been counted may be broadcast.
BROADCAST_ROWS = 100_000
#: Bytes of an Arrow batch where rows hold long binary values.
BATCH_BYTES = 8 << 20


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The row as one struct, so that its names cannot clash with an operator's own."""
    return F.struct(*[named(c) for c in (df.columns if columns is None else columns)])


def unpacked(row: str, columns: list[str], own: list[str]) -> list[Column]:
    """The fields of a packed row but for those that an operator's own columns replace."""
    taken = {c.lower() for c in own}
    return [named(row).getField(c).alias(c) for c in columns if c.lower() not in taken]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def whole_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8 with A-Z lower-cased: bytes.split() parts at the six characters, bytes.lower() changes A-Z only."""
    return text.encode().lower().split() if text else []


def training_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def shared_checkpoints(spark: SparkSession) -> None:
    """Use the folder that the cluster names; set one, beside the warehouse, only where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Compute once, keep in the shared folder, forget the lineage."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared checkpoint folder."""
    shared_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that one of this package's operators wrote for itself."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose rows have been counted, if they are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand rows to Python in Arrow batches of about ``BATCH_BYTES``, if the session's own limit is not less; it holds again after that.

    A batch lies in memory several times, in the executor and in the worker; ten thousand rows, the usual batch, may hold very long values.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    size = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before))
    if 0 < size <= BATCH_BYTES:
        yield
        return
    spark.conf.set(setting, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def giving_back(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same work for ``mapInArrow``, with free memory returned to the system at its end: Python workers live on, and others run beside them."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)

    return run
