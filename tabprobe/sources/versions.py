"""Data sets that are replaced as a whole: staged versions and a pointer that readers follow.

Spark's overwrite deletes what is there before it writes, so a run that dies in between leaves nothing. Here the new data is written beside the old,
and only then does a small file, renamed over its predecessor in one step, name the new version. A reader that has begun with the old
version finishes with it: the version before the current one stays until the next replacement.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


def _filesystem(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version; None if nothing has been committed."""
    place, fs = _filesystem(spark, f"{path}/{POINTER}")
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return f"{path}/{name}"


def _point(spark: SparkSession, path: str, name: str) -> None:
    """Make ``name`` the current version, in one rename."""
    jvm = spark.sparkContext._jvm
    staged, fs = _filesystem(spark, f"{path}/{POINTER}.{uuid.uuid4().hex}")
    stream = fs.create(staged, True)
    try:
        stream.write(bytearray(name.encode()))
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    target, _ = _filesystem(spark, f"{path}/{POINTER}")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(staged, target, over)


def replace(df: DataFrame, path: str, fmt: str = "parquet", **options) -> str:
    """Write ``df`` as the next version below ``path`` and make it the current one; returns its folder.

    ``df`` may read the version it replaces. Versions that are neither current nor the one before are removed, staged ones of dead runs included.
    Two writers at a time are not meant: the one that points last wins.
    """
    spark = df.sparkSession
    before = current(spark, path)
    name = f"v-{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).save(f"{path}/{name}")
    _point(spark, path, name)
    kept = {name, before.rsplit("/", 1)[-1] if before else None, POINTER}
    folder, fs = _filesystem(spark, path)
    for entry in fs.listStatus(folder):
        if entry.getPath().getName() not in kept and entry.getPath().getName().startswith("v-"):
            fs.delete(entry.getPath(), True)
    return f"{path}/{name}"


def load(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """The current version."""
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no version has been committed below {path}")
    reader = spark.read.format(fmt).options(**options)
    return (reader if schema is None else reader.schema(schema)).load(folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a whole folder."""
    place, fs = _filesystem(spark, path)
    fs.delete(place, True)
