"""Reading and writing tables, tasks and selections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe import fixed_values as fixed
from tabprobe import schemas
from tabprobe.operators.ingest import first_tables
from tabprobe.operators.numbering import number_source_rows, source_order
from tabprobe.operators.selection import keep_listed
from tabprobe.operators.tasks import packed_by_table
from tabprobe.sources import idlists, versions


def read_raw(
    spark: SparkSession,
    path: str,
    split: str = "test",
    fmt: str = "json",
    schema: str | T.StructType | None = None,
) -> DataFrame:
    """Records of one ``split=...`` folder below ``path``, or of the fallback split.

    If the wanted split does not exist, 'train' is read instead, or 'test' if 'train'
    was asked for. The result carries its source order for ``ingest.parse_tables``.
    """
    fallback = "train" if split != "train" else "test"
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    jvm = spark.sparkContext._jvm
    for name in (split, fallback):
        folder = f"{path.rstrip('/')}/split={name}"
        hadoop_path = jvm.org.apache.hadoop.fs.Path(folder)
        if hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path):
            return source_order(reader.load(folder))
    raise FileNotFoundError(f"Neither split={split} nor split={fallback} below {path}")


def read_tables(
    spark: SparkSession, path: str, n_tables: int | None = None, multi_line: bool = False
) -> DataFrame:
    """Canonical table records (JSON lines, or one record per file) with ``pos``."""
    raw = source_order(
        spark.read.schema(schemas.TABLE_RECORD).option("multiLine", multi_line).json(path)
    )
    tables = number_source_rows(raw).select(
        F.col("id").alias("table_id"), "pos", "question", "answers", "header", "rows"
    )
    return first_tables(tables, n_tables)


def load_tables(spark: SparkSession, path: str, n_tables: int | None = None) -> DataFrame:
    """Tables written by ``write_tables``."""
    return first_tables(spark.read.schema(schemas.TABLES).parquet(f"{path}/tables"), n_tables)


def write_manifest(spark: SparkSession, path: str, fields: Mapping[str, object]) -> None:
    """One JSON object with the run's parameters and counts."""
    columns = {}
    for name, value in fields.items():
        if isinstance(value, Mapping):
            columns[name] = F.struct(*[F.lit(v).alias(k) for k, v in value.items()])
        elif isinstance(value, (list, tuple)):
            columns[name] = F.array(*[F.lit(v) for v in value])
        elif value is None:
            columns[name] = F.lit(None).cast("string")
        else:
            columns[name] = F.lit(value)
    row = spark.range(1, numPartitions=1).select(*[c.alias(n) for n, c in columns.items()])
    row.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_tables(
    tables: DataFrame,
    path: str,
    parameters: Mapping[str, object],
    as_json: bool = False,
) -> None:
    """tables/ (Parquet) and manifest/; with ``as_json`` also the interchange records.

    Files hold many tables each: one file per table would be millions of files.
    """
    tables.write.mode("overwrite").parquet(f"{path}/tables")
    written = tables.sparkSession.read.schema(schemas.TABLES).parquet(f"{path}/tables")
    if as_json:
        written.select(
            F.col("table_id").alias("id"), "question", "answers", "header", "rows"
        ).write.mode("overwrite").json(f"{path}/tables_json")
    by_size = bool(parameters.get("sort_by_size", False))
    write_manifest(
        tables.sparkSession,
        f"{path}/manifest",
        {
            **parameters,
            "n_tables": written.count(),
            "selection_mode": "largest_after_truncation" if by_size else "random_after_truncation",
        },
    )


def save_bucketed(df: DataFrame, name: str, buckets: int, key: str = "table_id", path: str | None = None) -> None:
    """Catalog table bucketed and sorted by key, below ``path`` if one is named: later joins on it need no exchange."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer if path is None else writer.option("path", path)).saveAsTable(name)


def read_tasks(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Task records (JSON lines), in source order, optionally only of known tables."""
    raw = source_order(spark.read.schema(schemas.TASKS).json(path))
    if ids is None:
        numbered = number_source_rows(raw, key=["table_id"], name="task_seq")
    else:
        # A table is known or not as a whole, so its numbers do not change: what is unknown goes before rows are sorted.
        # The ids are the side that is hashed.
        placed = raw.withColumn("_seq", F.monotonically_increasing_id())
        numbered = number_source_rows(keep_listed(placed, ids.hint("shuffle_hash")), key=["table_id"], name="task_seq", source=raw)
    return numbered.select("table_id", F.col("task_seq").cast("int"), "task", "question", "gold", "n_rows", "n_cols")


def write_tasks(tasks: DataFrame, path: str, seed: int, source: str, compression: str | None = None) -> None:
    """tasks/ (Parquet), tasks_by_table/ (JSON, one object per table, plain unless ``compression`` is named) and manifest/.

    Tasks are packed by table once, before anything is written: tasks that are dealt by their table, as ``generate_tasks`` leaves them, are not exchanged.
    The packs are stored beside the results while those are written from them.
    """
    spark = tasks.sparkSession
    packs = f"{path}/_packs"
    rest = [c for c in tasks.columns if c != "table_id"]
    tasks.groupBy("table_id").agg(F.collect_list(F.struct(*rest)).alias("_tasks")).write.mode("overwrite").parquet(packs)
    try:
        packed = spark.read.parquet(packs)
        packed.select("table_id", F.inline("_tasks")).select(*tasks.columns).write.mode("overwrite").parquet(f"{path}/tasks")
        packed_by_table(packed, "_tasks").write.mode("overwrite").json(f"{path}/tasks_by_table", compression=compression)
    finally:
        versions.remove(spark, packs)
    write_manifest(
        spark,
        f"{path}/manifest",
        {
            "source": source,
            "seed": seed,
            "n_task_rows": spark.read.parquet(f"{path}/tasks").count(),
            "tasks_per_table": fixed.TASKS_PER_TABLE,
        },
    )


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """(ord, table_id) from {"table_ids": [...]} or from a bare list, of any length; see ``idlists.read_ids``."""
    return idlists.read_ids(spark, path)


def write_selection(
    selected: DataFrame,
    diagnostics: DataFrame,
    path: str,
    model: str,
    formats: Sequence[str],
    max_prompt_tokens: int,
    n_tables_target: int,
) -> None:
    """selection/ (one JSON object in ordered parts) and diagnostics/ (one object per table)."""
    fields = {"model": model, "formats": list(formats), "max_prompt_tokens": max_prompt_tokens, "n_tables_target": n_tables_target}
    idlists.write_ids(selected, f"{path}/selection", fields, "n_tables_selected")
    diagnostics.write.mode("overwrite").json(f"{path}/diagnostics")


def read_choices(spark: SparkSession, path: str) -> DataFrame:
    """Multiple-choice records with ``pos`` in source order."""
    raw = source_order(spark.read.schema(schemas.CHOICES).json(path))
    return number_source_rows(raw).select("pos", "question", "choices")
