"""Dense row numbers without pulling a whole key, or the whole table, into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.session import ensure_checkpoints

_ROW_BITS = (1 << 33) - 1


def number_rows(
    df: DataFrame, order_by: Sequence[str], key: Sequence[str] = (), name: str = "pos"
) -> DataFrame:
    """Add a zero-based position per key (or overall) in the order of ``order_by``.

    A distributed sort by key and order, in which one key may span many partitions. A
    row's place within its partition is known there; running sums of the partitions'
    counts, one slim row per key and partition, supply the offset. The sorted rows are
    checkpointed with their places, which therefore hold for both passes, also when an
    executor is lost.
    """
    ensure_checkpoints(df.sparkSession)
    key = list(key)
    order = [F.col(c) for c in [*key, *order_by]]
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumns(
            {"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit(_ROW_BITS))}
        )
        .drop("_at", name)
        .checkpoint()
    )
    group = [*key, "_part"]
    counts = placed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first")
    )
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"_g_{c}") for c in group],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"),
    )
    if not key:
        # One row per partition of the sort.
        offsets = F.broadcast(offsets)
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]
    return placed.join(offsets, same).select(
        *[c for c in df.columns if c != name],
        (F.col("_place") + F.col("_offset")).alias(name),
    )


def source_order(df: DataFrame) -> DataFrame:
    """Where each row of a file scan comes from: its file and the start of its split."""
    return df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")})


def number_source_rows(df: DataFrame, key: Sequence[str] = (), name: str = "pos", source: DataFrame | None = None) -> DataFrame:
    """Add a zero-based position, overall or per key, in the order of the files (by path) and of the rows in them.

    ``df`` comes from ``source_order``, filters included; ``_file`` and ``_block`` are dropped. Rows stay where they were read: a row's place in its split is known
    there, and the rows of all splits before it are a running sum over one count per split, which is broadcast: as many rows as the
    scan has tasks. So there is no sort, no exchange of rows, no checkpoint, and no job before the result is asked for;
    counting reads only the columns that earlier filters need.

    With ``key``, places are counted per key and split, so that a hot key is spread over its splits. There ``df`` may be what is left of ``source`` (which
    ``source_order`` gave) after whole keys were left out, with ``_seq``, the scan's ``monotonically_increasing_id``, added before: then only what is left is exchanged.
    """
    split = ["_file", "_block"]
    key = list(key)
    if key:
        # ids rise within a task, and a task reads a split from its start to its end
        marked = df.withColumn("_seq", F.monotonically_increasing_id()) if source is None else df
        placed = marked.withColumn("_place", F.row_number().over(Window.partitionBy(*key, *split).orderBy("_seq")) - 1)
        counts = (df if source is None else source).groupBy(*key, *split).agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(*key).orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*[F.col(c).alias(f"_g{c}") for c in [*key, *split]], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
        same = [F.col(c).eqNullSafe(F.col(f"_g{c}")) for c in [*key, *split]]
        joined = placed.join(offsets, same)
    else:
        placed = df.withColumn("_place", F.monotonically_increasing_id())
        counts = placed.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
        before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*split, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
        joined = placed.join(F.broadcast(offsets), split)
    own = [c for c in df.columns if c not in (*split, name) and (source is None or c != "_seq")]
    return joined.select(*own, (F.col("_place") + F.col("_offset")).alias(name))
