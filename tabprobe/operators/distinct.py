"""Evaluating something expensive once per distinct text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of all texts, at most this many are dealt over several tasks; any other one has less than a thousandth of the rows.
MOST_HOT = 1_000


def evaluate_distinct(
    df: DataFrame,
    text: str,
    evaluate: Callable[[Column], Column],
    output: str,
    copies: str | None = None,
    hot_rows: int = 100_000,
    spread: int = 64,
) -> DataFrame:
    """Add ``evaluate(text)`` as ``output``, with each distinct text evaluated once; ``copies`` also adds how many rows have it.

    Equal texts meet in an aggregation that combines map-side, so a text is sent once per task. Values go back by digest (sha-256). A
    text of more than ``hot_rows`` rows has its value ``spread`` times, and its rows are dealt by the task that reads them: no task
    gets all of them. ``df`` is read twice and must not change in between; store it first if it is costly. NULL texts are not evaluated: their
    value is NULL and they count no copies. Repeated rows stay; an empty table stays empty.
    """
    inner = df.withColumn("_digest", F.sha2(F.col(text), 256))
    counted = df.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("_text")).agg(F.count(F.lit(1)).alias("_copies"))
    digest = F.sha2(F.col("_text"), 256).alias("_digest")
    hot = counted.select(digest, "_copies").filter(F.col("_copies") > hot_rows)
    # a bounded list: rows of a hot text learn that it is one without being moved
    hot = hot.orderBy(F.desc("_copies"), "_digest").limit(MOST_HOT).select(F.col("_digest").alias("_hot"))
    values = counted.select(digest, "_copies", evaluate(F.col("_text")).alias("_value"))
    parts = F.sequence(F.lit(0), F.when(F.col("_hot").isNotNull(), spread - 1).otherwise(0))
    values = values.join(F.broadcast(hot), F.col("_digest") == F.col("_hot"), "left").withColumn("_part", F.explode(parts)).drop("_hot")
    # any part of a hot text holds its value, so the part need not be the same when a task is run again
    # rows without a text find nothing, and are dealt as well
    many = F.col("_hot").isNotNull() | F.col("_digest").isNull()
    dealt = inner.join(F.broadcast(hot), F.col("_digest") == F.col("_hot"), "left").withColumn(
        "_part", F.when(many, F.pmod(F.spark_partition_id(), F.lit(spread))).otherwise(0)
    )
    # rows without a text keep to the task that reads them as well
    found = dealt.join(values, ["_digest", "_part"], "left").withColumn(output, F.col("_value"))
    if copies:
        found = found.withColumn(copies, F.coalesce("_copies", F.lit(0)))
    return found.select(*[c for c in df.columns if c not in (output, copies)], output, *([copies] if copies else []))
