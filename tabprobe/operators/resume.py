"""Incremental runs: what is pending, what is kept, which version wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe import fixed_values as fixed
from tabprobe.functions.text import row_key, unescape_newlines


def _keyed(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.withColumn("_key", row_key(*[F.col(c) for c in key]))


def _keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    # distinct() combines map-side, so a key repeated millions of times is sent once per task.
    return _keyed(df, key).select("_key").distinct()


def pending(
    target: DataFrame, done: DataFrame, key: Sequence[str] = tuple(fixed.INSTANCE_KEY)
) -> DataFrame:
    """Target rows whose key is not done yet (null-safe)."""
    return _keyed(target, key).join(_keys(done, key), "_key", "left_anti").drop("_key")


def keep_wanted(
    existing: DataFrame, target: DataFrame, key: Sequence[str] = tuple(fixed.INSTANCE_KEY)
) -> DataFrame:
    """Existing rows that are still in the target set."""
    return _keyed(existing, key).join(_keys(target, key), "_key", "left_semi").drop("_key")


def carry_over(
    existing: DataFrame,
    target: DataFrame,
    key: Sequence[str] = tuple(fixed.INSTANCE_KEY),
    keep_stale: bool = False,
) -> DataFrame:
    """Rows to carry into the next run; ``keep_stale`` keeps those no longer wanted, too."""
    return existing if keep_stale else keep_wanted(existing, target, key)


def combine(kept: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both; columns that one side lacks are NULL there."""
    return kept.unionByName(new, allowMissingColumns=True)


def merge_latest(versions: DataFrame, key: Sequence[str], version: Sequence[str]) -> DataFrame:
    """One row per key: the one with the highest version.

    Ties are broken by the remaining columns so that re-runs agree. The rank limit is
    applied before the shuffle, so a key with very many versions stays cheap.
    """
    rest = [c for c in versions.columns if c not in (*key, *version)]
    newest = Window.partitionBy(*key).orderBy(
        *[F.col(c).desc() for c in version], *[F.col(c).desc() for c in rest]
    )
    return (
        versions.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") == 1).drop("_rn")
    )


def succeeded(rows: DataFrame) -> DataFrame:
    """Rows whose call did not fail: what counts as done."""
    return rows.filter(F.col("error").isNull()) if "error" in rows.columns else rows


def settled(rows: DataFrame, key: Sequence[str] = tuple(fixed.INSTANCE_KEY)) -> DataFrame:
    """A run's rows with failures that were made good left out; of repeated failures, one row stays."""
    if "error" not in rows.columns:
        return rows
    failed = merge_latest(rows.filter(F.col("error").isNotNull()), key, ["error"])
    return succeeded(rows).unionByName(pending(failed, succeeded(rows), key))


def judgeable(predictions: DataFrame, target_field: str = "raw", unescape: bool = False) -> DataFrame:
    """Rows a judge should see: everything but those marked as skipped and those whose call failed."""
    column = F.col(target_field).cast("string")
    if unescape:
        predictions = predictions.withColumn(target_field, unescape_newlines(column))
    if "error" in predictions.columns:
        predictions = predictions.filter(F.col("error").isNull())
    return predictions.filter(~F.coalesce(column.startswith(fixed.SKIP_PREFIX), F.lit(False)))


def run_counts(target: DataFrame, done: DataFrame, key: Sequence[str], target_field: str = "raw") -> DataFrame:
    """One row: total, pending and skipped rows of the target."""
    counted = _keyed(target, key).join(_keys(done, key).withColumn("_done", F.lit(True)), "_key", "left")
    is_pending = F.col("_done").isNull()
    skipped = (
        F.col(target_field).startswith(fixed.SKIP_PREFIX) if target_field in target.columns else F.lit(False)
    )
    return counted.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(is_pending).alias("n_pending"),
        F.count_if(is_pending & skipped).alias("n_skipped"),
    )
