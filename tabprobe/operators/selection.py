"""Restricting and ordering tables by a list of ids; length budgets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe import fixed_values as fixed
from tabprobe.session import ensure_checkpoints

UNLISTED = 10**9


def keep_listed(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose table_id is in ``ids``. Spark broadcasts the list only if it measures small."""
    return df.join(ids.select("table_id"), "table_id", "left_semi")


def with_list_order(tables: DataFrame, selection: DataFrame, keep_unlisted: bool = False) -> DataFrame:
    """Add ``ord`` from (ord, table_id). Unlisted tables go, or come last.

    ``ord`` stays a column; sort on it where the order is needed.
    """
    order = selection.groupBy("table_id").agg(F.max("ord").alias("ord"))
    if not keep_unlisted:
        return tables.join(order, "table_id")
    return tables.join(order, "table_id", "left").withColumn(
        "ord", F.coalesce("ord", F.lit(UNLISTED))
    )


def over_budget(max_tokens: int):
    tokens = F.col("prompt_tokens")
    return (tokens > max_tokens) if max_tokens > 0 else F.lit(False)


def mark_long_prompts(prompts: DataFrame, max_tokens: int, on_long: str = "mark") -> DataFrame:
    """Add ``skip_note`` for prompts over budget (NULL if they fit), or drop them."""
    long = over_budget(max_tokens)
    if on_long == "drop":
        return prompts.filter(~long)
    if on_long != "mark":
        raise ValueError(f"on_long must be 'mark' or 'drop', not {on_long}")
    note = F.concat(
        F.lit(f"{fixed.SKIP_PREFIX} "), F.col("prompt_tokens").cast("string"), F.lit(f" tokens > {max_tokens}]")
    )
    return prompts.withColumn("skip_note", F.when(long, note))


def failing_instances(prompts: DataFrame, max_tokens: int) -> DataFrame:
    """The instances over budget, one row each: whole, whatever their number per table."""
    return prompts.filter(over_budget(max_tokens)).select("table_id", "task", "fmt", "prompt_tokens")


def budget_report(prompts: DataFrame, max_tokens: int, tables: DataFrame | None = None) -> DataFrame:
    """Per table: longest prompt, failing instances, whether all fit.

    Only counts and maxima are aggregated, and map-side first, so prompts are never
    shuffled and a hot table costs nothing extra. With ``tables``, those without any
    prompt are kept; nothing fails for them.
    """
    report = prompts.groupBy("table_id").agg(
        F.max("prompt_tokens").alias("max_prompt_tokens_seen"),
        F.count_if(over_budget(max_tokens)).alias("n_failing_instances"),
    )
    if tables is not None:
        report = tables.select("table_id", "pos").join(report, "table_id", "left")
    return report.withColumns(
        {
            "max_prompt_tokens_seen": F.coalesce("max_prompt_tokens_seen", F.lit(0)),
            "n_failing_instances": F.coalesce("n_failing_instances", F.lit(0)),
        }
    ).withColumn("all_complete", F.col("n_failing_instances") == 0)


def settle(report: DataFrame) -> DataFrame:
    """The report, computed once: one slim row per table in the shared checkpoint folder.

    Finding the n-th complete table and listing what was scanned both read it; without
    this, every prompt would be built twice.
    """
    ensure_checkpoints(report.sparkSession)
    return report.checkpoint()


def first_complete(report: DataFrame, n: int) -> DataFrame:
    """The first n tables, by pos, whose prompts all fit."""
    return report.filter("all_complete").orderBy("pos", "table_id").limit(max(n, 0))


def scanned_until(report: DataFrame, n: int) -> DataFrame:
    """The tables a scan in corpus order looks at before it has n complete ones.

    The cut is the position of the n-th complete table, found by a top-n and used as
    a scalar: no window over the whole corpus.
    """
    cut = first_complete(report, n).agg(
        F.when(F.count(F.lit(1)) >= n, F.max("pos")).alias("cut")
    ).scalar()
    return report.filter(F.coalesce(F.col("pos") <= cut, F.lit(True)))


#: Tables up to which the next stretch's end is looked up exactly, as a top-n of positions.
EXACT_STRETCH = 1_000_000


def _stretch_end(positions: DataFrame, size: int) -> int | None:
    """The position that ends the next ``size`` tables; None if there are no more than these."""
    if size <= EXACT_STRETCH:
        found = positions.orderBy("pos").limit(size + 1).agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last")).first()
        return None if found["n"] <= size else found["last"] - 1
    total = positions.count()
    return None if total <= size else positions.agg(F.percentile_approx("pos", size / total, 10_000)).first()[0]


def scan_until(
    tables: DataFrame, measure: Callable[[DataFrame], DataFrame], max_tokens: int, n: int, first: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Measure tables in corpus order until ``n`` of them fit: (report, sized) of all that were measured.

    ``measure`` turns tables into sized prompts (table_id, task, fmt, prompt_tokens). Stretches of ``pos`` that double what has been looked at, one bounded job
    each: at most about twice the tables needed are rendered, and no other. ``pos`` is filtered first, so stored tables are pruned at the scan.
    What was measured is kept in slim rows in the shared checkpoint folder, for the report and for the diagnostics alike.
    """
    ensure_checkpoints(tables.sparkSession)
    size, low, complete = max(first or n, 1), None, 0
    reports, measured = [], []
    while True:
        left = tables if low is None else tables.filter(F.col("pos") > low)
        high = _stretch_end(left.select("pos"), size)
        some = left if high is None else left.filter(F.col("pos") <= high)
        sized = measure(some).select("table_id", "task", "fmt", "prompt_tokens").checkpoint()
        report = settle(budget_report(sized, max_tokens, some))
        reports.append(report)
        measured.append(sized)
        complete += report.filter("all_complete").count()
        if complete >= n or high is None:
            break
        # as many again as have been looked at
        size, low = (size if low is None else 2 * size), high
    return reduce(DataFrame.unionByName, reports), reduce(DataFrame.unionByName, measured)


def diagnostics(report: DataFrame, prompts: DataFrame, max_tokens: int) -> DataFrame:
    """Report with the failing instances nested per table, for every table alike, ordered by task, format and size.

    For tables with more instances than fit in a row, ``failing_instances`` gives them as rows.
    """
    nested = (
        failing_instances(prompts, max_tokens)
        .groupBy("table_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("task", "fmt", "prompt_tokens"))).alias(
                "failing_instances"
            )
        )
    )
    empty = F.array().cast("array<struct<task:string,fmt:string,prompt_tokens:int>>")
    return report.join(nested, "table_id", "left").withColumn(
        "failing_instances",
        F.when(F.col("n_failing_instances") == 0, empty).otherwise(F.col("failing_instances")),
    )
