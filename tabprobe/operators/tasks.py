"""Structural tasks with gold answers, five kinds per table."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe import fixed_values as fixed
from tabprobe.functions.picks import indexes, pick, ranked
from tabprobe.functions.text import fill, let

_PICKS = "struct<cells:array<int>,values:array<int>,rows:array<int>,cols:array<int>>"


def value_positions(tables: DataFrame) -> DataFrame:
    """First position and number of positions of every distinct value of a table.

    Takes nested tables, or cells (table_id, row_idx, col_idx, value). A nested table's row knows the answer: sorting (value, row, column) puts equal
    values side by side, the first of each run is its first position, and the run's length its count, so nothing is exchanged. Cells are grouped.
    """
    if "rows" in tables.columns:
        return _positions_in_row(tables)
    return tables.groupBy("table_id", "value").agg(
        F.min(F.struct("row_idx", "col_idx")).alias("first"),
        F.count(F.lit(1)).alias("n_pos"),
    ).select(
        "table_id", "value",
        F.col("first.row_idx").alias("row_idx"),
        F.col("first.col_idx").alias("col_idx"),
        "n_pos",
    )


def _positions_in_row(tables: DataFrame) -> DataFrame:
    grid = F.flatten(
        F.transform(
            "rows",
            lambda r, i: F.transform(r, lambda v, j: F.struct(v.alias("value"), i.alias("row_idx"), j.alias("col_idx"))),
        )
    )
    ordered, starts = F.col("_ordered"), F.col("_starts")

    def starts_run(k: Column) -> Column:
        return (k == 0) | ~F.get(ordered, k - 1)["value"].eqNullSafe(F.get(ordered, k)["value"])

    def run(k: Column, n: Column) -> Column:
        x = F.get(ordered, k)
        end = F.coalesce(F.get(starts, n + 1), F.size(ordered))
        return F.struct(x["value"].alias("value"), x["row_idx"].alias("row_idx"), x["col_idx"].alias("col_idx"), (end - k).cast("long").alias("n_pos"))

    return (
        tables.select("table_id", F.sort_array(grid).alias("_ordered"))
        .withColumn("_starts", F.filter(indexes(F.size(ordered)), starts_run))
        .select("table_id", F.inline_outer(F.transform(starts, run)))
        .filter(F.col("n_pos").isNotNull())
    )


def unique_values(tables: DataFrame) -> DataFrame:
    """Values that occur exactly once in their table; tables or cells, as in ``value_positions``."""
    return value_positions(tables).filter(F.col("n_pos") == 1).drop("n_pos")


_BASE = ["table_id", "header", "rows", "n_rows", "n_cols"]


def _with_cells(tables: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Slots (row * n_cols + col) that exist, and which of them start or are a value.

    Sorting (value, slot) puts equal values side by side: the first of each run is a first occurrence, and that of a run of one
    the only one. Cells beyond the header have no
    column to ask about and are left out.
    """
    n_cols = F.col("n_cols")
    grid = F.flatten(
        F.transform(
            "rows",
            lambda r, i: F.transform(
                F.slice(r, F.lit(1), n_cols),
                lambda v, j: F.struct(v.alias("v"), (i * n_cols + j).alias("slot")),
            ),
        )
    )
    # in the order of rows and columns, without a sort
    slots = F.flatten(
        F.transform(
            "rows",
            lambda r, i: F.when(F.size(r) >= n_cols, F.sequence(i * n_cols, (i + 1) * n_cols - 1)).otherwise(
                F.transform(r, lambda _, j: i * n_cols + j)
            ),
        )
    )

    # Within one expression the sorted array stays as it is; as a column, each look into it would read it from its row again.
    def runs(by_value: Column) -> Column:
        def starts_run(k: Column) -> Column:
            return (k == 0) | F.coalesce(F.get(by_value, k - 1)["v"] != F.get(by_value, k)["v"], F.lit(True))

        def slots_of(starts: Column) -> Column:
            return F.transform(starts, lambda k: F.get(by_value, k)["slot"])

        def single(starts: Column) -> Column:
            return F.filter(starts, lambda k, n: F.coalesce(F.get(starts, n + 1), F.size(by_value)) == k + 1)

        return let(
            F.filter(indexes(F.size(by_value)), starts_run),
            lambda starts: F.struct(slots_of(starts).alias("firsts"), slots_of(single(starts)).alias("uniques")),
        )

    return (
        tables.select(
            *keep, "table_id", "header", "rows",
            F.size("rows").alias("n_rows"), F.size("header").alias("n_cols"),
        )
        .withColumns({"_runs": let(F.sort_array(grid), runs), "_slots": F.when(n_cols > 0, slots).otherwise(F.array().cast("array<int>"))})
        .select(
            *keep, *_BASE,
            "_slots",
            F.sort_array(F.col("_runs.firsts")).alias("_firsts"),
            F.sort_array(F.col("_runs.uniques")).alias("_uniques"),
        )
    )


def _hash_picks(
    slots: DataFrame, seed: int, counts: Mapping[str, int], keep: Sequence[str]
) -> DataFrame:
    table = F.col("table_id")
    drawn, uniques = F.col("_drawn"), F.col("_uniques")
    ambiguous = F.col("_ambiguous")
    spare = F.col("_spare")
    with_draws = slots.withColumn(
        "_drawn", pick(seed, table, "value", F.col("_firsts"), counts["reverse_lookup"])
    ).withColumn("_ambiguous", F.array_except(drawn, uniques))
    with_spares = with_draws.withColumn(
        "_spare",
        F.when(
            F.size(ambiguous) > 0,
            ranked(seed, table, "replacement", F.array_except(uniques, drawn)),
        ),
    )
    # The i-th ambiguous draw takes the i-th spare value; without one it is dropped.
    replaced = F.transform(
        drawn,
        lambda d: F.when(
            F.array_contains(ambiguous, d),
            F.get(spare, F.array_position(ambiguous, d).cast("int") - 1),
        ).otherwise(d),
    )
    return with_spares.select(
        *keep, *_BASE,
        pick(seed, table, "cell", F.col("_slots"), counts["cell_lookup"]).alias("_cells"),
        F.filter(replaced, lambda d: d.isNotNull()).alias("_values"),
        pick(seed, table, "row", indexes(F.col("n_rows")), counts["row_retrieval"]).alias("_rows"),
        pick(seed, table, "col", indexes(F.col("n_cols")), counts["col_retrieval"]).alias("_cols"),
    )


def _draw(
    seed: int, table_id: str, slots: list[int], firsts: list[int], uniques: list[int],
    n_rows: int, n_cols: int, counts: Mapping[str, int],
) -> dict[str, list[int]]:
    generator = random.Random(seed)

    def choose(pool, kind):
        return generator.sample(pool, min(counts[kind], len(pool)))

    cells = choose(slots, "cell_lookup")
    drawn = choose(firsts, "reverse_lookup")
    only = set(uniques)
    spare = sorted(only.difference(drawn))
    random.Random(f"{seed}:{table_id}:reverse_lookup").shuffle(spare)
    supply = iter(spare)
    values = [slot if slot in only else next(supply, None) for slot in drawn]
    return {
        "cells": cells,
        "values": [v for v in values if v is not None],
        "rows": choose(range(n_rows), "row_retrieval"),
        "cols": choose(range(n_cols), "col_retrieval"),
    }


def _mt_picks(
    slots: DataFrame, seed: int, counts: Mapping[str, int], keep: Sequence[str]
) -> DataFrame:
    counts = dict(counts)

    @F.pandas_udf(_PICKS)
    def draw(
        table_id: pd.Series, cells: pd.Series, firsts: pd.Series, uniques: pd.Series,
        n_rows: pd.Series, n_cols: pd.Series,
    ) -> pd.DataFrame:
        picks = [
            _draw(seed, t, c.tolist(), f.tolist(), u.tolist(), int(r), int(k), counts)
            for t, c, f, u, r, k in zip(table_id, cells, firsts, uniques, n_rows, n_cols)
        ]
        return pd.DataFrame(picks, columns=["cells", "values", "rows", "cols"])

    picks = draw("table_id", "_slots", "_firsts", "_uniques", "n_rows", "n_cols")
    return slots.withColumn("_p", picks).select(
        *keep, *_BASE,
        *[F.col(f"_p.{name}").alias(f"_{name}") for name in ("cells", "values", "rows", "cols")],
    )


def generate_tasks(
    tables: DataFrame,
    seed: int = 42,
    counts: Mapping[str, int] = fixed.TASKS_PER_TABLE,
    sampler: str = "hash",
    kinds: Sequence[str] = tuple(fixed.TASKS_PER_TABLE),
    keep: Sequence[str] = (),
) -> DataFrame:
    """(table_id, task_seq, task, question, gold, n_rows, n_cols); no shuffle.

    A table is one bounded row, so sampling and uniqueness run inside the row.
    ``hash`` ranks by md5(seed:table:kind:item), all on the JVM side; ``mt19937``
    draws the same number of items with the standard library's generator, in the
    order cells, values, rows, columns, to reproduce earlier runs. ``kinds`` restricts
    the output; what the other kinds need is not computed. ``keep`` names further table
    columns to carry along.
    """
    if sampler not in ("hash", "mt19937"):
        raise ValueError(f"Unknown sampler: {sampler}")
    choose = _hash_picks if sampler == "hash" else _mt_picks
    picked = choose(_with_cells(tables, keep), seed, counts, keep)
    header, rows, n_cols = F.col("header"), F.col("rows"), F.col("n_cols")

    def row_of(slot: Column) -> Column:
        return F.floor(slot / n_cols).cast("int")

    def column_of(slot: Column) -> Column:
        return slot % n_cols

    def task(kind: str, question: Column, gold: Column) -> Column:
        return F.struct(F.lit(kind).alias("task"), question.alias("question"), gold.alias("gold"))

    def cell_task(slot: Column) -> Column:
        where = {"row": row_of(slot) + 1, "column": F.get(header, column_of(slot))}
        value = F.get(F.get(rows, row_of(slot)), column_of(slot))
        return task("cell_lookup", fill(fixed.CELL_QUESTION, **where), value)

    def reverse_task(slot: Column) -> Column:
        where = {"row": row_of(slot) + 1, "column": F.get(header, column_of(slot))}
        value = F.get(F.get(rows, row_of(slot)), column_of(slot))
        return task(
            "reverse_lookup", fill(fixed.REVERSE_QUESTION, value=value), fill(fixed.REVERSE_GOLD, **where)
        )

    def row_task(r: Column) -> Column:
        return task(
            "row_retrieval", fill(fixed.ROW_QUESTION, row=r + 1), F.array_join(F.get(rows, r), "\n")
        )

    def column_task(c: Column) -> Column:
        # A short row has no such cell; the value is left out.
        values = F.array_join(F.transform(rows, lambda r: F.get(r, c)), "\n")
        return task("col_retrieval", fill(fixed.COLUMN_QUESTION, column=F.get(header, c)), values)

    size = task(
        "size_detection",
        F.lit(fixed.SIZE_QUESTION),
        fill(fixed.SIZE_GOLD, rows=F.col("n_rows"), columns=n_cols),
    )
    by_kind = {
        "size_detection": F.slice(F.array(size), 1, counts["size_detection"]),
        "cell_lookup": F.transform("_cells", cell_task),
        "reverse_lookup": F.transform("_values", reverse_task),
        "row_retrieval": F.transform("_rows", row_task),
        "col_retrieval": F.transform("_cols", column_task),
    }
    repeated = F.concat(*[tasks for kind, tasks in by_kind.items() if kind in kinds])
    # Outer, then without the empty ones: a plain explode adds a filter on the array's
    # size, which would run all of the above a second time.
    return (
        picked.select(
            *keep, "table_id", "n_rows", "n_cols", F.posexplode_outer(repeated).alias("task_seq", "t")
        )
        .filter(F.col("t").isNotNull())
        .select("table_id", "task_seq", "t.task", "t.question", "t.gold", "n_rows", "n_cols", *keep)
    )


_TASK_FIELDS = ["task_seq", "task", "question", "gold", "n_rows", "n_cols"]


def tasks_by_table(tasks: DataFrame, part_tasks: int | None = None) -> DataFrame:
    """(table_id, part, tasks): a table's tasks in order, in part 0; or, if ``part_tasks`` is given, at most so many per part."""
    fields = _TASK_FIELDS
    part = (F.lit(0).cast("long") if part_tasks is None else F.floor(F.col("task_seq") / part_tasks)).alias("part")
    return tasks.groupBy("table_id", part).agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("tasks")
    )


def packed_by_table(packed: DataFrame, tasks: str) -> DataFrame:
    """The same, in part 0, from rows that hold all tasks of a table as an array of structs already; map-only."""
    kept = F.transform(tasks, lambda t: F.struct(*[t[c].alias(c) for c in _TASK_FIELDS]))
    return packed.select("table_id", F.lit(0).cast("long").alias("part"), F.sort_array(kept).alias("tasks"))
