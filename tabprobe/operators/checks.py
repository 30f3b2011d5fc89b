"""Contract checks: one aggregate, then an error that names what is wrong."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe import fixed_values as fixed
from tabprobe.operators.resume import pending


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def check_contract(df: DataFrame, id_column: str, rules: Mapping[str, Column]) -> DataFrame:
    """One row: n_rows, n_ids and, per rule, how many rows violate it.

    A rule is a condition that must hold; unknown counts as a violation.
    """
    violated = [
        F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()
    ]
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.col(id_column)).alias("n_ids"), *violated
    )


def missing_rows(expected: DataFrame, produced: DataFrame, key: Sequence[str]) -> DataFrame:
    """Expected keys without an output row."""
    return pending(expected, produced, key)


def enforce(report: DataFrame, expected_rows: int | None = None) -> None:
    """Raise if the one-row report shows repeated ids, a wrong count or a violation."""
    row = report.first().asDict()
    problems = []
    n_rows, n_ids = row.pop("n_rows"), row.pop("n_ids")
    if n_ids != n_rows:
        problems.append(f"ids are not unique: {n_rows} rows, {n_ids} ids")
    if expected_rows is not None and n_rows != expected_rows:
        problems.append(f"expected {expected_rows} rows, found {n_rows}")
    problems += [f"{name}: {count} rows" for name, count in row.items() if count]
    if problems:
        raise ValueError("; ".join(problems))


def external_rules() -> dict[str, Column]:
    """Single-turn lists and all context forms present."""
    rules = {
        "not_one_question": F.size("question_list") == 1,
        "not_one_answer": F.size("golden_answer_list") == 1,
    }
    for field in fixed.EXTERNAL_CONTEXTS.values():
        rules[f"without_{field}"] = F.col(f"context.{field}").isNotNull()
    return rules


def enforce_complete(expected: DataFrame, produced: DataFrame, key: Sequence[str]) -> None:
    missing = missing_rows(expected, produced, key).count()
    if missing:
        raise RuntimeError(f"Incomplete output: {missing} expected rows are missing")
