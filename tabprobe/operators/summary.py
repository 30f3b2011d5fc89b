"""Accuracy and rate summaries of verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe import fixed_values as fixed
from tabprobe.functions.verdict import metric_columns, parse_verdict, tri_state

METRICS = fixed.SUMMARY_METRICS


def parse_verdicts(judged: DataFrame, raw: str = "raw_judge") -> DataFrame:
    """Replace judge text by its verdict columns, keeping the text."""
    return judged.withColumn("_v", parse_verdict(F.col(raw))).select(*judged.columns, "_v.*")


def verdicts_from_text(df: DataFrame) -> DataFrame:
    """Verdict columns read back from text files to nullable booleans."""
    return df.withColumns(
        {c: tri_state(F.col(c)) for c in fixed.VERDICT_FLAGS if c in df.columns}
    )


def row_metrics(verdicts: DataFrame) -> DataFrame:
    """Six metrics per row; ``accuracy_clean`` stays a row column, it is not summarised."""
    return verdicts.withColumns(metric_columns())


def _rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.bround(value, digits)


def _measures(digits: int | None) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        *[_rounded(F.avg(m), digits).alias(m) for m in METRICS],
    ]


def _slim(verdicts: DataFrame, by: Sequence[str]) -> DataFrame:
    metrics = metric_columns()
    return verdicts.select(*by, *[metrics[m].alias(m) for m in METRICS])


def summarise(verdicts: DataFrame, by: Sequence[str] = (), digits: int | None = 4) -> DataFrame:
    """n and five means per group (null groups kept), or overall without ``by``.

    Means skip unknowns, n counts all rows. Counts and sums combine map-side, so group
    size does not matter.
    """
    return _slim(verdicts, by).groupBy(*by).agg(*_measures(digits))


def summarise_all(verdicts: DataFrame, digits: int | None = 4) -> DataFrame:
    """By (task, fmt), by fmt and overall in one pass; ``level`` tells them apart."""
    level = (
        F.when(F.grouping_id() == 0, "task_fmt").when(F.grouping_id() == 2, "fmt").otherwise("overall")
    )
    return (
        _slim(verdicts, ["task", "fmt"])
        .groupingSets([["task", "fmt"], ["fmt"], []], "task", "fmt")
        .agg(level.alias("level"), *_measures(digits))
        .select("level", "task", "fmt", "n", *METRICS)
    )


#: Stands for a missing format in the names of pivoted columns.
NO_FORMAT = "null"
_ABSENT = "\0"


def formats_of(verdicts: DataFrame) -> list[str | None]:
    """Distinct formats, sorted, a missing one last; a handful, and refused beyond the session's pivot limit."""
    limit = int(verdicts.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = [r.fmt for r in verdicts.select("fmt").distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"More than {limit} formats; pass the list to pivot on")
    return sorted(found, key=lambda f: (f is None, f or ""))


def pivot_pairs(per_pair: DataFrame, formats: Sequence[str | None]) -> DataFrame:
    """Summaries by (task, fmt) to one row per task, {fmt}_{metric} metric by metric.

    A missing format has columns named ``null_{metric}``, or ``null(missing)_{metric}`` beside a format of that name.
    """
    formats = list(dict.fromkeys(formats))
    names = {f: f if f is not None else NO_FORMAT + "(missing)" * (NO_FORMAT in formats) for f in formats}
    keys = [_ABSENT if f is None else f for f in formats]
    wide = per_pair.withColumn("fmt", F.coalesce("fmt", F.lit(_ABSENT))).groupBy("task").pivot("fmt", keys).agg(
        F.first("n").alias("n"), *[F.first(m).alias(m) for m in METRICS]
    )
    return wide.select("task", *[F.col(f"`{k}_{m}`").alias(f"{names[f]}_{m}") for m in ["n", *METRICS] for f, k in zip(formats, keys)])


def summarise_pivot(
    verdicts: DataFrame, formats: Sequence[str | None] | None = None, digits: int | None = 4
) -> DataFrame:
    """task, then {fmt}_{metric} metric by metric, formats sorted; absent pairs are NULL. Names as in ``pivot_pairs``."""
    formats = sorted(formats, key=lambda f: (f is None, f or "")) if formats is not None else formats_of(verdicts)
    return pivot_pairs(summarise(verdicts, ["task", "fmt"], digits), formats)
