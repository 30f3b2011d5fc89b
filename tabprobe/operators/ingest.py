"""Records and row tables to canonical tables (table_id, pos, header, rows, ...)."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.functions.text import UNICODE_SPACE, strip
from tabprobe.operators.numbering import number_rows, number_source_rows

_GRID = "array<array<string>>"


def limit_of(value: int | None) -> int | None:
    """None, zero and negative all mean no limit."""
    return value if value is not None and value > 0 else None


def _as_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def _text_list(values: Column) -> Column:
    return F.transform(values, _as_text)


def truncate_tables(
    tables: DataFrame, max_rows: int | None = None, max_cols: int | None = None
) -> DataFrame:
    """First columns, then first rows, where a limit is given; map-only."""
    max_rows, max_cols = limit_of(max_rows), limit_of(max_cols)
    header, rows = F.col("header"), F.col("rows")
    if max_rows:
        rows = F.slice(rows, 1, max_rows)
    if max_cols:
        header = F.slice(header, 1, max_cols)
        rows = F.transform(rows, lambda r: F.slice(r, 1, max_cols))
    return tables.withColumns({"header": header, "rows": rows})


def _field(schema: T.StructType, name: str) -> T.DataType | None:
    return schema[name].dataType if name in schema.names else None


def _first_filled(schema: T.StructType, parent: str | None, names: Sequence[str]) -> Column:
    """First non-empty of the alternatives; if none is, the last one as it is."""
    present = [F.col(f"{parent}.{n}" if parent else n) for n in names if _field(schema, n) is not None]
    if not present:
        return F.lit(None)
    filled = [F.when(F.size(c) > 0, c) for c in present]
    last_known = present[-1] if _field(schema, names[-1]) is not None else F.lit(None)
    return F.coalesce(*filled, last_known)


def _answer_list(schema: T.StructType, name: str) -> Column:
    column = F.col(name)
    if isinstance(_field(schema, name), T.ArrayType):
        return F.when(F.size(column) > 0, _text_list(column))
    text = column.cast("string")
    return F.when(F.length(text) > 0, F.array(text))


def _answers(schema: T.StructType) -> Column:
    present = [
        _answer_list(schema, n)
        for n in ("answer_text", "answers", "answer", "seq_out")
        if _field(schema, n) is not None
    ]
    if not present:
        return F.array().cast("array<string>")
    return F.filter(F.coalesce(*present), lambda a: F.trim(a, F.lit(UNICODE_SPACE)) != "")


def parse_tables(
    raw: DataFrame,
    order_by: Sequence[str] | None = None,
    max_rows: int | None = None,
    max_cols: int | None = None,
) -> DataFrame:
    """Heterogeneous records to canonical tables, cleaned, and truncated where a limit is given.

    The nested ``table`` wins over top-level fields; empty lists fall through to the
    next alternative; records without header, rows or answers are dropped. ``pos`` is
    the dense number of *accepted* records, and serves as id where a record has none: in the
    order of the source (``raw`` from ``numbering.source_order``), or of the columns ``order_by``, which costs a sort.
    """
    schema = raw.schema
    header = _first_filled(schema, None, ["table_column_names", "column_names"])
    rows = _first_filled(schema, None, ["table_content_values", "content_values"])
    nested = _field(schema, "table")
    if isinstance(nested, T.StructType):
        inner_header = _first_filled(nested, "table", ["header", "column_names", "columns"])
        inner_rows = _first_filled(nested, "table", ["rows", "data", "content"])
        usable = inner_header.isNotNull() & inner_rows.isNotNull()
        header = F.when(usable, inner_header.cast("array<string>")).otherwise(header.cast("array<string>"))
        rows = F.when(usable, inner_rows.cast(_GRID)).otherwise(rows.cast(_GRID))
    question = F.col("question").cast("string") if "question" in schema.names else F.lit("")
    parsed = raw.select(
        *(["_file", "_block"] if order_by is None else order_by),
        (F.col("id").cast("string") if "id" in schema.names else F.lit(None).cast("string")).alias("_id"),
        strip(F.coalesce(question, F.lit(""))).alias("question"),
        _answers(schema).alias("answers"),
        header.cast("array<string>").alias("header"),
        rows.cast(_GRID).alias("rows"),
    )
    cleaned = truncate_tables(parsed, max_rows, max_cols).withColumns(
        {
            "header": _text_list(F.col("header")),
            "rows": F.transform("rows", _text_list),
        }
    )
    accepted = cleaned.filter(
        (F.size("header") > 0) & (F.size("rows") > 0) & (F.size("answers") > 0)
    )
    numbered = number_source_rows(accepted) if order_by is None else number_rows(accepted, order_by)
    return numbered.select(
        F.coalesce("_id", F.col("pos").cast("string")).alias("table_id"),
        "pos", "question", "answers", "header", "rows",
    )


def tables_from_rows(
    df: DataFrame,
    key: str,
    order_by: Sequence[str | Column],
    columns: dict[str, Column],
    max_rows: int | None = None,
    max_cols: int | None = None,
) -> DataFrame:
    """Any row table to one canonical table per key, with all its rows unless ``max_rows`` is given.

    With a limit, ``row_number() <= max_rows`` is applied before anything is collected, and up to Spark's
    threshold for limits per group also before the shuffle. Window and aggregate share one exchange on the key.
    A table is one row, so a key of unbounded size needs a limit, a finer key, or ``operators.longform``.
    """
    max_rows = limit_of(max_rows)
    kept = dict(list(columns.items())[: limit_of(max_cols)])
    window = Window.partitionBy("table_id").orderBy(*order_by)
    cells = F.array(*[_as_text(c) for c in kept.values()])
    top = (
        df.withColumn("table_id", F.col(key).cast("string"))
        .withColumn("_rn", F.row_number().over(window))
        .filter(F.lit(True) if max_rows is None else F.col("_rn") <= max_rows)
        .select("table_id", F.col(key).alias("_key"), "_rn", cells.alias("_cells"))
    )
    pos = F.min(F.col("_key")) if _integral(df, key) else F.min(F.xxhash64("_key"))
    return top.groupBy("table_id").agg(
        pos.cast("bigint").alias("pos"),
        F.sort_array(F.collect_list(F.struct("_rn", "_cells"))).alias("_rows"),
    ).select(
        "table_id",
        "pos",
        F.array(*[F.lit(n) for n in kept]).alias("header"),
        F.col("_rows._cells").alias("rows"),
    )


def _integral(df: DataFrame, key: str) -> bool:
    return isinstance(df.schema[key].dataType, T.IntegralType)


def cells(tables: DataFrame) -> DataFrame:
    """Long view: one row per cell, with zero-based row and column."""
    rows = tables.select("table_id", "header", F.posexplode("rows").alias("row_idx", "_row"))
    return rows.select(
        "table_id", "header", "row_idx", F.posexplode("_row").alias("col_idx", "value")
    ).select(
        "table_id", "row_idx", "col_idx", F.get("header", "col_idx").alias("col_name"), "value"
    )


def largest_tables(tables: DataFrame, n: int | None) -> DataFrame:
    """The n tables with most rows, then most columns, in that order."""
    keys = [F.size("rows").desc(), F.size("header").desc(), F.col("pos").asc(), F.col("table_id").asc()]
    ordered = tables.orderBy(*keys)
    return ordered.limit(n) if limit_of(n) else ordered


def first_tables(tables: DataFrame, n: int | None) -> DataFrame:
    """The first n tables in corpus order; all of them, unsorted, without a limit."""
    return tables.orderBy("pos", "table_id").limit(n) if limit_of(n) else tables
