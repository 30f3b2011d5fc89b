"""Serialising keys with any number of rows, without collecting a key anywhere.

Every row becomes its own piece of text by plain row expressions; pieces are numbered
densely across tasks and joined in parts of a bounded number of rows. The text of a
key is its parts in order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.fixed_values import COL_SEPARATOR, SECTION_SEPARATOR
from tabprobe.functions.formats import csv_cell, csv_quote, json_string, xml_tag
from tabprobe.operators.numbering import number_rows

PART_ROWS = 1000

Names = Sequence[Column]
Cells = Sequence[Column]


@dataclass(frozen=True)
class RowFormat:
    """How one format looks row by row: opening text, one row, joiner, closing text."""

    row: Callable[[Names, Cells, Column], Column]
    opening: Callable[[Names], Column] | None = None
    closing: str = ""
    joiner: str = "\n"


def _joined(separator: str, pieces: Sequence[Column]) -> Column:
    return F.concat_ws(separator, *pieces)


def _delimited(separator: str) -> RowFormat:
    return RowFormat(
        row=lambda names, cells, n: _joined(separator, cells),
        opening=lambda names: F.concat(_joined(separator, names), F.lit("\n")),
    )


def _csv(cell: Callable[[Column], Column]) -> RowFormat:
    def record(values: Sequence[Column]) -> Column:
        text = _joined(",", [cell(v) for v in values])
        return F.when(values[0] == "", F.lit('""')).otherwise(text) if len(values) == 1 else text

    return RowFormat(
        row=lambda names, cells, n: record(cells),
        opening=lambda names: F.concat(record(names), F.lit("\r\n")),
        joiner="\r\n",
    )


def _facts(between: str, names: Names, cells: Cells) -> list[Column]:
    return [F.concat(h, F.lit(between), v) for h, v in zip(names, cells)]


def _prose(names: Names, cells: Cells, n: Column) -> Column:
    return F.concat(F.lit("Row "), n, F.lit(": "), _joined(", ", _facts(" is ", names, cells)), F.lit("."))


def _row_obj(names: Names, cells: Cells, n: Column) -> Column:
    return _joined(" | ", [F.concat(F.lit("Row "), n), *_facts("=", names, cells)])


def _json(names: Names, cells: Cells, n: Column) -> Column:
    fields = [
        F.concat(F.lit("    "), json_string(h), F.lit(": "), json_string(v)) for h, v in zip(names, cells)
    ]
    return F.concat(F.lit("  {\n"), _joined(",\n", fields), F.lit("\n  }"))


def _html_block(values: Sequence[Column], tag: str) -> Column:
    inner = [F.concat(F.lit(f"    <{tag}>"), v, F.lit(f"</{tag}>")) for v in values]
    return _joined("\n", [F.lit("  <tr>"), *inner, F.lit("  </tr>")])


def _yaml(names: Names, cells: Cells, n: Column) -> Column:
    first, *rest = _facts(": ", names, cells)
    return _joined("\n", [F.concat(F.lit("- "), first), *[F.concat(F.lit("  "), f) for f in rest]])


def _xml(names: Names, cells: Cells, n: Column) -> Column:
    tags = [xml_tag(h) for h in names]
    inner = [
        F.concat(F.lit("    <"), t, F.lit(">"), v, F.lit("</"), t, F.lit(">")) for t, v in zip(tags, cells)
    ]
    return _joined("\n", [F.concat(F.lit('  <row id="'), n, F.lit('">')), *inner, F.lit("  </row>")])


def _md_line(widths: Sequence[Column], values: Sequence[Column]) -> Column:
    padded = [F.rpad(v, w, F.lit(" ")) for v, w in zip(values, widths)]
    return F.concat(F.lit("| "), _joined(" | ", padded), F.lit(" |"))


ROW_FORMATS: dict[str, RowFormat] = {
    "tsv": _delimited("\t"),
    "prose": RowFormat(_prose, joiner=" "),
    "csv": _csv(csv_cell),
    "csv_q": _csv(csv_quote),
    "row_obj": RowFormat(_row_obj),
    "col_sep": _delimited(COL_SEPARATOR),
    "sec_sep": _delimited(SECTION_SEPARATOR),
    "json": RowFormat(_json, opening=lambda names: F.lit("[\n"), closing="\n]", joiner=",\n"),
    "html": RowFormat(
        row=lambda names, cells, n: _html_block(cells, "td"),
        opening=lambda names: F.concat(F.lit("<table>\n"), _html_block(names, "th"), F.lit("\n")),
        closing="\n</table>",
    ),
    "yaml": RowFormat(_yaml),
    "xml": RowFormat(_xml, opening=lambda names: F.lit("<table>\n"), closing="\n</table>"),
}
LONG_FORMATS = (*ROW_FORMATS, "md")


def _md_format(columns: Sequence[str]) -> RowFormat:
    """Markdown needs the column widths, which ``serialise_rows`` adds as _w0, _w1, ..."""
    widths = [F.col(f"_w{i}") for i in range(len(columns))]
    rule = _joined(" | ", [F.repeat(F.lit("-"), w) for w in widths])
    return RowFormat(
        row=lambda names, cells, n: _md_line(widths, cells),
        opening=lambda names: F.concat(
            _md_line(widths, names), F.lit("\n| "), rule, F.lit(" |\n")
        ),
    )


def _key_facts(numbered: DataFrame, columns: dict[str, Column], widths: bool) -> DataFrame:
    """Per key: its last part and, for md, the longest header or cell per column (at least 3).

    Maxima combine map-side, so one slim row per key and task is shuffled.
    """
    facts = [F.max("part").alias("_last")]
    if widths:
        facts += [
            F.greatest(F.lit(max(len(name), 3)), F.max(F.length(cell))).alias(f"_w{i}")
            for i, (name, cell) in enumerate(columns.items())
        ]
    return numbered.groupBy("table_id").agg(*facts)


def serialise_rows(
    df: DataFrame,
    key: str,
    order_by: Sequence[str],
    columns: dict[str, Column],
    formats: Sequence[str],
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """(table_id, fmt, part, part_text) for whole keys of any size.

    ``order_by`` names columns of ``df``. A key with a third of all rows is numbered by
    many tasks (``number_rows``) and written as many parts. What a part must know of its
    key (last part, column widths) is one slim row.
    """
    unknown = [f for f in formats if f not in LONG_FORMATS]
    if unknown:
        raise ValueError(f"Unknown table formats: {unknown}")
    texts = {n: F.coalesce(c.cast("string"), F.lit("None")) for n, c in columns.items()}
    names = list(texts)
    flat = df.select(
        F.col(key).cast("string").alias("table_id"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)],
        *[c.alias(f"_c{i}") for i, c in enumerate(texts.values())],
    )
    numbered = number_rows(
        flat, [f"_o{i}" for i in range(len(order_by))], key=["table_id"], name="_n"
    ).withColumn("part", F.floor(F.col("_n") / part_rows))
    cells = {n: F.col(f"_c{i}") for i, n in enumerate(names)}
    per_key = _key_facts(numbered, cells, widths="md" in formats)

    # One bounded group per part; the row texts need the widths only for md, so cells
    # travel once and every format is rendered from the collected part.
    collected = numbered.groupBy("table_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("_n", *[f"_c{i}" for i in range(len(names))]))).alias("_rows")
    )
    # A hot key has very many parts; the adaptive skew join splits them.
    collected = collected.join(per_key, "table_id")

    headers = [F.lit(n) for n in names]

    def text_of(fmt: str) -> Column:
        shape = _md_format(names) if fmt == "md" else ROW_FORMATS[fmt]
        lines = F.transform(
            "_rows",
            lambda r: shape.row(
                headers,
                [r[f"_c{i}"] for i in range(len(names))],
                (r["_n"] + 1).cast("string"),
            ),
        )
        first, last = F.col("part") == 0, F.col("part") == F.col("_last")
        opening = shape.opening(headers) if shape.opening else F.lit("")
        return F.concat(
            F.when(first, opening).otherwise(F.lit(shape.joiner)),
            F.array_join(lines, shape.joiner),
            F.when(last, F.lit(shape.closing)).otherwise(F.lit("")),
        )

    parts = F.array(*[F.struct(F.lit(f).alias("fmt"), text_of(f).alias("part_text")) for f in formats])
    return collected.select("table_id", "part", F.explode(parts).alias("s")).select(
        "table_id", "s.fmt", "part", "s.part_text"
    )
