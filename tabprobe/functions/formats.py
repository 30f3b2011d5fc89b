"""Table to text in twelve formats, as Column expressions over header and rows.

``header`` is ARRAY<STRING>, ``rows`` ARRAY<ARRAY<STRING>>; no cell is NULL (see
``operators.ingest``). Pairing a header with a row stops at the shorter of the two;
only ``md`` pads short rows. Nothing is escaped except in ``csv*`` and ``json``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabprobe.fixed_values import COL_SEPARATOR, SECTION_SEPARATOR
from tabprobe.functions.text import let

_NEEDS_ESCAPE = r'["\\\x00-\x1f]'
_RARE_CONTROL = r"[\x00-\x07\x0b\x0e-\x1f]"
_COMMON_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _text(*pieces: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def _pairs(header: Column, row: Column, make: Callable[[Column, Column, Column], Column]) -> Column:
    """make(name, value, index) for every header/cell pair of one row."""
    return F.transform(
        F.slice(row, F.lit(1), F.size(header)), lambda v, i: make(F.get(header, i), v, i)
    )


def _numbered(rows: Column, make: Callable[[Column, Column], Column]) -> Column:
    """make(row, one-based number as text) for every row."""
    return F.transform(rows, lambda r, i: make(r, (i + 1).cast("string")))


def _delimited(separator: str) -> Callable[[Column, Column], Column]:
    def build(header: Column, rows: Column) -> Column:
        lines = F.transform(rows, lambda r: F.array_join(r, separator))
        return F.array_join(F.concat(F.array(F.array_join(header, separator)), lines), "\n")

    return build


to_tsv = _delimited("\t")
to_col_sep = _delimited(COL_SEPARATOR)
to_sec_sep = _delimited(SECTION_SEPARATOR)


def to_md(header: Column, rows: Column) -> Column:
    def width(name: Column, i: Column) -> Column:
        longest = F.array_max(F.transform(rows, lambda r: F.length(F.get(r, i))))
        return F.greatest(F.length(name), F.coalesce(longest, F.lit(1)), F.lit(3))

    def render(widths: Column) -> Column:
        def line(cells: Column) -> Column:
            padded = F.transform(
                widths, lambda w, i: F.rpad(F.coalesce(F.get(cells, i), F.lit("")), w, F.lit(" "))
            )
            return _text("| ", F.array_join(padded, " | "), " |")

        rule = F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("-"), w)), " | ")
        return F.array_join(
            F.concat(F.array(line(header), _text("| ", rule, " |")), F.transform(rows, line)), "\n"
        )

    return let(F.transform(header, width), render)


def to_prose(header: Column, rows: Column) -> Column:
    def sentence(row: Column, number: Column) -> Column:
        facts = F.array_join(_pairs(header, row, lambda h, v, _: _text(h, " is ", v)), ", ")
        return _text("Row ", number, ": ", facts, ".")

    return F.array_join(_numbered(rows, sentence), " ")


def to_row_obj(header: Column, rows: Column) -> Column:
    def line(row: Column, number: Column) -> Column:
        facts = _pairs(header, row, lambda h, v, _: _text(h, "=", v))
        return F.array_join(F.concat(F.array(_text("Row ", number)), facts), " | ")

    return F.array_join(_numbered(rows, line), "\n")


def csv_quote(cell: Column) -> Column:
    return _text('"', F.replace(cell, F.lit('"'), F.lit('""')), '"')


def csv_cell(cell: Column) -> Column:
    return F.when(cell.rlike('[",\r\n]'), csv_quote(cell)).otherwise(cell)


def _csv(cell: Callable[[Column], Column], lone_empty: str) -> Callable[[Column, Column], Column]:
    def record(cells: Column) -> Column:
        # A record of one empty field must not look like a blank line.
        return F.when(
            (F.size(cells) == 1) & (F.get(cells, F.lit(0)) == ""), F.lit(lone_empty)
        ).otherwise(F.array_join(F.transform(cells, cell), ","))

    def build(header: Column, rows: Column) -> Column:
        records = F.concat(F.array(record(header)), F.transform(rows, record))
        return F.rtrim(F.array_join(records, "\r\n"), F.lit("\r\n"))

    return build


to_csv = _csv(csv_cell, '""')
to_csv_q = _csv(csv_quote, '""')


def json_string(value: Column) -> Column:
    """JSON string literal: short escapes, lower-case \\u00xx, non-ASCII kept."""
    escaped = value
    for raw, out in _COMMON_ESCAPES.items():
        escaped = F.replace(escaped, F.lit(raw), F.lit(out))
    # Control characters without a short escape are rare enough to go char by char.
    spelled = F.array_join(
        F.transform(
            F.split(escaped, ""),
            lambda c: F.when(
                c.rlike(_RARE_CONTROL), F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(F.ascii(c)), 4, "0")))
            ).otherwise(c),
        ),
        "",
    )
    body = (
        F.when(~value.rlike(_NEEDS_ESCAPE), value)
        .when(~value.rlike(_RARE_CONTROL), escaped)
        .otherwise(spelled)
    )
    return _text('"', body, '"')


def to_json(header: Column, rows: Column) -> Column:
    """Array of objects, two-space indent; a repeated name keeps its first place and last value."""

    def render(keys: Column) -> Column:
        def record(row: Column, fields: Column) -> Column:
            return F.when((F.size(row) == 0) | (F.size(keys) == 0), F.lit("  {}")).otherwise(
                _text("  {\n", F.array_join(fields, ",\n"), "\n  }")
            )

        def plain(row: Column) -> Column:
            return record(row, _pairs(keys, row, lambda k, v, _: _text(k, json_string(v))))

        def merged(row: Column) -> Column:
            paired = F.least(F.size(keys), F.size(row))
            names = F.slice(keys, F.lit(1), paired)
            last = F.transform(
                F.array_distinct(names),
                lambda k: _text(
                    k, json_string(F.get(row, paired - F.array_position(F.reverse(names), k).cast("int")))
                ),
            )
            return record(row, last)

        repeated = F.size(F.array_distinct(keys)) < F.size(keys)
        records = F.when(repeated, F.transform(rows, merged)).otherwise(F.transform(rows, plain))
        return _text("[\n", F.array_join(records, ",\n"), "\n]")

    keys = F.transform(header, lambda h: _text("    ", json_string(h), ": "))
    return F.when(F.size(rows) == 0, F.lit("[]")).otherwise(let(keys, render))


def to_html(header: Column, rows: Column) -> Column:
    # The tags between two cells are one separator, so a row is joined and no cell is handled by itself.
    def block(cells: Column, tag: str) -> Column:
        inner = F.array_join(cells, f"</{tag}>\n    <{tag}>")
        return F.when(cells.isNull(), F.lit(None)).when(
            F.exists(cells, lambda v: v.isNotNull()), _text(f"  <tr>\n    <{tag}>", inner, f"</{tag}>\n  </tr>")
        ).otherwise(F.lit("  <tr>\n  </tr>"))

    lines = F.concat(F.array(F.lit("<table>")), F.array(block(header, "th")), F.transform(rows, lambda r: block(r, "td")), F.array(F.lit("</table>")))
    return F.when(~F.exists(rows, lambda r: r.isNull()) & header.isNotNull(), F.array_join(lines, "\n"))


def to_yaml(header: Column, rows: Column) -> Column:
    def entries(row: Column) -> Column:
        return _pairs(
            header,
            row,
            lambda h, v, i: _text(F.when(i == 0, F.lit("- ")).otherwise(F.lit("  ")), h, ": ", v),
        )

    return F.array_join(F.flatten(F.transform(rows, entries)), "\n")


def xml_tag(name: Column) -> Column:
    tag = F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}_]", "_"), F.lit("_"))
    return F.when(tag == "", F.lit("col")).otherwise(tag)


def to_xml(header: Column, rows: Column) -> Column:
    def render(tags: Column) -> Column:
        def block(row: Column, number: Column) -> Column:
            cells = _pairs(tags, row, lambda t, v, _: _text("    <", t, ">", v, "</", t, ">"))
            return F.concat(
                F.array(_text('  <row id="', number, '">')), cells, F.array(F.lit("  </row>"))
            )

        body = F.flatten(_numbered(rows, block))
        return F.array_join(
            F.concat(F.array(F.lit("<table>")), body, F.array(F.lit("</table>"))), "\n"
        )

    return let(F.transform(header, xml_tag), render)


FORMATS: dict[str, Callable[[Column, Column], Column]] = {
    "tsv": to_tsv,
    "md": to_md,
    "prose": to_prose,
    "csv": to_csv,
    "csv_q": to_csv_q,
    "row_obj": to_row_obj,
    "col_sep": to_col_sep,
    "sec_sep": to_sec_sep,
    "json": to_json,
    "html": to_html,
    "yaml": to_yaml,
    "xml": to_xml,
}


#: Tokens (``text.token_count``) of a table's text beside those of its cells, given the tokens of the header, the number of rows and that of
#: columns. Holds where every row is as long as the header, and is not empty. Every cell stands between blanks or marks, so no token spans a seam.
SUMMED_TOKENS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "tsv": lambda names, n, k: names,
    "col_sep": lambda names, n, k: names + (n + 1) * (k - 1) * 3,
    "sec_sep": lambda names, n, k: names + (n + 1) * (k - 1),
    "prose": lambda names, n, k: n * (names + k * 2 + 3),
    "row_obj": lambda names, n, k: n * (names + k * 2 + 2),
    "html": lambda names, n, k: names + (n + 1) * (k * 7 + 7) + 7,
    "yaml": lambda names, n, k: n * (names + k + 1),
}


def format_table(fmt: str, header: Column, rows: Column) -> Column:
    if fmt not in FORMATS:
        raise ValueError(f"Unknown table format: {fmt}; known: {', '.join(FORMATS)}")
    return FORMATS[fmt](header, rows)
