"""The table formats as SQL functions: ``SELECT fmt_md(header, rows) FROM tables``.

The bodies are plain SQL, which the optimizer inlines. They give the same text as the
Column builders in ``functions.formats``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tabprobe.fixed_values import COL_SEPARATOR, SECTION_SEPARATOR

_ARGUMENTS = "header ARRAY<STRING>, body ARRAY<ARRAY<STRING>>"


def _row(make: str, joiner: str, names: str = "header") -> str:
    """One row's cells: ``make`` sees the name as h, the cell as v and its index as j."""
    cell = make.replace("{h}", f"{names}[j]")
    return f"array_join(transform(slice(r, 1, size({names})), (v, j) -> {cell}), '{joiner}')"


def _delimited(separator: str) -> str:
    return (
        f"array_join(concat(array(array_join(header, '{separator}')), "
        f"transform(body, r -> array_join(r, '{separator}'))), '\\n')"
    )


def _csv(cell: str) -> str:
    def line(cells: str) -> str:
        return (
            f"""if(size({cells}) = 1 AND get({cells}, 0) = '', '""', """
            f"array_join(transform({cells}, v -> {cell}), ','))"
        )

    return (
        f"trim(TRAILING '\\r\\n' FROM array_join(concat(array({line('header')}), "
        f"transform(body, r -> {line('r')})), '\\r\\n'))"
    )


_QUOTED = """concat('"', replace(v, '"', '""'), '"')"""
_MINIMAL = f"""if(v rlike '[",\\r\\n]', {_QUOTED}, v)"""


def _json_text(value: str) -> str:
    escaped = value
    for raw, out in (
        (r"\\", r"\\\\"), ('"', r"\\\""), (r"\n", r"\\n"), (r"\r", r"\\r"), (r"\t", r"\\t"), (r"\b", r"\\b"),
        (r"\u000c", r"\\f"),
    ):
        escaped = f"replace({escaped}, '{raw}', '{out}')"
    spelled = (
        f"array_join(transform(split({escaped}, ''), c -> if(c rlike r'[\\x00-\\x1f]', "
        "concat('\\\\u', lower(lpad(hex(ascii(c)), 4, '0'))), c)), '')"
    )
    return f"""concat('"', if({value} rlike r'["\\\\\\x00-\\x1f]', {spelled}, {value}), '"')"""


def _json() -> str:
    field = f"concat(h, {_json_text('v')})"
    plain = (
        "array_join(transform(slice(r, 1, size(keys)), (v, j) -> "
        + field.replace("concat(h,", "concat(keys[j],")
        + "), ',\\n')"
    )
    last = "get(r, least(size(keys), size(r)) - int(array_position(reverse(slice(keys, 1, least(size(keys), size(r)))), h)))"
    merged = (
        "array_join(transform(array_distinct(slice(keys, 1, least(size(keys), size(r)))), h -> "
        f"get(transform(array({last}), v -> {field}), 0)), ',\\n')"
    )
    record = (
        "if(size(r) = 0 OR size(keys) = 0, '  {}', concat('  {\\n', "
        f"if(size(array_distinct(keys)) = size(keys), {plain}, {merged}), '\\n  }}'))"
    )
    keys = f"transform(header, v -> concat('    ', {_json_text('v')}, ': '))"
    return (
        f"if(size(body) = 0, '[]', get(transform(array({keys}), keys -> "
        f"concat('[\\n', array_join(transform(body, r -> {record}), ',\\n'), '\\n]')), 0))"
    )


def _html_block(cells: str, tag: str) -> str:
    inner = f"concat('  <tr>\\n    <{tag}>', array_join({cells}, '</{tag}>\\n    <{tag}>'), '</{tag}>\\n  </tr>')"
    return f"CASE WHEN {cells} IS NULL THEN NULL WHEN exists({cells}, v -> v IS NOT NULL) THEN {inner} ELSE '  <tr>\\n  </tr>' END"


_WIDTHS = (
    "transform(header, (h, j) -> greatest(length(h), "
    "coalesce(array_max(transform(body, r -> length(get(r, j)))), 1), 3))"
)
_MD_LINE = "concat('| ', array_join(transform(widths, (w, j) -> rpad(coalesce(get({cells}, j), ''), w, ' ')), ' | '), ' |')"
_TAG = r"coalesce(nullif(trim(BOTH '_' FROM regexp_replace(h, r'[^\p{L}\p{N}_]', '_')), ''), 'col')"

BODIES = {
    "tsv": _delimited("\\t"),
    "md": (
        f"get(transform(array({_WIDTHS}), widths -> array_join(concat(array({_MD_LINE.format(cells='header')}, "
        "concat('| ', array_join(transform(widths, w -> repeat('-', w)), ' | '), ' |')), "
        f"transform(body, r -> {_MD_LINE.format(cells='r')})), '\\n')), 0)"
    ),
    "prose": f"array_join(transform(body, (r, i) -> concat('Row ', i + 1, ': ', {_row('''concat({h}, ' is ', v)''', ', ')}, '.')), ' ')",
    "csv": _csv(_MINIMAL),
    "csv_q": _csv(_QUOTED),
    "row_obj": (
        "array_join(transform(body, (r, i) -> array_join(concat(array(concat('Row ', i + 1)), "
        "transform(slice(r, 1, size(header)), (v, j) -> concat(header[j], '=', v))), ' | ')), '\\n')"
    ),
    "col_sep": _delimited(COL_SEPARATOR),
    "sec_sep": _delimited(SECTION_SEPARATOR),
    "json": _json(),
    "html": (
        f"if(exists(body, r -> r IS NULL) OR header IS NULL, NULL, array_join(concat(array('<table>', {_html_block('header', 'th')}), "
        f"transform(body, r -> {_html_block('r', 'td')}), array('</table>')), '\\n'))"
    ),
    "yaml": (
        "array_join(flatten(transform(body, r -> transform(slice(r, 1, size(header)), "
        "(v, j) -> concat(if(j = 0, '- ', '  '), header[j], ': ', v)))), '\\n')"
    ),
    "xml": (
        f"get(transform(array(transform(header, h -> {_TAG})), tags -> array_join(concat(array('<table>'), "
        "flatten(transform(body, (r, i) -> concat(array(concat('  <row id=\"', i + 1, '\">')), "
        "transform(slice(r, 1, size(tags)), (v, j) -> concat('    <', tags[j], '>', v, '</', tags[j], '>')), "
        "array('  </row>')))), array('</table>')), '\\n')), 0)"
    ),
}


def register_formats(spark: SparkSession) -> list[str]:
    """Create fmt_<name>(header, rows) for the session; returns the names."""
    for name, body in BODIES.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION fmt_{name}({_ARGUMENTS}) RETURNS STRING RETURN {body}"
        )
    return [f"fmt_{name}" for name in BODIES]
