"""Answer extraction from raw output, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabprobe import fixed_values as fixed
from tabprobe.functions.text import let, split_lines, strip


def cut_at_stops(raw: Column, stops: Sequence[str]) -> Column:
    """Keep what precedes the first occurrence of each stop string."""
    for stop in stops:
        raw = F.substring_index(raw, stop, 1)
    return raw


def answer_part(raw: Column, stops: Sequence[str]) -> Column:
    return strip(F.substring_index(cut_at_stops(raw, stops), fixed.ANSWER_MARK, -1))


def _clean_lines(text: Column, chars: str) -> Column:
    lines = F.transform(split_lines(text), lambda line: strip(strip(line), chars))
    return F.filter(lines, lambda line: line != "")


def extract_list(raw: Column, stops: Sequence[str] = fixed.STOP_STRINGS_LIST) -> Column:
    return F.array_join(_clean_lines(answer_part(raw, stops), fixed.LIST_STRIP), "\n")


def _clean(text: Column) -> Column:
    return strip(strip(text), fixed.SCALAR_STRIP)


def _unkeyed(line: Column) -> Column:
    """'- key: value' keeps the value."""
    pattern = "(?U)" + fixed.KEYED_LINE
    return F.when(line.rlike(pattern), _clean(F.regexp_extract(line, pattern, 1))).otherwise(line)


def _shortened(line: Column) -> Column:
    first_delimiter: Column | None = None
    for delimiter in fixed.SCALAR_DELIMITERS:
        part = _clean(F.substring_index(line, delimiter, 1))
        present = F.contains(line, F.lit(delimiter))
        first_delimiter = (
            F.when(present, part) if first_delimiter is None else first_delimiter.when(present, part)
        )
    return F.when(
        F.length(line) > fixed.SCALAR_MAX_CHARS,
        first_delimiter.otherwise(F.substring(line, 1, fixed.SCALAR_MAX_CHARS)),
    ).otherwise(line)


def extract_scalar(raw: Column, stops: Sequence[str] = fixed.STOP_STRINGS_QA) -> Column:
    first = F.get(_clean_lines(answer_part(raw, stops), fixed.SCALAR_STRIP), F.lit(0))
    answer = let(first, lambda line: let(_unkeyed(line), _shortened))
    return F.when(raw.isNotNull(), F.coalesce(answer, F.lit("")))


def extract_answer(raw: Column, is_list: Column) -> Column:
    """Answer by kind of task; marked-as-skipped rows give an empty answer."""
    return (
        F.when(raw.startswith(fixed.SKIP_PREFIX), F.lit(""))
        .when(is_list, extract_list(raw))
        .otherwise(extract_scalar(raw))
    )
