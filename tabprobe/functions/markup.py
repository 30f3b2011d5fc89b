"""Which characters of a serialised table are markup rather than content."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabprobe import fixed_values as fixed
from tabprobe.functions.picks import indexes
from tabprobe.functions.text import TOKEN_PATTERN, let

SPAN_TYPE = "array<struct<start:int,end:int>>"
MARKUP_FORMATS = ("col_sep", "html", "json")

# java.util.regex: ?d makes LF the only line end; the possessive form of the
# string pattern accepts the same text without recursing once per character.
_JAVA_HTML = "(?dm)" + fixed.HTML_MARKUP
_JAVA_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _check(fmt: str) -> None:
    if fmt not in MARKUP_FORMATS:
        raise ValueError(f"Unsupported markup format: {fmt}")


def markup_length(text: Column, fmt: str) -> Column:
    """Number of markup characters, by what remains once one side is removed."""
    _check(fmt)
    if fmt == "json":
        return F.length(F.regexp_replace(text, _JAVA_JSON_STRING, '""'))
    if fmt == "html":
        content = F.regexp_replace(text, _JAVA_HTML, "")
    else:
        content = F.replace(
            F.replace(text, F.lit(fixed.COL_SEPARATOR), F.lit("")), F.lit("\n"), F.lit("")
        )
    return F.length(text) - F.length(content)


def _spans(fmt: str, text: str) -> list[tuple[int, int]]:
    if fmt == "html":
        return [m.span() for m in re.finditer(fixed.HTML_MARKUP, text, re.MULTILINE)]
    if fmt == "col_sep":
        return [m.span() for m in re.finditer(re.escape(fixed.COL_SEPARATOR) + r"|\n", text)]
    inner = [m.span(1) for m in re.finditer(fixed.JSON_STRING, text)]
    edges = [0, *[edge for span in inner for edge in span], len(text)]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b > a]


def _span_lists(lengths: np.ndarray, bounds: np.ndarray, missing: np.ndarray) -> pa.Array:
    """Arrow lists of (start, end) from flat bounds and the number of spans per row."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    flat = bounds.reshape(-1, 2).astype(np.int32)
    values = pa.StructArray.from_arrays(
        [pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["start", "end"]
    )
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(missing))


#: UTF-8 bytes of text that are scanned at once, in whole texts: what a scan holds beside its result is in proportion to it.
SLICE = 1 << 18


def _slices(texts: pa.Array) -> Iterator[slice]:
    """The rows of a batch in stretches of at most ``SLICE`` bytes, or of one longer text."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0)
    ends = np.cumsum(np.asarray(sizes), dtype=np.int64)
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        yield slice(begin, end)
        begin = end


def _by_slices(texts: pa.Array, scan: Callable[[slice], pa.Array]) -> pa.Array:
    """``scan`` of every stretch of a batch, put together."""
    parts = [scan(rows) for rows in _slices(texts)]
    return pa.concat_arrays(parts) if parts else scan(slice(0, 0))


def _pack(rows: list[Sequence[tuple[int, int]] | None]) -> pa.Array:
    lengths = np.array([0 if r is None else len(r) for r in rows], dtype=np.int64)
    flat = [edge for r in rows if r is not None for span in r for edge in span]
    return _span_lists(lengths, np.array(flat, dtype=np.int64), np.array([r is None for r in rows], dtype=bool))


def _axis(texts: list[str], stop: str = " ") -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts on one axis, a blank or ``stop`` after each, and where each text begins on it."""
    codes = np.frombuffer("".join(t + stop for t in texts).encode("utf-32-le"), dtype=np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


def _separator_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Spans per text and flat start/end pairs of the column separators and line ends, found in all texts at once."""
    separator = fixed.COL_SEPARATOR
    codes, first = _axis(texts, "\0")  # no part of the separator, so none reaches into the next text
    places = np.flatnonzero(codes == ord(separator[1])) - 1
    places = places[places >= 0]
    for i, letter in enumerate(separator):
        places = places[codes[np.minimum(places + i, len(codes) - 1)] == ord(letter)]
    # its last character is its first one: in a chain of places that share it, every other one counts
    index = np.arange(len(places))
    chain = np.maximum.accumulate(np.where(np.diff(places, prepend=-len(separator)) < len(separator), 0, index))
    mark = np.zeros(len(codes), bool)
    mark[places[(index - chain) % 2 == 0]] = True
    line_end = codes == ord("\n")
    begins = np.flatnonzero(mark | line_end)
    ends = begins + np.where(line_end[begins], 1, len(separator))
    row = np.searchsorted(first, begins, side="right") - 1
    return np.bincount(row, minlength=len(texts)), np.stack([begins - first[row], ends - first[row]], axis=1)


def _packed_spans(fmt: str, texts: list[str | None], starts: Sequence[int] | None = None) -> pa.Array:
    """Markup spans of every text, moved by ``starts`` if given; NULL for a null text."""
    if fmt != "col_sep":
        found = [None if t is None else _spans(fmt, t) for t in texts]
        return _pack(found if starts is None else [s and [(a + at, b + at) for a, b in s] for s, at in zip(found, starts)])
    known = [t for t in texts if t is not None]
    missing = np.array([t is None for t in texts], dtype=bool)
    lengths = np.zeros(len(texts), dtype=np.int64)
    lengths[~missing], bounds = _separator_spans(known)
    if starts is not None:
        bounds = bounds + np.repeat(np.array([0 if t is None else at for t, at in zip(texts, starts)], np.int64), lengths)[:, None]
    return _span_lists(lengths, bounds, missing)


def markup_spans(text: Column, fmt: str) -> Column:
    """Half-open markup spans in code points, one Arrow batch at a time.

    Offsets are a running sum over the matches of one text; built-in array functions
    would copy the array for every match, so this is the one place that scans in Python.
    """
    _check(fmt)

    @F.arrow_udf(SPAN_TYPE)
    def spans(texts: pa.Array) -> pa.Array:
        return _by_slices(texts, lambda rows: _packed_spans(fmt, texts[rows].to_pylist()))

    return spans(text)


def shift_spans(spans: Column, prompt: Column, table_text: Column) -> Column:
    """Spans of the table text moved to where that text sits in the prompt; NULL if absent."""
    offset = F.instr(prompt, table_text) - 1
    return F.when(
        offset >= 0,
        F.transform(
            spans,
            lambda s: F.struct((s["start"] + offset).alias("start"), (s["end"] + offset).alias("end")),
        ),
    )


_OTHER, _WORD, _BLANK = 0, 1, 2


@cache
def _character_classes() -> np.ndarray:
    """Word, blank or other for every code point, as ``TOKEN_PATTERN`` sees it."""
    classes = np.zeros(0x110000, dtype=np.int8)
    classes[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LN"]] = _WORD
    classes[ord("_")] = _WORD
    classes[[ord(c) for c in " \t\n\x0b\f\r"]] = _BLANK
    return classes


def word_offsets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Default tokenizer for a batch: (tokens per text, flat start/end pairs).

    The batch is laid on one character axis, a blank after each text; tokens begin and
    end where the character class changes, other characters stand alone.
    """
    codes, first = _axis(texts)
    kinds = _character_classes()[codes]
    before = np.concatenate([[_BLANK], kinds[:-1]])
    after = np.concatenate([kinds[1:], [_BLANK]])
    begins = np.flatnonzero((kinds == _OTHER) | ((kinds == _WORD) & (before != _WORD)))
    ends = np.flatnonzero((kinds == _OTHER) | ((kinds == _WORD) & (after != _WORD))) + 1
    row = np.searchsorted(first, begins, side="right") - 1
    bounds = np.stack([begins - first[row], ends - first[row]], axis=1)
    return np.bincount(row, minlength=len(texts)), bounds


def _tokenised(texts: list[str | None], tokenize: Callable | None) -> pa.Array:
    known = [t for t in texts if t is not None]
    if tokenize:
        found = iter(tokenize(known))
        return _pack([None if t is None else next(found) for t in texts])
    missing = np.array([t is None for t in texts], dtype=bool)
    lengths = np.zeros(len(texts), dtype=np.int64)
    lengths[~missing], bounds = word_offsets(known)
    return _span_lists(lengths, bounds, missing)


def token_offsets(text: Column, make_tokenizer: Callable[[], Callable] | None = None) -> Column:
    """Token offsets by ``TOKEN_PATTERN``, or by a pluggable tokenizer.

    ``make_tokenizer()`` runs once per worker task and returns a callable from a list
    of texts to one list of (start, end) pairs per text. It is called with some of a batch's texts at
    a time (``SLICE``), so that its pairs are never held for a whole batch.
    """

    @F.arrow_udf(SPAN_TYPE)
    def offsets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenize = make_tokenizer() if make_tokenizer else None
        for batch in batches:
            yield _by_slices(batch, lambda rows: _tokenised(batch[rows].to_pylist(), tokenize))

    return offsets(text)


def _starts(line: Column, sizes: Column) -> Column:
    """Spans that begin at each ``x`` of a line of one letter per character, with the i-th of ``sizes`` as the i-th one's length."""

    def found(letters: Column) -> Column:
        return F.filter(indexes(F.length(letters)), lambda i: F.substring(letters, i + 1, 1) == F.lit(b"x"))

    def placed(lengths: Column) -> Column:
        return F.transform(let(line.cast("binary"), found), lambda s, i: F.struct(s.alias("start"), (s + F.get(lengths, i)).alias("end")))

    return let(sizes, placed)


def _matched(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m))


def token_offsets_in_place(text: Column) -> Column:
    """Token offsets by ``TOKEN_PATTERN``, by built-in functions: rows stay dealt as they are, which Spark doesn't see behind a Python function.

    What goes on with a word becomes blank, so that what is visible begins a token; the places of it are read from the line, in proportion to its length.
    """
    # java.util.regex looks behind by UTF-16 units, so words are made of one letter first
    words = F.regexp_replace(text, r"[\p{L}\p{N}_]", "w")
    begun = F.regexp_replace(F.regexp_replace(words, "(?<=w)w", " "), r"\S", "x")
    return F.when(text.isNotNull(), _starts(begun, _matched(text, TOKEN_PATTERN)))


def separator_spans_in_place(text: Column) -> Column:
    """Markup spans of a text in the format ``col_sep``, by built-in functions as in ``token_offsets_in_place``."""
    separator = re.escape(fixed.COL_SEPARATOR)
    mark = "x" + "0" * (len(fixed.COL_SEPARATOR) - 1)

    def drawn(line: Column) -> Column:
        return F.array_join(F.transform(F.split(line, separator), lambda c: F.repeat(F.lit("0"), F.length(c))), mark)

    begun = F.array_join(F.transform(F.split(text, "\n"), drawn), "x")
    return F.when(text.isNotNull(), _starts(begun, _matched(text, separator + r"|\n")))


def overlapping(tokens: pa.ListArray, spans: pa.ListArray) -> pa.Array:
    """Per row, the indexes of tokens that touch a span; spans sorted and disjoint.

    Rows are laid on one axis, far enough apart, so that two binary searches answer
    for the whole batch.
    """
    missing = np.asarray(tokens.is_null()) | np.asarray(spans.is_null())

    def axis(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.asarray(pa.compute.fill_null(lists.value_lengths(), 0))
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), lengths)
        return lengths, row, np.asarray(flat.field("start")).astype(np.int64), np.asarray(flat.field("end")).astype(np.int64)

    lengths, token_row, starts, ends = axis(tokens)
    _, span_row, span_starts, span_ends = axis(spans)
    gap = int(max(ends.max(initial=0), span_ends.max(initial=0))) + 1
    begun = np.searchsorted(span_starts + span_row * gap, ends + token_row * gap, side="left")
    over = np.searchsorted(span_ends + span_row * gap, starts + token_row * gap, side="right")
    hit = (begun > over) & (ends > starts) & ~missing[token_row]
    index = np.arange(len(starts)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    counts = np.bincount(token_row[hit], minlength=len(tokens))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(index[hit].astype(np.int32)), mask=pa.array(missing)
    )


def markup_tokens(
    prompt: Column, start: Column, length: Column, fmt: str,
    make_tokenizer: Callable[[], Callable] | None = None,
) -> Column:
    """struct<n_tokens, positions>: the tokens of a prompt, and which of them are markup.

    The table's text is the ``length`` characters from ``start``; a negative start gives
    NULL positions. Tokens and spans stay inside the worker: only the positions return.
    """
    _check(fmt)

    @F.arrow_udf("struct<n_tokens:int,positions:array<int>>")
    def locate(
        batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]],
    ) -> Iterator[pa.Array]:
        tokenize = make_tokenizer() if make_tokenizer else None
        for prompts, starts, lengths in batches:

            def scan(rows: slice) -> pa.Array:
                texts = prompts[rows].to_pylist()
                places = starts[rows].to_pylist()
                tables = [
                    None if text is None or at is None or at < 0 else text[at : at + n]
                    for text, at, n in zip(texts, places, lengths[rows].to_pylist())
                ]
                tokens = _tokenised(texts, tokenize)
                return pa.StructArray.from_arrays(
                    [tokens.value_lengths(), overlapping(tokens, _packed_spans(fmt, tables, places))], names=["n_tokens", "positions"]
                )

            yield _by_slices(prompts, scan)

    return locate(prompt, start, length)


def counted_tokens(text: Column, make_counter: Callable[[], Callable]) -> Column:
    """Token counts by a pluggable tokenizer; ``make_counter()`` runs once per worker task."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = make_counter()
        for texts in batches:
            yield pd.Series([int(n) for n in counter(texts)], index=texts.index)

    return count(text)


__all__ = [
    "MARKUP_FORMATS",
    "SPAN_TYPE",
    "counted_tokens",
    "markup_length",
    "markup_spans",
    "markup_tokens",
    "overlapping",
    "separator_spans_in_place",
    "shift_spans",
    "token_offsets",
    "token_offsets_in_place",
    "word_offsets",
]
