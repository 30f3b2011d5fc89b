"""Text helpers on Columns: Unicode strip, line splitting, templates, keys."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as a Unicode-aware strip sees it (29 code points, all below U+3001).
UNICODE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
# A word (letters, digits, underscore) or one other visible character. Means the
# same in java.util.regex and in RE2.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
_NOT_TOKEN_START = r"(?<=[\p{L}\p{N}_])[\p{L}\p{N}_]+|\s+"


def strip(text: Column, chars: str = UNICODE_SPACE) -> Column:
    """Remove leading and trailing characters of ``chars`` (default: whitespace)."""
    return F.trim(text, F.lit(chars))


def split_lines(text: Column) -> Column:
    """Split at every line boundary, including CR, VT, FF, NEL and U+2028/9."""
    return F.split(text, LINE_BREAK)


def escape_newlines(text: Column) -> Column:
    """LF to backslash-n, for line-based interchange files.

    Lossy for text that already holds backslash-n; columnar files need none of it.
    """
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def unescape_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fill(template: str, **values: Column) -> Column:
    """Fill a literal template in one pass, so values are never expanded again."""
    pieces = []
    for literal, field, _spec, _conversion in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            pieces.append(values[field].cast("string"))
    return F.concat(*pieces)


def fill_count(template: str, **counts: Column) -> Column:
    """Token count of a filled template from the counts of its values.

    Holds for templates whose literal text separates the values by blanks or
    punctuation, so that no token spans a seam. The literals' counts fold to a constant.
    """
    total = F.lit(0)
    for literal, field, _spec, _conversion in Formatter().parse(template):
        if literal:
            total = total + token_count(F.lit(literal))
        if field is not None:
            total = total + counts[field]
    return total


def fill_dynamic(template: Column, **values: Column) -> Column:
    """Fill templates that come from the data, one template per row.

    The template is cut into doubled braces, known placeholders and plain text,
    and each piece is replaced on its own. A template with a stray brace or an
    unknown placeholder gives NULL.
    """
    names = "|".join(r"\{" + name + r"\}" for name in values)
    pieces = F.regexp_extract_all(template, F.lit(r"(\{\{|\}\}|" + names + r"|[^{}]+)"), F.lit(0))

    def piece(p: Column) -> Column:
        out = F.when(p == "{{", F.lit("{")).when(p == "}}", F.lit("}"))
        for name, value in values.items():
            out = out.when(p == "{" + name + "}", value)
        return out.otherwise(p)

    return F.when(
        F.array_join(pieces, "") == template, F.array_join(F.transform(pieces, piece), "")
    )


def token_count(text: Column) -> Column:
    """Number of tokens by ``TOKEN_PATTERN``.

    Counted as what is left of the text when all that does not start a token is
    removed: the rest of each word, and blanks. No list of tokens is built.
    """
    return F.length(F.regexp_replace(text, _NOT_TOKEN_START, ""))


def row_key(*columns: Column) -> Column:
    """Null-safe, collision-safe digest of several columns.

    Every part is length-prefixed, so ('a|b','c') and ('a','b|c') differ and NULL
    differs from ''. Joins on it shuffle 32 bytes instead of whole questions.
    """
    parts = [
        F.coalesce(F.concat(F.length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-"))
        for c in columns
    ]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def pipe_key(*columns: Column) -> Column:
    """Human-readable key: parts joined by a pipe."""
    return F.concat_ws("|", *[c.cast("string") for c in columns])


def seeded_digest(seed: Column, key: Column, bits: int = 256) -> Column:
    return F.sha2(F.concat(seed.cast("string"), F.lit(":"), key), bits)
