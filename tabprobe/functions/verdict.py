"""Judge verdicts: tolerant JSON parsing, tri-state booleans, row metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabprobe import fixed_values as fixed
from tabprobe.functions.text import let, strip

_FIELDS = [*fixed.VERDICT_FLAGS, "score", "reason"]
_OBJECT = "STRUCT<" + ", ".join(f"{name}: STRING" for name in _FIELDS) + ">"
_STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
_JSON_SPACE = " \t\n\r"


def tri_state(text: Column) -> Column:
    """true/false in any case, trimmed; everything else is NULL, also 1 and yes."""
    word = F.lower(strip(text.cast("string")))
    return F.when(word == "true", True).when(word == "false", False)


def _strict_object(text: Column) -> Column:
    """The verdict fields if ``text`` is exactly one JSON object, else NULL.

    The parser alone stops after the first value. Inside [..] and inside {"v":..}
    anything left over breaks at least one of the two wrappers, or makes the array
    longer than one.
    """
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"ARRAY<{_OBJECT}>", _STRICT)
    boxed = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"v {_OBJECT}", _STRICT)
    return let(
        listed,
        lambda items: F.when(
            (F.size(items) == 1) & boxed["v"].isNotNull(), F.get(items, F.lit(0))
        ),
    )


def _json_value(text: Column) -> Column:
    """Whether ``text`` is one complete JSON value of any type."""
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "ARRAY<STRING>", _STRICT)
    boxed = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v STRING", _STRICT)
    return (F.size(listed) == 1) & boxed["v"].isNotNull()


def parse_object(text: Column) -> Column:
    """Whole text, else first brace to last brace; other JSON values do not count."""
    starts_object = F.ltrim(text, F.lit(_JSON_SPACE)).startswith("{")
    nothing = F.lit(None).cast(_OBJECT)
    return let(
        F.regexp_extract(text, r"(?s)\{.*\}", 0),
        lambda braces: F.when(braces == "", nothing)
        .when(~starts_object & F.coalesce(_json_value(text), F.lit(False)), nothing)
        .otherwise(_strict_object(braces)),
    )


def parse_verdict(text: Column) -> Column:
    """Struct of five nullable booleans, score and reason.

    Text without a usable object gives NULLs and its own first characters as reason.
    """

    def build(obj: Column) -> Column:
        flags = [tri_state(obj[name]).alias(name) for name in fixed.VERDICT_FLAGS]
        score = obj["score"].try_cast("double").alias("score")
        reason = F.when(obj.isNull(), F.substring(text, 1, fixed.REASON_CHARS)).otherwise(
            F.coalesce(obj["reason"], F.lit(""))
        )
        return F.struct(*flags, score, reason.alias("reason"))

    return let(parse_object(text), build)


def metric_columns() -> dict[str, Column]:
    """Row metrics in three-valued logic: unknown stays NULL, false AND unknown is 0."""
    correct = F.col("content_correct")
    tidy = correct & ~F.col("overinclusive")
    metrics = {
        "relaxed_accuracy": correct,
        "accuracy_clean": tidy,
        "strict_accuracy": tidy & ~F.col("instruction_following_error"),
        "format_correct_rate": F.col("format_correct"),
        "overinclusive_rate": F.col("overinclusive"),
        "instruction_following_error_rate": F.col("instruction_following_error"),
    }
    return {name: value.cast("double") for name, value in metrics.items()}
