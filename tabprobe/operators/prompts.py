"""Instances to prompts with token counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe import fixed_values as fixed
from tabprobe.functions import prompts as P
from tabprobe.functions.formats import FORMATS
from tabprobe.functions.text import fill_dynamic, token_count


def build_prompts(
    instances: DataFrame,
    one_shot: bool = False,
    formats: Sequence[str] = tuple(FORMATS),
    chat: str | Callable[[Column], Column] = "bracket",
    count_tokens: Callable[[Column], Column] = token_count,
) -> DataFrame:
    """Add is_list, stop_strings, max_new_tokens, prompt, prompt_tokens; map-only.

    With the built-in token count and instances that carry ``text_tokens``, the count is
    the sum of the parts' counts: a table's text is then measured once, not once per task;
    with ``question_tokens``, a question once, not once per format.
    """
    render = P.CHAT_LAYOUTS[chat] if isinstance(chat, str) else chat
    if render is P.bracket_chat:
        render = partial(render, framed=True)
    is_list = P.is_list_task(F.col("task"))
    text, question, measured = F.col("table_text"), F.col("question"), F.col("text_tokens")
    shot = (F.col("task"), F.col("fmt"), is_list, formats)
    if one_shot:
        body = P.one_shot_body(text, question, *shot)
    else:
        body = P.zero_shot_body(text, question, is_list)
    built = instances.withColumns(
        {
            "is_list": is_list,
            "stop_strings": P.stop_strings(is_list),
            "max_new_tokens": P.max_new_tokens(is_list),
            "prompt": render(body),
        }
    )
    additive = count_tokens is token_count and isinstance(chat, str)
    if not (additive and "text_tokens" in instances.columns):
        return built.withColumn("prompt_tokens", count_tokens(F.col("prompt"))).drop("question_tokens")
    asked = F.col("question_tokens") if "question_tokens" in instances.columns else token_count(question)
    if one_shot:
        tokens = P.one_shot_tokens(measured, asked, *shot)
    else:
        tokens = P.zero_shot_tokens(measured, asked, is_list)
    return built.withColumn("prompt_tokens", tokens + P.layout_tokens(chat)).drop("text_tokens", "question_tokens")


def judge_prompts(
    predictions: DataFrame,
    target_field: str = "raw",
    version: str = "current",
    chat: str | Callable[..., Column] = "bracket",
    count_tokens: Callable[[Column], Column] = token_count,
) -> DataFrame:
    """Add judge_prompt (chat-rendered, no system message) and judge_prompt_tokens."""
    render = P.CHAT_LAYOUTS[chat] if isinstance(chat, str) else chat
    body = P.judge_prompt(
        F.col("task"), F.col("question"), F.col("gold"), F.col(target_field), version
    )
    return predictions.withColumns(
        {"target_field": F.lit(target_field), "judge_prompt": render(body, system=None)}
    ).withColumn("judge_prompt_tokens", count_tokens(F.col("judge_prompt")))


def external_prompts(
    records: DataFrame,
    contexts: dict[str, str] = fixed.EXTERNAL_CONTEXTS,
    system: str = fixed.EXTERNAL_SYSTEM_PROMPT,
    chat: str | Callable[..., Column] = "bracket",
) -> DataFrame:
    """Row-supplied templates filled with each context form: (record, fmt, prompt)."""
    render = P.CHAT_LAYOUTS[chat] if isinstance(chat, str) else chat
    forms = F.array(
        *[
            F.struct(F.lit(fmt).alias("fmt"), F.col(f"context.{field}").alias("context_text"))
            for fmt, field in contexts.items()
        ]
    )
    body = fill_dynamic(
        F.col("instruction"),
        context=F.col("s.context_text"),
        question=F.get("question_list", F.lit(0)),
    )
    return (
        records.withColumn("s", F.explode(forms))
        .withColumns({"fmt": F.col("s.fmt"), "prompt": render(body, system=system)})
        .drop("s")
    )


def choice_prompts(records: DataFrame, n: int | None = None) -> DataFrame:
    """Lettered multiple-choice texts of all records, or of the first n by pos."""
    kept = records if n is None else records.orderBy("pos").limit(n)
    return kept.select(
        "pos", P.choice_prompt(F.col("question"), F.col("choices")).alias("text")
    )
