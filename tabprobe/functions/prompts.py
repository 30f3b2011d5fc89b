"""Prompt text as Column expressions: bodies, chat rendering, judge prompts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cache, partial

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tabprobe import fixed_values as fixed
from tabprobe.functions.formats import FORMATS, format_table
from tabprobe.functions.text import fill, fill_count, strip, token_count


def is_list_task(task: Column) -> Column:
    return task.isin(*fixed.LIST_TASKS)


def stop_strings(is_list: Column) -> Column:
    def literal(stops: Sequence[str]) -> Column:
        return F.array(*[F.lit(s) for s in stops])

    return F.when(is_list, literal(fixed.STOP_STRINGS_LIST)).otherwise(
        literal(fixed.STOP_STRINGS_QA)
    )


def max_new_tokens(is_list: Column) -> Column:
    return F.when(is_list, F.lit(fixed.MAX_NEW_TOKENS_LIST)).otherwise(
        F.lit(fixed.MAX_NEW_TOKENS_SHORT)
    )


def _by_kind(is_list: Column, make: Callable[..., Column], **values: Column) -> Column:
    return F.when(is_list, make(fixed.LIST_TEMPLATE, **values)).otherwise(
        make(fixed.QA_TEMPLATE, **values)
    )


def zero_shot_body(table_text: Column, question: Column, is_list: Column) -> Column:
    return _by_kind(is_list, fill, table_text=table_text, question=question)


def zero_shot_tokens(text_tokens: Column, question_tokens: Column, is_list: Column) -> Column:
    """Tokens of ``zero_shot_body`` by the built-in pattern, given those of the table and the question."""
    return _by_kind(is_list, fill_count, table_text=text_tokens, question=question_tokens)


def _cases(value: Column, results: Mapping[str, Column], default: str | None = None) -> Column:
    names = list(results)
    chain = F.when(value == names[0], results[names[0]])
    for name in names[1:]:
        chain = chain.when(value == name, results[name])
    return chain.otherwise(results[default]) if default else chain


@cache
def _example_texts() -> dict[str, str]:
    """The worked example's table in every format: evaluated once, then a literal."""
    header = F.array(*[F.lit(h) for h in fixed.EXAMPLE_HEADER])
    rows = F.array(*[F.array(*[F.lit(v) for v in row]) for row in fixed.EXAMPLE_ROWS])
    one = SparkSession.active().range(1, numPartitions=1)
    return one.select(*[format_table(name, header, rows).alias(name) for name in FORMATS]).first().asDict()


def example_table(fmt: Column, formats: Sequence[str], shape: Callable[[Column], Column] = lambda c: c) -> Column:
    """The worked example's table in the row's own format."""
    return _cases(fmt, {name: shape(F.lit(_example_texts()[name])) for name in formats})


def _example_part(task: Column, part: int, shape: Callable[[Column], Column] = lambda c: c) -> Column:
    values = {name: shape(F.lit(qa[part])) for name, qa in fixed.EXAMPLE_QA.items()}
    return _cases(task, values, default=fixed.EXAMPLE_DEFAULT_TASK)


def one_shot_body(
    table_text: Column,
    question: Column,
    task: Column,
    fmt: Column,
    is_list: Column,
    formats: Sequence[str],
) -> Column:
    """One worked example, then the question; both share the task's instruction.

    The example is a complete zero-shot body followed by its answer, so the same
    template serves twice.
    """
    example = zero_shot_body(example_table(fmt, formats), _example_part(task, 0), is_list)
    return F.concat(
        example,
        F.lit(" "),
        _example_part(task, 1),
        F.lit("\n\n"),
        zero_shot_body(table_text, question, is_list),
    )


def one_shot_tokens(
    text_tokens: Column,
    question_tokens: Column,
    task: Column,
    fmt: Column,
    is_list: Column,
    formats: Sequence[str],
) -> Column:
    example = _by_kind(
        is_list,
        fill_count,
        table_text=example_table(fmt, formats, token_count),
        question=_example_part(task, 0, token_count),
    )
    answer = _example_part(task, 1, token_count)
    return example + answer + zero_shot_tokens(text_tokens, question_tokens, is_list)


def with_system(system: Column, content: Column) -> Column:
    return F.concat(F.lit("<<SYS>>\n"), system, F.lit("\n<</SYS>>\n\n"), content)


def user_turn(content: Column, bos: str = "<s>", framed: bool = False) -> Column:
    return F.concat(F.lit(bos + "[INST] "), content if framed else strip(content), F.lit(" [/INST]"))


def assistant_turn(content: Column, eos: str = "</s>") -> Column:
    return F.concat(F.lit(" "), strip(content), F.lit(" " + eos))


def bracket_chat(
    body: Column, system: str | None = fixed.SYSTEM_PROMPT, bos: str = "<s>", framed: bool = False
) -> Column:
    """System plus user message in the bracket chat layout.

    A ``framed`` body begins and ends with visible text of its template. There is nothing to strip then, and stripping a
    prompt costs more than building it.
    """
    content = body if system is None else with_system(F.lit(system), body)
    return user_turn(content, bos, framed)


def plain_chat(body: Column, system: str | None = fixed.SYSTEM_PROMPT) -> Column:
    return body if system is None else F.concat(F.lit(system + "\n\n"), body)


CHAT_LAYOUTS: dict[str, Callable[..., Column]] = {"bracket": bracket_chat, "plain": plain_chat}


def layout_tokens(chat: str) -> Column:
    """Tokens that a chat layout adds to a body: a constant."""
    return token_count(CHAT_LAYOUTS[chat](F.lit("")))


def _judge_template(template: str, task: Column, question: Column, gold: Column, prediction: Column) -> Column:
    return fill(template, task=task, question=question, gold=gold, prediction=prediction)


JUDGE_BUILDERS: dict[str, Callable[..., Column]] = {
    version: partial(_judge_template, template) for version, template in fixed.JUDGE_PROMPTS.items()
}


def judge_prompt(
    task: Column, question: Column, gold: Column, prediction: Column, version: str = "current"
) -> Column:
    if version not in JUDGE_BUILDERS:
        raise ValueError(f"no judge prompt is called {version}; known: {sorted(JUDGE_BUILDERS)}")
    return JUDGE_BUILDERS[version](task, question, gold, prediction)


def choice_prompt(question: Column, choices: Column) -> Column:
    """Multiple-choice text: lettered choices, one per line."""
    lettered = F.transform(
        choices, lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c)
    )
    return fill(fixed.CHOICE_TEMPLATE, question=question, choices=F.array_join(lettered, "\n"))
