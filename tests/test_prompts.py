import pytest
from pyspark.sql import functions as F

from tabprobe.fixed_values import EXTERNAL_SYSTEM_PROMPT, STOP_STRINGS_LIST, STOP_STRINGS_QA, SYSTEM_PROMPT
from tabprobe.functions.formats import FORMATS
from tabprobe.functions.markup import counted_tokens
from tabprobe.functions.prompts import bracket_chat
from tabprobe.functions.text import fill, fill_dynamic, token_count
from tabprobe.operators import prompts
from tabprobe.operators.conversations import render_conversations
from tabprobe.operators.serialise import generate_instances, question_instances
from tests.test_tasks import CLUBS, frame

HEAD = f"<s>[INST] <<SYS>>\n{SYSTEM_PROMPT}\n<</SYS>>\n\n"


def test_zero_shot(spark):
    built = prompts.build_prompts(generate_instances(frame(spark, t=CLUBS), ["tsv"])).collect()
    text = "\n".join("\t".join(r) for r in [CLUBS[0], *CLUBS[1]])
    for row in built:
        rule = (
            "List each value on a separate line. No extra text."
            if row.task in ("row_retrieval", "col_retrieval")
            else "Give a short answer: one word, number, or phrase. No explanation."
        )
        assert row.prompt == (
            f"{HEAD}Table:\n{text}\n---\nUsing only the table above, answer the question.\n{rule}\n\n"
            f"Question: {row.question}\nAnswer: [/INST]"
        )
        assert list(row.stop_strings) == (STOP_STRINGS_LIST if row.is_list else STOP_STRINGS_QA)
        assert row.max_new_tokens == (256 if row.is_list else 64)


def test_one_shot(spark):
    instances = generate_instances(frame(spark, t=CLUBS), ["sec_sep"]).withColumn(
        "task", F.when(F.col("task") == "size_detection", "other").otherwise(F.col("task"))
    )
    built = {r.task: r.prompt for r in prompts.build_prompts(instances, one_shot=True).collect()}
    start = f"{HEAD}Table:\nPlayer § Club § Goals\nMessi § Barcelona § 91\nRonaldo § Real Madrid § 450\n---\n"
    assert all(p.startswith(start) for p in built.values())
    assert "Question: What value is in row 1, column 'Club'?\nAnswer: Barcelona\n\nTable:\nTeam" in built["other"]
    assert "\nAnswer: 91\n450\n\nTable:\n" in built["col_retrieval"]


@pytest.mark.parametrize("one_shot", [False, True])
def test_added_counts_equal_counting_the_prompt(spark, one_shot):
    odd = (["é x", "", "a_b"], [["1.5", "名前", "_"], ["", "-", "x\ny"]])
    instances = generate_instances(frame(spark, a=CLUBS, b=odd), tuple(FORMATS))
    built = prompts.build_prompts(instances, one_shot=one_shot).withColumn(
        "n", token_count(F.col("prompt"))
    )
    assert built.filter(F.col("n") != F.col("prompt_tokens")).count() == 0
    assert built.select("fmt").distinct().count() == 12


@pytest.mark.parametrize("one_shot", [False, True])
def test_framed_bodies_are_not_stripped(spark, one_shot):
    odd = ([" ", "a "], [["\t", " x"], ["", "\n"]])
    instances = generate_instances(frame(spark, a=CLUBS, b=odd), ["tsv", "yaml"])
    built = prompts.build_prompts(instances, one_shot=one_shot)
    stripped = prompts.build_prompts(instances, one_shot=one_shot, chat=lambda body: bracket_chat(body))
    keys = ["table_id", "task_seq", "fmt", "prompt", "prompt_tokens"]
    assert sorted(built.select(keys).collect()) == sorted(stripped.select(keys).collect())
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    assert "trim(" not in plan
    assert "question_tokens" in plan and not {"question_tokens", "text_tokens"} & set(built.columns)


def test_token_count(spark):
    cases = {"": 0, "a": 1, " a_1  b.c ": 4, "né 名前!": 3, "...": 3, "\n\t": 0, "x-y": 3}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, n int")
    assert df.filter(token_count(F.col("t")) != F.col("n")).count() == 0


def test_custom_counter(spark):
    df = spark.createDataFrame([("a b c",), ("d",)], "t string")
    count = counted_tokens(F.col("t"), lambda: (lambda texts: texts.str.split().str.len()))
    assert [r[0] for r in df.select(count).collect()] == [3, 1]


def test_questions(spark):
    tables = frame(spark, t=CLUBS).withColumns(
        {"question": F.lit("who?"), "answers": F.array(F.lit("a"), F.lit("b"))}
    )
    row = prompts.build_prompts(question_instances(tables, ["tsv"])).first()
    assert (row.task, row.gold, row.n_rows, row.n_cols, row.is_list) == ("wtq_qa", "a\nb", 9, 4, False)


def test_templates_are_filled_once(spark):
    df = spark.createDataFrame([("{question} {x}", "q")], "a string, b string")
    assert df.select(fill("<{t}|{{}}|{q}>", t=F.col("a"), q=F.col("b"))).first()[0] == "<{question} {x}|{}|q>"


def test_templates_from_data(spark):
    df = spark.createDataFrame(
        [("A {context} {{b}} {question}!",), ("{nope}",), ("open { brace",), ("",), ("{{}}{question}",)], "t string"
    )
    filled = fill_dynamic(F.col("t"), context=F.lit("{question}"), question=F.lit("Q"))
    assert [r[0] for r in df.select(filled).collect()] == ["A {question} {b} Q!", None, None, "", "{}Q"]


def test_external_prompts(spark):
    df = spark.createDataFrame(
        [("1", "T {context} Q {question}", ["q?"], ("<h>", "\\l", "|m|"))],
        "id string, instruction string, question_list array<string>, "
        "context struct<context_html: string, context_latex: string, context_markdown: string>",
    )
    built = {r.fmt: r.prompt for r in prompts.external_prompts(df).collect()}
    assert built["latex"] == (
        f"<s>[INST] <<SYS>>\n{EXTERNAL_SYSTEM_PROMPT}\n<</SYS>>\n\nT \\l Q q? [/INST]"
    )
    assert set(built) == {"html", "latex", "markdown"}


def test_choices(spark):
    df = spark.createDataFrame([(i, f"q{i}", ["x", "y"]) for i in range(40)], "pos long, question string, choices array<string>")
    assert prompts.choice_prompts(df).count() == 40
    rows = prompts.choice_prompts(df, 30).collect()
    assert len(rows) == 30 and rows[3].text == "Question: q3\nA. x\nB. y\nAnswer:"


def test_judge_prompts(spark):
    df = spark.createDataFrame([("t", "k", "f", "q {gold}", "g", "p {task}")], "table_id string, task string, fmt string, question string, gold string, raw string")
    current = prompts.judge_prompts(df).first()
    assert "Question: q {gold}\nGold answer: g\nModel prediction: p {task}\n\nRubric:" in current.judge_prompt
    older = prompts.judge_prompts(df, version="suc_v1", chat="plain").first().judge_prompt
    assert '{\n  "content_correct": true/false' in older and older.endswith("Model prediction:\np {task}\n")
    with pytest.raises(ValueError):
        prompts.judge_prompts(df, version="v0")


CHAT = [
    (1, 0, "system", "be brief"), (1, 1, "user", " hi "), (1, 2, "assistant", "yo\n"), (1, 3, "user", "more"),
    (2, 5, "user", "a"), (2, 6, "system", "late"), (2, 7, "assistant", "b"),
    (3, 0, "system", "s"), (3, 9, "assistant", "first"), (4, 0, "system", "alone"), (5, 0, "tool", "x"), (5, 1, "user", "u"),
]
RENDERED = {
    1: "<s>[INST] <<SYS>>\nbe brief\n<</SYS>>\n\n hi [/INST] yo </s><s>[INST] more [/INST]",
    2: "<s>[INST] a [/INST] b </s>",
    3: " <<SYS>>\ns\n<</SYS>>\n\nfirst </s>",
    4: "",
    5: "<s>[INST] u [/INST]",
}


@pytest.mark.parametrize("part_turns, renumber", [(1024, False), (3, False), (1, False), (1, True), (2, True)])
def test_conversations(spark, part_turns, renumber):
    turns = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    rendered = render_conversations(turns, part_turns=part_turns, renumber=renumber)
    parts = rendered.orderBy("conv_id", "part").collect()
    joined = {}
    for p in parts:
        joined[p.conv_id] = joined.get(p.conv_id, "") + p.prompt
    assert joined == RENDERED


def test_copied_turns(spark):
    turns = spark.range(0, 5000, 1, 8).select(
        F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text")
    )
    whole = render_conversations(turns, renumber=True).collect()
    assert [p.prompt for p in whole] == ["<s>[INST] x [/INST]" * 5000]
    parts = render_conversations(turns, renumber=True, part_turns=1024).orderBy("part").collect()
    assert len(parts) == 5 and "".join(p.prompt for p in parts) == "<s>[INST] x [/INST]" * 5000
