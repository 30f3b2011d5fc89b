import pytest
from pyspark.sql import functions as F

from tabprobe.functions.extract import extract_answer, extract_list, extract_scalar
from tabprobe.functions.verdict import parse_verdict, tri_state
from tabprobe.operators import summary

SCALAR = {
    " Paris. \nmore": "Paris",
    "Barcelona\n\nQuestion: next": "Barcelona",
    "So Answer: 42\nAnswer: 43 \n": "43",
    "Human: x": "",
    "yes Assistant: no": "yes",
    "\n---": "",
    "   'quoted', ": "quoted",
    "- Club: Real Madrid": "Real Madrid",
    "- Club: 'x'.": "x",
    "- Club:": "- Club:",
    "- a: b: c": "b: c",
    "`;.\n  second": "second",
    "a" * 130: "a" * 120,
    "b" * 100 + ", " + "c" * 30: "b" * 100,
    "b" * 100 + " | " + "c" * 30: "b" * 100,
    "b" * 100 + "\t" + "c" * 30: "b" * 100,
    "b" * 100 + " § " + "c" * 30: "b" * 100,
    "b" * 100 + " <COL> " + "c" * 30: "b" * 100,
    "x\x0by": "x",
    "x y": "x",
    "": "",
    "\n\n": "",
}
LIST = {
    "a\nb,\n\n- c -\n": "a\nb\n c ",
    "Answer: 1\r\n2\x852\n### end": "1\n2\n2",
    "x\n\ny\nQuestion: z": "x\ny",
    "\"q\"\n'r'\n;;": "q\nr",
    "": "",
}


def run(spark, cases, function):
    df = spark.createDataFrame([(k,) for k in cases], "raw string").coalesce(1)
    return dict(zip(cases, [r[0] for r in df.select(function(F.col("raw"))).collect()]))


def test_scalar(spark):
    assert run(spark, SCALAR, extract_scalar) == SCALAR


def test_list(spark):
    assert run(spark, LIST, extract_list) == LIST


def test_clean_answers_stay(spark):
    answers = ["Paris", "12", "row 2, column 'Goals", "2 rows, 3 columns"]
    assert run(spark, answers, extract_scalar) == {a: a for a in answers}


def test_skipped_rows_have_no_answer(spark):
    assert run(spark, ["[SKIPPED: 5000 tokens > 3900]"], lambda c: extract_answer(c, F.lit(False))) == {
        "[SKIPPED: 5000 tokens > 3900]": ""
    }


def test_very_long_text(spark):
    text = "word " * 200_000 + "\nAnswer: fine\n" + " " * 100_000
    assert run(spark, [text], extract_scalar)[text] == "fine"


OBJECT = '{"content_correct": true, "overinclusive": "FALSE", "score": 0.5, "reason": "ok"}'
NONE = (None, None, None)
VERDICTS = {
    OBJECT: (True, False, 0.5, "ok"),
    f"  {OBJECT}\n": (True, False, 0.5, "ok"),
    f"Sure:\n```json\n{OBJECT}\n```": (True, False, 0.5, "ok"),
    f"{OBJECT} trailing": (True, False, 0.5, "ok"),
    '{"content_correct": true, "content_correct": false}': (False, None, None, ""),
    '{"content_correct": 1, "overinclusive": "yes", "score": "x"}': (None, None, None, ""),
    '{"content_correct": " True ", "score": null, "reason": null}': (True, None, None, ""),
    '{"content_correct": true, "reason": {"a": [1, 2]}}': (True, None, None, '{"a":[1,2]}'),
    "{}": (None, None, None, ""),
    f"{OBJECT} {OBJECT}": (*NONE, f"{OBJECT} {OBJECT}"),
    f"{OBJECT}] [{OBJECT}": (*NONE, f"{OBJECT}] [{OBJECT}"),
    f"{OBJECT}, {OBJECT}": (*NONE, f"{OBJECT}, {OBJECT}"),
    f"{OBJECT}}}": (*NONE, f"{OBJECT}}}"),
    f"[{OBJECT}]": (*NONE, f"[{OBJECT}]"),
    f'"{{}}"': (*NONE, '"{}"'),
    f"[note] {OBJECT}": (True, False, 0.5, "ok"),
    "{'content_correct': true}": (*NONE, "{'content_correct': true}"),
    '{"content_correct": true,}': (*NONE, '{"content_correct": true,}'),
    "1": (*NONE, "1"),
    "": (*NONE, ""),
    "x" * 900: (*NONE, "x" * 500),
    "} {": (*NONE, "} {"),
}


def test_verdicts(spark):
    df = spark.createDataFrame([(k,) for k in VERDICTS], "raw_judge string").coalesce(1)
    rows = summary.parse_verdicts(df).collect()
    found = {r.raw_judge: (r.content_correct, r.overinclusive, r.score, r.reason) for r in rows}
    assert found == VERDICTS


def test_tri_state(spark):
    cases = {"TRUE": True, " false\n": False, "1": None, "yes": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string").coalesce(1)
    assert [r[0] for r in df.select(tri_state(F.col("v"))).collect()] == list(cases.values())


ROWS = [
    ("a", "x", True, False, False, True), ("a", "x", True, None, False, None), ("a", "x", None, True, False, False),
    ("a", "y", False, None, None, True), ("b", None, None, None, None, None), ("b", None, True, False, True, True),
]
VERDICT_SCHEMA = (
    "task string, fmt string, content_correct boolean, overinclusive boolean, "
    "instruction_following_error boolean, format_correct boolean"
)


def test_row_metrics_are_three_valued(spark):
    rows = summary.row_metrics(spark.createDataFrame(ROWS, VERDICT_SCHEMA).coalesce(1)).collect()
    assert [r.relaxed_accuracy for r in rows] == [1.0, 1.0, None, 0.0, None, 1.0]
    assert [r.accuracy_clean for r in rows] == [1.0, None, 0.0, 0.0, None, 1.0]
    assert [r.strict_accuracy for r in rows] == [1.0, None, 0.0, 0.0, None, 0.0]


def test_summaries(spark):
    verdicts = spark.createDataFrame(ROWS, VERDICT_SCHEMA)
    by_pair = {(r.task, r.fmt): r for r in summary.summarise(verdicts, ["task", "fmt"]).collect()}
    assert by_pair["a", "x"].n == 3 and by_pair["a", "x"].relaxed_accuracy == 1.0
    assert by_pair["a", "x"].strict_accuracy == 0.5 and by_pair["b", None].n == 2
    overall = summary.summarise(verdicts).first()
    assert overall.n == 6 and overall.relaxed_accuracy == 0.75
    levels = summary.summarise_all(verdicts).collect()
    assert sorted(r.level for r in levels) == ["fmt"] * 3 + ["overall"] + ["task_fmt"] * 3


def test_pivot(spark):
    verdicts = spark.createDataFrame(ROWS, VERDICT_SCHEMA).filter("fmt is not null")
    wide = summary.summarise_pivot(verdicts.union(spark.createDataFrame([("c", "y", True, True, True, True)], VERDICT_SCHEMA)))
    assert wide.columns[:5] == ["task", "x_n", "y_n", "x_relaxed_accuracy", "y_relaxed_accuracy"]
    row = {r.task: r for r in wide.collect()}["c"]
    assert row.x_n is None and row.y_n == 1 and row.y_strict_accuracy == 0.0


@pytest.mark.parametrize("value, rounded", [(0.12345, 0.1234), (0.12355, 0.1236)])
def test_rounding_is_half_even(spark, value, rounded):
    assert spark.range(1).select(F.bround(F.lit(value), 4)).first()[0] == rounded
