import csv
import io
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabprobe.functions.formats import FORMATS, SUMMED_TOKENS, format_table, json_string
from tabprobe.functions.sql_functions import register_formats
from tabprobe.functions.text import token_count
from tabprobe.operators.serialise import question_instances, serialise_tables

SCHEMA = "table_id string, pos long, header array<string>, rows array<array<string>>"
HEADER = ["Name", "Size (m)"]
ROWS = [["Ann", "1"], ["Bo|b", ""]]

EXPECTED = {
    "tsv": "Name\tSize (m)\nAnn\t1\nBo|b\t",
    "md": "| Name | Size (m) |\n| ---- | -------- |\n| Ann  | 1        |\n| Bo|b |          |",
    "prose": "Row 1: Name is Ann, Size (m) is 1. Row 2: Name is Bo|b, Size (m) is .",
    "csv": "Name,Size (m)\r\nAnn,1\r\nBo|b,",
    "csv_q": '"Name","Size (m)"\r\n"Ann","1"\r\n"Bo|b",""',
    "row_obj": "Row 1 | Name=Ann | Size (m)=1\nRow 2 | Name=Bo|b | Size (m)=",
    "col_sep": "Name <COL> Size (m)\nAnn <COL> 1\nBo|b <COL> ",
    "sec_sep": "Name § Size (m)\nAnn § 1\nBo|b § ",
    "json": '[\n  {\n    "Name": "Ann",\n    "Size (m)": "1"\n  },\n  {\n    "Name": "Bo|b",\n    "Size (m)": ""\n  }\n]',
    "html": (
        "<table>\n  <tr>\n    <th>Name</th>\n    <th>Size (m)</th>\n  </tr>\n"
        "  <tr>\n    <td>Ann</td>\n    <td>1</td>\n  </tr>\n"
        "  <tr>\n    <td>Bo|b</td>\n    <td></td>\n  </tr>\n</table>"
    ),
    "yaml": "- Name: Ann\n  Size (m): 1\n- Name: Bo|b\n  Size (m): ",
    "xml": (
        '<table>\n  <row id="1">\n    <Name>Ann</Name>\n    <Size__m>1</Size__m>\n  </row>\n'
        '  <row id="2">\n    <Name>Bo|b</Name>\n    <Size__m></Size__m>\n  </row>\n</table>'
    ),
}


def texts(spark, header, rows, formats=tuple(FORMATS)):
    df = spark.createDataFrame([("t", 0, header, rows)], SCHEMA)
    return {r.fmt: r.table_text for r in serialise_tables(df, formats).collect()}


def test_all_formats(spark):
    assert texts(spark, HEADER, ROWS) == EXPECTED


def test_no_rows(spark):
    found = texts(spark, ["a", "longer"], [])
    assert found["json"] == "[]"
    assert found["md"] == "| a   | longer |\n| --- | ------ |"
    assert found["tsv"] == "a\tlonger" and found["prose"] == "" and found["yaml"] == ""
    assert found["xml"] == "<table>\n</table>"


def test_ragged_rows(spark):
    found = texts(spark, ["a", "b"], [["1"], ["1", "2", "3"], []])
    assert found["md"].split("\n")[2:] == ["| 1   |     |", "| 1   | 2   |", "|     |     |"]
    assert found["row_obj"] == "Row 1 | a=1\nRow 2 | a=1 | b=2\nRow 3"
    assert json.loads(found["json"]) == [{"a": "1"}, {"a": "1", "b": "2"}, {}]
    assert found["tsv"] == "a\tb\n1\n1\t2\t3\n"


def test_repeated_and_empty_names(spark):
    found = texts(spark, ["x", "y", "x", ""], [["1", "2", "3", "4"], ["5", "6"]])
    rows = [dict(zip(["x", "y", "x", ""], r)) for r in [["1", "2", "3", "4"], ["5", "6"]]]
    assert found["json"] == json.dumps(rows, indent=2, ensure_ascii=False)
    assert "    <col>4</col>" in found["xml"]


def test_one_empty_field(spark):
    found = texts(spark, ["a"], [[""], ["b"], [""]])
    assert found["csv"] == 'a\r\n""\r\nb\r\n""'
    assert found["csv_q"] == '"a"\r\n""\r\n"b"\r\n""'


def test_unicode_tags_and_widths(spark):
    found = texts(spark, ["année-1", "__", "名 前"], [["é", "b", "c"]])
    assert "<année_1>é</année_1>" in found["xml"] and "<col>b</col>" in found["xml"]
    assert "<名_前>c</名_前>" in found["xml"]
    assert found["md"].split("\n")[2] == "| é       | b   | c   |"


def test_unknown_format():
    try:
        format_table("pdf", F.lit(1), F.lit(1))
    except ValueError as error:
        assert "pdf" in str(error)
    else:
        raise AssertionError("no error")


def test_control_characters(spark):
    raw = "".join(chr(c) for c in range(32)) + '\\u000B "\x7f é😀'
    row = spark.createDataFrame([(raw,)], "v string").select(json_string(F.col("v"))).first()
    assert row[0] == json.dumps(raw, ensure_ascii=False)


CELL = st.text(alphabet=st.sampled_from(list('ab,"\n\r\t\\ <&é😀|\x0b')), max_size=5)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(1, 4).flatmap(lambda n: st.tuples(
    st.lists(CELL, min_size=n, max_size=n),
    st.lists(st.lists(CELL, min_size=n, max_size=n), min_size=1, max_size=4),
)))
def test_text_formats_match_the_standard_library(spark, table):
    header, rows = table
    found = texts(spark, header, rows, ["csv", "csv_q", "json", "md"])
    for name, quoting in (("csv", csv.QUOTE_MINIMAL), ("csv_q", csv.QUOTE_ALL)):
        out = io.StringIO()
        csv.writer(out, quoting=quoting).writerows([header, *rows])
        assert found[name] == out.getvalue().rstrip("\r\n")
    expected = [dict(zip(header, row)) for row in rows]
    assert found["json"] == json.dumps(expected, indent=2, ensure_ascii=False)
    assert len(found["md"]) >= len(rows) + 2


SQL_CASES = [
    (HEADER, ROWS),
    (["a", "longer"], []),
    (["a", "b"], [["1"], ["1", "2", "3"], []]),
    (["x", "y", "x", ""], [["1", "2", "3", "4"], ["5", "6"]]),
    (["a"], [[""], ["b"], [""]]),
    (["année-1", "__", 'q"u'], [["é\\", 'b"\n\r\t', "c,\x0b\x1f\x0c"]]),
]


def test_sql_functions_give_the_same_texts(spark):
    assert register_formats(spark) == [f"fmt_{f}" for f in FORMATS]
    df = spark.createDataFrame([(str(i), i, h, r) for i, (h, r) in enumerate(SQL_CASES)], SCHEMA)
    df.createOrReplaceTempView("some_tables")
    for fmt in FORMATS:
        sql = spark.sql(f"SELECT table_id, fmt_{fmt}(header, rows) AS t FROM some_tables").collect()
        built = df.select("table_id", format_table(fmt, F.col("header"), F.col("rows"))).collect()
        assert [tuple(r) for r in sql] == [tuple(r) for r in built], fmt


def test_summed_tokens_equal_counting_the_text(spark):
    """Cells counted once give the count of every text, for whole tables as for ragged, empty and odd ones."""
    odd = [("é x", "", "a_b"), ("𠀀b", "1.5 <td>", "\n")]
    tables = spark.createDataFrame(
        [
            ("one", ["h"], [["x"]]), ("whole", list(odd[0]), [list(r) for r in odd]), ("names", ["", "- "], [["a-b", "| c"], ["", "d\te"]]),
            ("ragged", ["a", "b"], [["1"], ["1", "2", "3"], []]), ("bare", ["a"], []), ("none", [], [["a"], []]),
        ],
        "table_id string, header array<string>, rows array<array<string>>",
    ).withColumns({"question": F.lit("q"), "answers": F.array(F.lit("a"))})
    built = question_instances(tables, list(FORMATS))
    assert built.filter(~F.col("text_tokens").eqNullSafe(token_count(F.col("table_text")))).count() == 0
    assert set(SUMMED_TOKENS) <= set(FORMATS) and built.count() == 6 * 12
    plan = question_instances(tables, ["tsv", "yaml"])._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten(rows" in plan


def test_html_rows_are_joined_not_built_cell_by_cell(spark):
    df = spark.createDataFrame([(["h", "k"], [["a", ""], [], ["b", None], [None]])], "header array<string>, rows array<array<string>>")
    register_formats(spark)
    both = df.select(format_table("html", F.col("header"), F.col("rows")).alias("built"), F.expr("fmt_html(header, rows)").alias("sql"))
    head = "<table>\n  <tr>\n    <th>h</th>\n    <th>k</th>\n  </tr>\n  <tr>\n    <td>a</td>\n    <td></td>\n  </tr>\n  <tr>\n  </tr>\n"
    text = head + "  <tr>\n    <td>b</td>\n  </tr>\n  <tr>\n  </tr>\n</table>"
    assert tuple(both.first()) == (text, text)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("</td>\n    <td>") == 2
