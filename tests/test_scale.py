"""Hot keys, long keys, numbering, sampling, markup: against brute force."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tabprobe.functions import markup as functions
from tabprobe.functions.formats import FORMATS
from tabprobe.functions.markup import markup_length, markup_spans, markup_tokens, token_offsets
from tabprobe.operators import ingest, longform, markup, resume, sampling
from tabprobe.operators.numbering import number_rows
from tabprobe.operators.prompts import build_prompts
from tabprobe.operators.serialise import build_instances, generate_instances, serialise_tables
from tabprobe.operators.tasks import generate_tasks
from tabprobe.sources.corpus import save_bucketed
from tests.test_prompts import HEAD


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows, a third of them of one key, in shuffled order."""
    rows = [("hot", i) for i in range(1000)] + [(f"k{i % 200}", i) for i in range(2000)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k string, n int").repartition(6)


def columns():
    return {"n": F.col("n"), "txt": F.concat(F.lit('v,"'), F.col("n").cast("string"))}


def test_number_rows(spark, skewed):
    per_key = {}
    for r in number_rows(skewed, ["n"], key=["k"]).collect():
        per_key.setdefault(r.k, []).append((r.n, r.pos))
    assert all([p for _, p in sorted(v)] == list(range(len(v))) for v in per_key.values())
    assert len(per_key["hot"]) == 1000
    overall = number_rows(skewed, ["n", "k"]).collect()
    assert [r.pos for r in sorted(overall, key=lambda r: (r.n, r.k))] == list(range(3000))


def test_number_rows_with_null_keys(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "k string, n int")
    assert sorted((r.n, r.pos) for r in number_rows(df, ["n"], key=["k"]).collect()) == [(1, 0), (2, 1), (3, 0)]


def test_tables_from_rows_truncates(spark, skewed):
    tables = {t.table_id: t for t in ingest.tables_from_rows(skewed, "k", ["n"], columns(), max_rows=25).collect()}
    assert len(tables) == 201 and [r[0] for r in tables["hot"].rows] == [str(i) for i in range(25)]
    assert [r[0] for r in tables["k7"].rows] == [str(i) for i in range(7, 2000, 200)]
    narrow = ingest.tables_from_rows(skewed, "k", ["n"], columns(), max_cols=1).first()
    assert narrow.header == ["n"]
    whole = {t.table_id: len(t.rows) for t in ingest.tables_from_rows(skewed, "k", ["n"], columns()).collect()}
    assert whole["hot"] == 1000 and sum(whole.values()) == 3000


def test_group_limit_is_before_the_shuffle(spark, skewed):
    plan = ingest.tables_from_rows(skewed, "k", ["n"], columns(), max_rows=25)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(table_id") == 1
    assert plan.index("Exchange hashpartitioning(table_id") < plan.rindex("Partial")


def test_long_form_equals_nested_form(spark, skewed):
    parts = longform.serialise_rows(skewed, "k", ["n"], columns(), longform.LONG_FORMATS, part_rows=64)
    long = {}
    for p in parts.orderBy("part").collect():
        long[p.table_id, p.fmt] = long.get((p.table_id, p.fmt), "") + p.part_text
    nested = serialise_tables(ingest.tables_from_rows(skewed, "k", ["n"], columns(), max_rows=5000))
    expected = {(t.table_id, t.fmt): t.table_text for t in nested.collect()}
    assert set(FORMATS) == set(longform.LONG_FORMATS) and long == expected
    assert parts.filter("table_id = 'hot' and fmt = 'tsv'").count() == 16


def test_long_form_of_one_column(spark):
    df = spark.createDataFrame([("a", 1, ""), ("a", 2, "x"), ("a", 3, None)], "k string, o int, v string")
    parts = longform.serialise_rows(df, "k", ["o"], {"v": F.col("v")}, ["csv", "tsv"], part_rows=1)
    csv = "".join(p.part_text for p in parts.filter("fmt = 'csv'").orderBy("part").collect())
    assert csv == 'v\r\n""\r\nx\r\nNone'


def test_hot_keys_resume(spark, skewed):
    one = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 200, 2)], "k string, v int")
    done = {r.k for r in one.collect()}
    rows = skewed.collect()
    assert sorted(map(tuple, resume.pending(skewed, one, ["k"]).collect())) == sorted((r.k, r.n) for r in rows if r.k not in done)
    assert sorted(map(tuple, resume.keep_wanted(skewed, one, ["k"]).collect())) == sorted((r.k, r.n) for r in rows if r.k in done)


def test_samples(spark):
    tables = spark.createDataFrame([(f"t{i}", i) for i in range(100)], "table_id string, pos long").repartition(4)
    digest = sorted((hashlib.md5(f"7:t{i}".encode()).hexdigest(), f"t{i}") for i in range(100))[:10]
    found = sampling.sample_tables(tables, 10, seed=7).orderBy("draw").collect()
    assert [r.table_id for r in found] == [t for _, t in digest]
    drawn = sampling.sample_tables(tables, 10, seed=42, sampler="mt19937").orderBy("draw").collect()
    assert [r.pos for r in drawn] == random.Random(42).sample(range(100), 10)
    assert sampling.sample_tables(tables, 500).count() == sampling.sample_tables(tables, 0).count() == 100


def test_size_order(spark):
    rows = [("a", 0, ["x"], [["1"]]), ("b", 1, ["x"], [["1"], ["2"]]), ("c", 2, ["x", "y"], [["1", "1"]] * 2), ("d", 3, ["x"], [["3"], ["4"]])]
    tables = spark.createDataFrame(rows, "table_id string, pos long, header array<string>, rows array<array<string>>")
    assert [t.table_id for t in ingest.largest_tables(tables, 3).collect()] == ["c", "b", "d"]
    assert [t.table_id for t in ingest.first_tables(tables, 2).collect()] == ["a", "b"]


TEXTS = {
    "html": ["<a b='1'>\n  x <br/>\t\n", "", "plain < text", "  lead\n\r\n\t<b\nc>z</b>", "é😀 <i>ü</i>"],
    "json": [json.dumps([{"a": 'x"\\y', "": "é\n"}], indent=2, ensure_ascii=False), "[]", '"open', '"a""b"'],
    "col_sep": ["a <COL> b\nc <COL>  <COL> d", " <COL> ", "none", "<COL>"],
}


def mask(text, fmt):
    flags = [fmt == "json"] * len(text)
    pattern = {
        "html": r"(?m)<[^>]+>|^[ \t]+|\n", "col_sep": r" <COL> |\n", "json": r'(?<=")((?:[^"\\]|\\.)*)(?=")',
    }[fmt]
    if fmt == "json":
        for m in re.finditer(r'"((?:[^"\\]|\\.)*)"', text):
            flags[m.start() + 1 : m.end() - 1] = [False] * (m.end() - m.start() - 2)
    else:
        for m in re.finditer(pattern, text):
            flags[m.start() : m.end()] = [True] * (m.end() - m.start())
    return flags


@pytest.mark.parametrize("fmt", list(TEXTS))
def test_markup(spark, fmt):
    df = spark.createDataFrame([(t,) for t in [*TEXTS[fmt], None]], "t string").coalesce(1)
    text = F.col("t")
    prompt = F.concat(F.lit("ab "), text, F.lit(" z"))
    rows = df.select(
        "t", markup_length(text, fmt).alias("n"), markup_spans(text, fmt).alias("spans"),
        token_offsets(prompt).alias("tokens"),
        markup_tokens(prompt, F.lit(3), F.length(text), fmt).alias("found"),
    ).collect()
    for r in rows[:-1]:
        flags = mask(r.t, fmt)
        spans = [False] * len(r.t)
        for s in r.spans:
            spans[s.start : s.end] = [True] * (s.end - s.start)
        assert spans == flags and r.n == sum(flags)
        whole = [False] * 3 + flags + [False] * 2
        pieces = [m.span() for m in re.finditer(r"\w+|[^\w \t\n\x0b\f\r]", f"ab {r.t} z")]
        assert [(t.start, t.end) for t in r.tokens] == pieces and r.found.n_tokens == len(pieces)
        assert list(r.found.positions) == [i for i, (a, b) in enumerate(pieces) if any(whole[a:b])]
    assert rows[-1].n is None and rows[-1].spans is None and rows[-1].found.positions is None


def test_long_strings_do_not_recurse(spark):
    text = '{"k": "' + 'x\\"' * 100_000 + '"}'
    row = spark.createDataFrame([(text,)], "t string").select(markup_length(F.col("t"), "json")).first()
    assert row[0] == len('{"') + len('": "') + len('"}')


@pytest.mark.parametrize("segment", [1, 4, 64])
def test_overlap_join(spark, segment):
    generator = random.Random(3)
    tokens, spans, expected = [], [], []
    for key in range(20):
        marks = []
        at = 0
        for _ in range(generator.randrange(8)):
            at += generator.randrange(5)
            marks.append((at, at + generator.randrange(1, 30)))
            at = marks[-1][1]
        spans += [(key, a, b) for a, b in marks]
        for i in range(30):
            a = generator.randrange(120)
            b = a + generator.randrange(0, 20)
            tokens.append((key, i, a, b))
            if b > a and any(a < e and b > s for s, e in marks):
                expected.append((key, i))
    token_df = spark.createDataFrame(tokens, "k int, i int, start int, end int")
    span_df = spark.createDataFrame(spans, "k int, start int, end int")
    touched = markup.overlapping_tokens(token_df, span_df, ["k"], segment)
    assert sorted((r.k, r.i) for r in touched.collect()) == sorted(expected)
    budgets = {r.k: r.n_markup_tokens for r in markup.markup_budgets(touched, ["k"]).collect()}
    assert sum(budgets.values()) == len(expected)


def test_overlap_join_sorts_no_tokens(spark):
    tokens = spark.createDataFrame([(1, 0, 0, 70), (1, 0, 0, 70), (1, 1, 70, 71), (1, 1, 70, 71), (1, 2, 64, 200), (2, 0, 0, 64), (None, 0, 0, 9)], "k int, i int, start int, end int")
    spans = spark.createDataFrame([(1, 60, 71), (1, 63, 64), (1, 63, 64), (1, 130, 131), (3, 0, 9), (None, 0, 9)], "k int, start int, end int")
    touched = markup.overlapping_tokens(tokens, spans, ["k"])
    assert sorted((r.k, r.i) for r in touched.collect()) == [(1, 0), (1, 1), (1, 2)]
    assert sorted((r.k, r.i) for r in markup.overlapping_tokens(tokens, spans, ["k"], 1000).collect()) == [(1, 0), (1, 1), (1, 2)]
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan.replace("SortAggregate", "Sort")


def test_overlap_of_dealt_sides(spark):
    generator = random.Random(8)
    rows = [(generator.choice([None, 1, 2, 3]), generator.randrange(9), a := generator.randrange(90), a + generator.randrange(-1, 80)) for _ in range(400)]
    tokens = spark.createDataFrame(rows + rows[:50], "k int, i int, start int, end int")
    spans = spark.createDataFrame([(k, a, b) for k, _, a, b in rows[300:340]], "k int, start int, end int")
    for segment in (1, 5, 64, 100):
        joined = markup.overlapping_tokens(tokens, spans, ["k"], segment).collect()
        grouped = markup.overlapping_tokens(tokens, spans, ["k"], segment, dealt=True)
        assert grouped.columns == tokens.columns and sorted(map(tuple, grouped.collect())) == sorted(map(tuple, joined))


def test_controls(spark):
    text = "a <COL> b\nc <COL> d"
    df = spark.createDataFrame(
        [("t", "k", "col_sep", "q", text, f"{HEAD}{text} end"), ("u", "k", "col_sep", "q", text, "elsewhere")],
        "table_id string, task string, fmt string, question string, table_text string, prompt string",
    )
    rows = markup.control_positions(df.filter("table_id = 't'"), "col_sep").collect()
    assert len(rows) == 21 and {r.patch_positions for r in rows} == {6}
    masks = {tuple(r.positions) for r in rows if r.patch_group == "random10pct"}
    assert len(masks) > 15 and all(list(m) == sorted(set(m)) for m in masks)
    absent = markup.control_positions(df.filter("table_id = 'u'"), "col_sep").collect()
    assert all(r.positions is None and r.error for r in absent)
    few = df.select(markup.random_positions(F.lit(3), F.lit(9), F.lit(1), F.lit("k")).alias("p"))
    assert few.first().p == [0, 1, 2]


def test_scans_hold_few_texts_at_once(spark):
    def make_tokenizer():
        def tokenize(texts):
            assert sum(map(len, texts)) <= max(1 << 18, max(map(len, texts))), "too many texts at once"
            return [[(0, len(t))] for t in texts]

        return tokenize

    sizes = [100_000, None, 200_000, 0, 400_000, 3, 100_000, 100_000]
    rows = [(i, None if n is None else "<b>" * (n // 3) + "x" * (n % 3)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "i int, t string").coalesce(1)
    text = F.col("t")
    found = df.select("i", token_offsets(text, make_tokenizer).alias("tokens"), F.size(markup_spans(text, "html")).alias("n")).orderBy("i").collect()
    assert [None if r.tokens is None else r.tokens[0].end for r in found] == sizes
    assert [r.n for r in found if r.tokens is not None] == [n // 3 for n in sizes if n is not None]
    places = df.select("i", markup_tokens(text, F.lit(0), F.length(text), "html", make_tokenizer).alias("m")).orderBy("i").collect()
    assert [r.m.positions for r in places] == [None if n is None else [0] if n >= 3 else [] for n in sizes]


def test_overlap_stays_where_texts_are_dealt(spark):
    letters = " \t\n\x0b\f\r\x1c\x85 ab1_.<>é中𝔘😀²٣-"
    generator = random.Random(5)
    texts = ["".join(generator.choice(letters) for _ in range(generator.randrange(200))) for _ in range(60)]
    texts += [" <COL> <COL> \n <COL> a\n\n", " <COL> " * 3, "", None, "\n", " <COL>", "a <COL>  <COL> b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").groupBy("k").agg(F.max("t").alias("t"))
    text = F.col("t")
    found = rows.select(
        token_offsets(text).alias("a"), functions.token_offsets_in_place(text).alias("b"),
        markup_spans(text, "col_sep").alias("c"), functions.separator_spans_in_place(text).alias("d"),
    ).collect()
    assert [(r.a, r.c) for r in found] == [(r.b, r.d) for r in found]
    tokens = markup.explode_spans(rows.select("k", functions.token_offsets_in_place(text).alias("o")), ["k"], "o", index="i")
    spans = markup.explode_spans(rows.select("k", functions.separator_spans_in_place(text).alias("o")), ["k"], "o")
    touched = markup.overlapping_tokens(tokens, spans, ["k"], 8, dealt=True)
    # the deal of the texts, once for either side
    assert touched._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    swept = rows.select("k", token_offsets(text).alias("tokens"), markup_spans(text, "col_sep").alias("spans"))
    assert sorted((r.k, r.i) for r in touched.collect()) == sorted((r.k, r.token_idx) for r in markup.swept_tokens(swept, ["k"]).collect())


def test_unsupported_markup(spark):
    with pytest.raises(ValueError):
        markup_length(F.lit("x"), "tsv")


def test_bucketed_tables_join_without_an_exchange(spark, skewed):
    tables = ingest.tables_from_rows(skewed, "k", ["n"], columns())
    save_bucketed(tables, "bucketed_tables", 4)
    save_bucketed(generate_tasks(tables), "bucketed_tasks", 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        built = build_instances(
            spark.table("bucketed_tasks"), spark.table("bucketed_tables"), ["tsv"]
        )
        plan = built._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert built.count() == spark.table("bucketed_tasks").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql("DROP TABLE bucketed_tables")
        spark.sql("DROP TABLE bucketed_tasks")


def test_no_python_and_one_exchange_from_rows_to_prompts(spark, skewed):
    tables = ingest.tables_from_rows(skewed, "k", ["n"], columns())
    built = build_prompts(generate_instances(tables, ["html", "json"]))
    plan = built._jdf.queryExecution().executedPlan().toString()
    # The fixture itself is dealt out round-robin; the only other exchange is by table.
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
    assert plan.count("[<table>]") == 1


def test_drawn_positions_are_those_of_one_number_at_a_time(spark):
    def drawn(n, count, seed, key):
        taken = set()
        for p in range(n - max(min(count, n), 0), n):
            place = int(hashlib.sha256(f"{seed}:{key}:{p}".encode()).hexdigest()[:12], 16) % (p + 1)
            taken.add(p if place in taken else place)
        return sorted(taken)

    rows = [(n, count, seed, f"k{n} é") for n in (0, 1, 7, 400) for count in (-1, 0, 1, 5, 390, 500) for seed in (0, 42)]
    df = spark.createDataFrame([*rows, (None, 1, 1, "k"), (3, 1, 1, None)], "n int, c int, s long, k string")
    assert [r.p for r in df.select(markup.random_positions(*map(F.col, "ncsk")).alias("p")).collect()] == [*[drawn(*r) for r in rows], None, None]


def test_separators_of_all_texts_at_once_are_the_pattern_s():
    parts = [" <COL> ", "<COL> ", " <COL>", "<", "\n", " ", "a", "é", "𝄞", "\0", ""]
    draw = random.Random(5)
    texts = [None if draw.random() < 0.1 else "".join(draw.choices(parts, k=draw.randint(0, 20))) for _ in range(800)]
    starts = [draw.randint(0, 9) for _ in texts]
    found = functions._packed_spans("col_sep", texts, starts).to_pylist()
    for text, at, spans in zip(texts, starts, found):
        wanted = None if text is None else [(m.start() + at, m.end() + at) for m in re.finditer(" <COL> |\n", text)]
        assert wanted == (None if spans is None else [(s["start"], s["end"]) for s in spans])
