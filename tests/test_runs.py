"""Incremental runs, scoring, whole jobs, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from tabprobe import fixed_values as fixed
from tabprobe.functions.text import row_key
from tabprobe.operators import checks, resume, scoring, selection
from tabprobe.plans import catalogue, jobs
from tabprobe.sources import corpus, results
from tabprobe.streaming.incremental import arriving, incremental_score
from tests.test_tasks import CLUBS

KEYED = "table_id string, task string, fmt string, question string, v int"


def test_pending_is_null_safe_and_exact(spark):
    target = spark.createDataFrame(
        [("a", "t", "f", "q", 1), ("a", "t", None, "q", 2), ("a|t", "", "f", "q", 3), ("b", "t", "f", "q", 4)], KEYED
    )
    done = spark.createDataFrame([("a", "t", None, "q", 0), ("a", "|t", "f", "q", 0), ("b", "t", "f", "q", 0)] * 3, KEYED)
    assert sorted(r.v for r in resume.pending(target, done).collect()) == [1, 3]
    kept = resume.keep_wanted(done, target)
    assert kept.count() == 6
    assert resume.carry_over(done, target, keep_stale=True).count() == 9


def test_keys_are_digests_of_32_bytes(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", None), ("a", ""), (None, "a"), (None, None)], "x string, y string")
    keys = [bytes(r.k) for r in rows.select(row_key(F.col("x"), F.col("y")).alias("k")).collect()]
    assert len(set(keys)) == 6 and {len(k) for k in keys} == {32}


def test_merge_latest(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", 0, None)] + [("hot", i, str(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "id string, version int, v string")
    found = {r.id: r.v for r in resume.merge_latest(df, ["id"], ["version"]).collect()}
    assert found == {"a": "z", "b": None, "hot": "499"}


def test_run_counts(spark):
    target = spark.createDataFrame([("a", "[SKIPPED: 9 tokens > 1]"), ("b", "x"), ("c", "y")], "id string, raw string")
    counts = resume.run_counts(target, target.filter("id = 'c'"), ["id"]).first()
    assert tuple(counts) == (3, 2, 1)


def test_score_batches_settings_and_failures(spark):
    df = spark.range(0, 50, 1, 2).select(
        F.col("id"), F.concat(F.lit("p"), "id").alias("prompt"), (F.col("id") % 2 == 0).alias("is_list"),
        F.array(F.lit("a")).alias("stop_strings"), F.when(F.col("id") == 7, F.lit("[SKIPPED: x]")).alias("skip_note"),
        F.array(F.col("id")).alias("kept"),
    )

    def make():
        def scorer(batch):
            assert len(batch) <= 4 and batch["is_list"].nunique() == 1
            assert list(batch.columns) == ["prompt", "is_list", "stop_strings"]
            if "p7" in set(batch["prompt"]):
                raise AssertionError("skipped rows must not be sent")
            if "p11" in set(batch["prompt"]):
                raise ValueError("eleven")
            return batch["prompt"].str.upper()

        return scorer

    scored = scoring.score(df, make, settings=["is_list", "stop_strings"], batch_size=4, skip="skip_note")
    rows = {r.id: r for r in scored.collect()}
    assert rows[3].raw == "P3" and rows[3].kept == [3] and rows[3].error is None
    assert rows[7].raw == "[SKIPPED: x]" and rows[11].raw is None and rows[11].error == "eleven"
    assert sum(r.error is not None for r in rows.values()) == 1 and len(rows) == 50


def test_score_reports_a_wrong_number_of_outputs(spark):
    scored = scoring.score(spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1), lambda: (lambda b: ["x", "y", "z"]))
    assert all("outputs out" in r.error for r in scored.collect())


def test_checks(spark):
    df = spark.createDataFrame([(1, 2), (1, None), (3, 9)], "id int, v int")
    report = checks.check_contract(df, "id", {"small": F.col("v") < 5})
    assert tuple(report.first()) == (3, 2, 2)
    with pytest.raises(ValueError, match="not unique.*expected 4 rows.*small: 2"):
        checks.enforce(report, 4)
    checks.enforce(checks.check_contract(df.filter("v = 9"), "id", {"large": F.col("v") > 5}), 1)
    with pytest.raises(RuntimeError):
        checks.enforce_complete(df, df.filter("id = 1"), ["id"])
    assert checks.duplicates(df, ["id"]).first().n == 2


def test_selection_stops_at_the_nth_table(spark):
    report = spark.createDataFrame([(f"t{i}", i, i % 3 != 0) for i in range(30)], "table_id string, pos long, all_complete boolean")
    assert [r.pos for r in selection.first_complete(report, 3).orderBy("pos").collect()] == [1, 2, 4]
    assert [r.pos for r in selection.scanned_until(report, 3).orderBy("pos").collect()] == [0, 1, 2, 3, 4]
    assert selection.scanned_until(report, 99).count() == 30
    assert selection.first_complete(report, 0).count() == 0


def test_budget_report(spark):
    prompts = spark.createDataFrame(
        [("a", "t", "f", 5), ("a", "u", "f", 50), ("a", "t", "g", 60), ("b", "t", "f", 5)],
        "table_id string, task string, fmt string, prompt_tokens int",
    )
    tables = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "table_id string, pos long")
    report = selection.budget_report(prompts, 10, tables)
    found = {r.table_id: (r.max_prompt_tokens_seen, r.n_failing_instances, r.all_complete) for r in report.collect()}
    assert found == {"a": (60, 2, False), "b": (5, 0, True), "c": (0, 0, True)}
    assert selection.budget_report(prompts, 0).filter("not all_complete").count() == 0
    nested = {r.table_id: r.failing_instances for r in selection.diagnostics(report, prompts, 10).collect()}
    assert [tuple(f) for f in nested["a"]] == [("t", "g", 60), ("u", "f", 50)] and nested["c"] == []
    marked = selection.mark_long_prompts(prompts, 10).filter("table_id = 'a' and fmt = 'g'").first()
    assert marked.skip_note == "[SKIPPED: 60 tokens > 10]"
    assert selection.mark_long_prompts(prompts, 10, "drop").count() == 2


def test_list_order(spark):
    tables = spark.createDataFrame([("a",), ("b",), ("c",)], "table_id string")
    listed = spark.createDataFrame([(0, "c"), (1, "x"), (2, "a")], "ord int, table_id string")
    assert {r.table_id: r.ord for r in selection.with_list_order(tables, listed).collect()} == {"c": 0, "a": 2}
    assert {r.table_id: r.ord for r in selection.with_list_order(tables, listed, True).collect()}["b"] == 10**9


def echo():
    """A model that repeats the question line of the prompt."""

    def scorer(batch):
        return batch["prompt"].str.extract(r"Question: ([^\n]*)\nAnswer: \[/INST\]$")[0]

    return scorer


def agreeing_judge():
    return lambda batch: ['{"content_correct": true, "overinclusive": false}'] * len(batch)


@pytest.fixture()
def raw_folder(spark, tmp_path):
    folder = tmp_path / "raw" / "split=train"
    folder.mkdir(parents=True)
    header, rows = CLUBS
    records = [
        {"id": "nt-2", "question": " which? ", "answers": ["x", " "], "table": {"header": header, "rows": rows}},
        {"question": "second?", "answer_text": [], "answer": "y", "column_names": ["a"], "content_values": [[1], [None]]},
        {"id": "none", "question": "no answer", "answers": [], "table": {"header": header, "rows": rows}},
        {"id": "bad", "answers": ["z"], "table": {"header": [], "columns": [], "rows": rows}},
    ]
    (folder / "part.json").write_text("\n".join(json.dumps(r) for r in records), encoding="utf-8")
    return str(tmp_path / "raw")


def test_whole_run(spark, raw_folder, tmp_path):
    tables = jobs.prepare_corpus(spark, raw_folder, str(tmp_path / "corpus"), n_samples=None)
    found = {t.table_id: t for t in tables.collect()}
    assert set(found) == {"nt-2", "1"} and found["nt-2"].answers == ["x"] and found["nt-2"].question == "which?"
    assert found["1"].rows == [["1"], ["None"]] and found["1"].answers == ["y"]
    tasks = jobs.prepare_tasks(spark, str(tmp_path / "corpus"), str(tmp_path / "tasks"))
    assert tasks.filter("table_id = 'nt-2'").count() == 11
    manifest = spark.read.json(str(tmp_path / "tasks" / "manifest")).first()
    assert manifest.n_task_rows == tasks.count() and manifest.tasks_per_table.cell_lookup == 3

    selected, diagnostics = jobs.select_tables(tables, tasks, ["tsv", "json"], 1, max_tokens=200)
    assert [r.table_id for r in selected.collect()] == ["1"]
    corpus.write_selection(selected, diagnostics, str(tmp_path / "sel"), "m", ["tsv", "json"], 200, 1)
    again = corpus.read_selection(spark, str(tmp_path / "sel" / "selection"))
    assert [(r.ord, r.table_id) for r in again.collect()] == [(0, "1")]

    target = jobs.wanted_instances(tables, ["tsv", "json"], tasks)
    output = str(tmp_path / "predictions")

    def run(formats, name, model=echo, **options):
        return jobs.run_predictions(
            tables, formats, model, output, name, tasks=tasks, max_tokens=300, **options
        )

    half = run(["tsv"], "run1")
    full = run(["tsv", "json"], "run1")
    assert full.count() == target.count() == 2 * half.count()
    assert full.select(*fixed.INSTANCE_KEY).distinct().count() == full.count()
    skipped = full.filter(F.col("raw").startswith("[SKIPPED:"))
    assert skipped.count() > 0 and skipped.filter("pred <> ''").count() == 0
    assert full.filter("pred = question").count() > 0
    assert run(["tsv", "json"], "run1").count() == target.count()
    assert run(["json"], "run1").count() == half.count()
    assert run(["json"], "run1", keep_stale=True).count() == target.count()
    chosen = spark.createDataFrame([("1",)], "table_id string")
    only = run(["tsv"], "run3", selected=chosen, one_shot=True)
    assert {r.table_id for r in only.collect()} == {"1"}

    def broken():
        return lambda batch: 1 / 0

    # failures are kept apart from answers, tried again, and give way to answers
    failed = run(["tsv"], "run4", broken)
    assert failed.count() == half.count() and failed.filter("error is null and raw not like '[SKIPPED:%'").count() == 0
    assert failed.filter("pred is not null and error is not null").count() == 0
    assert run(["tsv"], "run4", broken).count() == half.count()
    mended = run(["tsv"], "run4")
    assert mended.count() == half.count() and mended.filter("error is not null").count() == 0
    assert mended.filter("pred = question").count() == half.filter("pred = question").count()
    none = spark.createDataFrame([("nowhere",)], "table_id string")
    assert run(["tsv"], "run5", selected=none).count() == 0

    seeded = run(["tsv", "json"], "run2", broken, seed_path=f"{output}/run_id=run1")
    assert seeded.count() == target.count() and seeded.filter("raw like '%zero%'").count() == 0

    paths = [f"{output}/run_id=run1", f"{output}/run_id=run2"]
    judged = jobs.run_judge(spark, paths, agreeing_judge, str(tmp_path / "verdicts"), summary_prefix="p")
    assert judged.count() == 2 * (target.count() - skipped.count())
    assert {r.run_id for r in judged.select("run_id").distinct().collect()} == {"run1", "run2"}
    assert jobs.run_judge(spark, paths, agreeing_judge, str(tmp_path / "verdicts")).count() == judged.count()
    fmt = spark.read.option("header", True).csv(str(tmp_path / "verdicts_summary" / "p_judge_accuracy_by_fmt"))
    assert {r.relaxed_accuracy for r in fmt.collect()} == {"1.0"}
    with pytest.raises(FileNotFoundError):
        results.read_predictions(spark, [str(tmp_path / "nowhere")])


def test_own_questions(spark, raw_folder, tmp_path):
    tables = jobs.prepare_corpus(spark, raw_folder, str(tmp_path / "c"), n_samples=1, sort_by_size=True)
    assert [t.table_id for t in tables.collect()] == ["nt-2"]
    rows = jobs.run_predictions(tables, ["md"], echo, str(tmp_path / "p"), "r").collect()
    assert [(r.gold, r.answers, r.pred) for r in rows] == [("x", '["x"]', "which?")]


def test_external_set(spark, tmp_path):
    record = {
        "id": 0, "task_name": fixed.EXTERNAL_TASK, "sub_task_name": "s", "instruction": "{context}|{question}",
        "question_list": ["q"], "golden_answer_list": ["g"],
        "context": {"context_html": "h", "context_latex": "l", "context_markdown": "m"},
    }
    lines = [json.dumps({**record, "id": i}) for i in (10, 9, 2)] + [json.dumps({**record, "id": 1, "task_name": "other"})]
    (tmp_path / "set.jsonl").write_text("\n".join(lines), encoding="utf-8")
    path = str(tmp_path / "set.jsonl")
    with pytest.raises(ValueError, match="expected 637"):
        results.read_external(spark, path)
    records = results.read_external(spark, path, expected_rows=3)
    done = jobs.run_external(records, lambda: (lambda b: b["prompt"].str[-20:]), str(tmp_path / "out"))
    assert done.count() == 9
    with pytest.raises(RuntimeError):
        jobs.run_external(records, lambda: (lambda b: 1 / 0), str(tmp_path / "out2"), ["html"])
    assert jobs.run_external(records, lambda: (lambda b: b["prompt"]), str(tmp_path / "out2"), ["html"]).count() == 3
    assert jobs.run_external(records, lambda: (lambda b: 1 / 0), str(tmp_path / "out")).count() == 9
    html = done.filter("fmt = 'html'").drop("fmt")
    newer = html.filter("id = '9'").withColumn("prediction_list", F.array(F.lit("new")))
    results.write_external(results.merge_external(html, newer), str(tmp_path / "merged"))
    merged = results.read_external_results(spark, str(tmp_path / "merged"), "id string, prediction_list array<string>").collect()
    assert {r.id: r.prediction_list for r in merged}["9"] == ["new"] and len(merged) == 3


def test_streaming_leaves_no_duplicates(spark, tmp_path):
    schema = "table_id string, task string, fmt string, question string, gold string, raw string"
    source, output, log = (str(tmp_path / n) for n in ("in", "out", "log"))

    def arrive(name):
        spark.createDataFrame([(name, "t", "f", "q", "g", "answer")], schema).write.mode("append").parquet(source)

    def run():
        stream = arriving(spark, source, schema)
        incremental_score(stream, lambda b: jobs.judge(b, agreeing_judge), output, log).awaitTermination()
        return sorted(r.table_id for r in spark.read.parquet(output).collect())

    arrive("a")
    arrive("b")
    assert run() == ["a", "b"] and run() == ["a", "b"]
    arrive("c")
    assert run() == ["a", "b", "c"]


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_of_one_file_or_of_a_folder(spark, tmp_path, parts):
    rows = [(i, "x" * i, "en", "web", i) for i in range(7)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(parts)
    documents.write.parquet(str(tmp_path / "all"))
    if parts == 1:
        next((tmp_path / "all").glob("part-*")).rename(tmp_path / "documents.parquet")
    else:
        (tmp_path / "all").rename(tmp_path / "documents.parquet")
    found = catalogue.stream_score(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.raw, r.error) for r in found) == [(i, str(i), None) for i in range(7)]


def test_csv_interchange_keeps_texts(spark, tmp_path):
    values = ["", "NA", "N/A", "None", 'q"uote', "a,b", "line\nbreak", None]
    df = spark.createDataFrame(
        [(f"t{i}", "k", "f", "q", v, 1, 2, "p\np", 3, "x", "r\nr") for i, v in enumerate(values)],
        "table_id string, task string, fmt string, question string, gold string, n_rows int, n_cols int, "
        "prompt string, prompt_tokens int, pred string, raw string",
    )
    results.write_predictions_csv(df, str(tmp_path / "csv"))
    back = {r.table_id: r for r in results.read_predictions_csv(spark, str(tmp_path / "csv")).collect()}
    assert [back[f"t{i}"].gold for i in range(len(values))] == values
    assert back["t0"].raw == "r\nr" and back["t0"].prompt == "p\np"


def test_bare_selection_list(spark, tmp_path):
    (tmp_path / "ids.json").write_text('\n ["b", 7]', encoding="utf-8")
    assert [r.table_id for r in corpus.read_selection(spark, str(tmp_path / "ids.json")).collect()] == ["b", "7"]


def test_canonical_tables_and_tasks(spark, tmp_path):
    header, rows = CLUBS
    lines = [json.dumps({"id": f"t{i}", "question": "q", "answers": ["a"], "header": header, "rows": rows}) for i in range(5)]
    (tmp_path / "tables.jsonl").write_text("\n".join(lines), encoding="utf-8")
    tables = corpus.read_tables(spark, str(tmp_path / "tables.jsonl"))
    assert sorted((t.pos, t.table_id) for t in tables.collect()) == [(i, f"t{i}") for i in range(5)]
    assert {t.table_id for t in corpus.read_tables(spark, str(tmp_path / "tables.jsonl"), 2).collect()} == {"t0", "t1"}
    assert corpus.read_tables(spark, str(tmp_path / "tables.jsonl"), 0).count() == 5
    tasks = [json.dumps({"table_id": t, "task": "k", "question": q, "gold": "g", "n_rows": 1, "n_cols": 1}) for t in "ab" for q in "xyz"]
    (tmp_path / "tasks.jsonl").write_text("\n".join(tasks), encoding="utf-8")
    ids = spark.createDataFrame([("b",)], "table_id string")
    found = corpus.read_tasks(spark, str(tmp_path / "tasks.jsonl"), ids).orderBy("task_seq").collect()
    assert [(t.table_id, t.task_seq, t.question) for t in found] == [("b", 0, "x"), ("b", 1, "y"), ("b", 2, "z")]
