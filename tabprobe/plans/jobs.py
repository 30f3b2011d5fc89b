"""Whole jobs: prepare a corpus, select tables, predict, judge, external set.

Each job is a chain of DataFrame operators that ends in one committed write. Models
and judges are callables, see ``operators.scoring``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe import fixed_values as fixed
from tabprobe.functions.extract import extract_answer
from tabprobe.functions.text import strip, token_count
from tabprobe.operators import checks, ingest, prompts, resume, sampling, scoring, selection, serialise
from tabprobe.operators import summary as summaries
from tabprobe.operators.tasks import generate_tasks
from tabprobe.sources import corpus, results, runs, versions

Maker = Callable[[], Callable]


def prepare_corpus(
    spark: SparkSession,
    source: str,
    output: str,
    split: str = "test",
    n_samples: int | None = None,
    seed: int = 42,
    max_rows: int | None = None,
    max_cols: int | None = None,
    sort_by_size: bool = False,
    sampler: str = "hash",
    fmt: str = "json",
) -> DataFrame:
    """Raw records to a written corpus; positions follow the draw or size order."""
    tables = ingest.parse_tables(
        corpus.read_raw(spark, source, split, fmt), max_rows=max_rows, max_cols=max_cols
    )
    if sort_by_size:
        chosen = ingest.largest_tables(tables, n_samples).withColumns(
            {"_rows": -F.size("rows"), "_cols": -F.size("header")}
        )
        order = ["_rows", "_cols", "pos"]
    else:
        chosen, order = sampling.sample_tables(tables, n_samples, seed, sampler), ["draw", "pos"]
    ordered = _renumber(chosen, order)
    corpus.write_tables(
        ordered,
        output,
        {
            "dataset": source, "split": split, "seed": seed, "max_rows": max_rows,
            "max_cols": max_cols, "sort_by_size": sort_by_size,
        },
    )
    return corpus.load_tables(spark, output)


def _renumber(tables: DataFrame, order: Sequence[str]) -> DataFrame:
    from tabprobe.operators.numbering import number_rows

    renamed = tables.withColumnRenamed("pos", "_pos")
    by = ["_pos" if c == "pos" else c for c in order]
    return number_rows(renamed, by).select(
        "table_id", "pos", "question", "answers", "header", "rows"
    )


def prepare_tasks(
    spark: SparkSession, tables_path: str, output: str, seed: int = 42, sampler: str = "hash"
) -> DataFrame:
    tables = corpus.load_tables(spark, tables_path)
    corpus.write_tasks(generate_tasks(tables, seed, sampler=sampler), output, seed, tables_path)
    return spark.read.parquet(f"{output}/tasks")


def select_tables(
    tables: DataFrame,
    tasks: DataFrame,
    formats: Sequence[str],
    n_tables: int,
    max_tokens: int = fixed.MAX_PROMPT_TOKENS,
    count_tokens: Callable[[Column], Column] = token_count,
) -> tuple[DataFrame, DataFrame]:
    """(selected, diagnostics): the first tables all of whose prompts fit, and what was looked at to find them.

    Tables are measured in corpus order and only until ``n_tables`` fit; both results read what was measured then.
    """

    def sized(some: DataFrame) -> DataFrame:
        instances = serialise.build_instances(selection.keep_listed(tasks, some), some, formats, measure=count_tokens is token_count)
        return prompts.build_prompts(instances, count_tokens=count_tokens)

    report, measured = selection.scan_until(tables, sized, max_tokens, n_tables)
    scanned = selection.scanned_until(report, n_tables)
    found = selection.diagnostics(scanned, selection.keep_listed(measured, scanned), max_tokens)
    return selection.first_complete(report, n_tables), found


def wanted_instances(
    tables: DataFrame, formats: Sequence[str], tasks: DataFrame | None = None
) -> DataFrame:
    """What a run wants, without texts: structural tasks, or the tables' own questions."""
    if tasks is None:
        return serialise.plan_instances(serialise.question_tasks(tables), formats)
    return serialise.plan_instances(selection.keep_listed(tasks, tables), formats)


def run_predictions(
    tables: DataFrame,
    formats: Sequence[str],
    make_model: Maker,
    output: str,
    run_id: str,
    tasks: DataFrame | None = None,
    selected: DataFrame | None = None,
    n_tables: int | None = None,
    one_shot: bool = False,
    chat: str | Callable[..., Column] = "bracket",
    count_tokens: Callable[[Column], Column] = token_count,
    seed_path: str | None = None,
    max_tokens: int = fixed.MAX_PROMPT_TOKENS,
    batch_size: int = 32,
    keep_stale: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Score what is not done yet and append it; returns the run's wanted rows.

    Finished work is subtracted from slim instances first; texts and prompts are built
    only for the rest. A selection wins over ``n_tables``. ``seed_path`` (an earlier
    run's rows) is used only while this run has none.
    """
    spark = tables.sparkSession
    run_folder = f"{output}/run_id={run_id}"

    def rows() -> DataFrame:
        return spark.read.option("basePath", output).parquet(run_folder).withColumn("run_id", F.lit(run_id))

    if selected is not None:
        kept_tables = selection.keep_listed(tables, selected)
    else:
        kept_tables = ingest.first_tables(tables, n_tables)
    wanted = wanted_instances(kept_tables, formats, tasks)
    if not results.exists(spark, run_folder) and seed_path and results.exists(spark, seed_path):
        seeded = resume.keep_wanted(spark.read.parquet(seed_path), wanted)
        results.append_predictions(seeded, output, run_id)
    # A failed call is not done: its row is tried again, and gives way once another attempt succeeds.
    todo = resume.pending(wanted, resume.succeeded(rows())) if results.exists(spark, run_folder) else wanted
    built = prompts.build_prompts(
        serialise.build_instances(todo, kept_tables, formats, measure=count_tokens is token_count),
        one_shot, formats, chat, count_tokens,
    )
    marked = selection.mark_long_prompts(built.drop("table_text"), max_tokens)
    scored = scoring.score(
        marked, make_model, settings=("is_list", "max_new_tokens", "stop_strings"),
        batch_size=batch_size, skip="skip_note", partitions=partitions,
    )
    answered = scored.withColumn(
        "pred", F.when(F.col("error").isNull(), extract_answer(F.col("raw"), F.col("is_list")))
    )
    if "answers" in answered.columns:
        answered = serialise.encode_answers(answered)
    results.append_predictions(answered, output, run_id)
    if results.exists(spark, run_folder):
        finished = resume.settled(rows())
    else:
        # Nothing was wanted, and an empty append leaves no folder.
        present = [c for c in results.PREDICTION_COLUMNS if c in answered.columns]
        empty = answered.select(*present, F.lit(run_id).alias("run_id")).schema
        finished = spark.createDataFrame([], empty)
    kept = resume.carry_over(finished, wanted, keep_stale=keep_stale)
    counts = kept.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("error").alias("failed"),
        F.count_if(F.col("raw").startswith(fixed.SKIP_PREFIX)).alias("skipped"),
    ).first()
    corpus.write_manifest(
        spark,
        f"{output}_manifest/{run_id}",
        {
            "model": run_id, "n_rows": counts["rows"], "skipped_long_prompts": counts["skipped"], "failed": counts["failed"],
            "max_prompt_tokens": max_tokens, "judge_target_field": "raw",
        },
    )
    return kept


def judge(
    predictions: DataFrame,
    make_judge: Maker,
    done: DataFrame | None = None,
    target_field: str = "raw",
    version: str = "current",
    batch_size: int = 32,
    key: Sequence[str] = tuple(fixed.INSTANCE_KEY),
) -> DataFrame:
    """Verdict rows for every prediction that has none yet and was not skipped."""
    todo = resume.pending(predictions, done, key) if done is not None else predictions
    asked = prompts.judge_prompts(
        resume.judgeable(todo, target_field), target_field, version
    ).withColumn("prediction_sent_to_judge", F.col(target_field))
    scored = scoring.score(
        asked, make_judge, inputs=("judge_prompt",), batch_size=batch_size, output="raw_judge", error_as_output=True
    )
    return summaries.parse_verdicts(scored.withColumn("raw_judge", strip(F.col("raw_judge"))))


def run_judge(
    spark: SparkSession,
    prediction_paths: Sequence[str],
    make_judge: Maker,
    output: str,
    run_ids: Sequence[str] | None = None,
    write_summary: bool = True,
    overwrite_summary: bool = False,
    summary_prefix: str | None = None,
    **options,
) -> DataFrame:
    """Judge many runs, Parquet or CSV, in one job: the judge is loaded once per worker for all of them.

    CSV records that are malformed are not judged; they are set aside, with run and file, below ``{output}_malformed``.
    """
    results.require(spark, prediction_paths)
    predictions, malformed = runs.read_runs(spark, prediction_paths, run_ids)
    versions.replace(malformed, f"{output}_malformed", "parquet")
    key = ["run_id", *fixed.INSTANCE_KEY]
    done = spark.read.parquet(output) if results.exists(spark, output) else None
    judged = judge(predictions, make_judge, done, key=key, **options)
    results.append_verdicts(judged, output, extra=["run_id"])
    verdicts = resume.keep_wanted(spark.read.parquet(output), predictions, key)
    if write_summary:
        results.write_summaries(verdicts, f"{output}_summary", overwrite_summary, summary_prefix)
    return verdicts


def run_external(
    records: DataFrame,
    make_model: Maker,
    output: str,
    formats: Sequence[str] = tuple(fixed.EXTERNAL_CONTEXTS),
    batch_size: int = 8,
) -> DataFrame:
    """Predictions for the external set, per context form, resumable by id.

    What succeeded is stored; if any call failed, the job says so, and the next run tries only the rest.
    """
    spark = records.sparkSession
    contexts = {f: fixed.EXTERNAL_CONTEXTS[f] for f in formats}
    target = prompts.external_prompts(records, contexts)
    key = ["fmt", "id"]
    done = spark.read.parquet(output) if results.exists(spark, output) else None
    todo = resume.pending(target, done, key) if done is not None else target
    scored = scoring.score(todo, make_model, batch_size=batch_size)
    resume.succeeded(scored).select(
        "fmt", "id", "task_name", "sub_task_name", "golden_answer_list",
        F.array("raw").alias("prediction_list"),
    ).write.mode("append").parquet(output)
    produced = spark.read.parquet(output)
    checks.enforce_complete(target, produced, key)
    return produced
