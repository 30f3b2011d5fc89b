"""The operators applied to the TPC-H-like test tables, one query per operator.

Row tables stand in for table corpora, documents for raw model output, labels for
verdicts. Every query reads whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabprobe import fixed_values as fixed
from tabprobe.functions.extract import extract_list, extract_scalar
from tabprobe.functions.formats import FORMATS
from tabprobe.functions.markup import (
    counted_tokens,
    markup_length,
    markup_spans,
    markup_tokens,
    separator_spans_in_place,
    token_offsets,
    token_offsets_in_place,
)
from tabprobe.functions.text import (
    escape_newlines,
    fill_dynamic,
    let,
    seeded_digest,
    token_count,
    unescape_newlines,
)
from tabprobe.operators import checks, ingest, longform, prompts, resume, sampling, scoring, selection
from tabprobe.operators import markup as marks
from tabprobe.operators import summary as summaries
from tabprobe.operators.conversations import render_conversations
from tabprobe.operators.distinct import evaluate_distinct
from tabprobe.operators.numbering import number_rows
from tabprobe.operators.serialise import (
    build_instances,
    generate_instances,
    plan_instances,
    question_instances,
    serialise_tables,
)
from tabprobe.operators.tasks import generate_tasks, unique_values, value_positions
from tabprobe.plans.jobs import judge, run_judge, run_predictions
from tabprobe.session import ensure_checkpoints, shared_folder
from tabprobe.sources import corpus, results, versions
from tabprobe.sources.runs import CSV
from tabprobe.streaming.incremental import arriving, incremental_score, incremental_summaries, summaries_now

Query = Callable[[SparkSession, str], DataFrame]

ORDER_SORT = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)").cast("string")


def order_columns() -> dict[str, Column]:
    return {
        "line": F.col("l_linenumber"),
        "part": F.col("l_partkey"),
        "supplier": F.col("l_suppkey"),
        "quantity": money("l_quantity"),
        "price": money("l_extendedprice"),
        "discount": money("l_discount"),
        "tax": money("l_tax"),
        "returned": F.col("l_returnflag"),
        "status": F.col("l_linestatus"),
        "shipped": F.date_format("l_shipdate", "yyyy-MM-dd"),
    }


def customer_columns() -> dict[str, Column]:
    return {
        "customer": F.col("c_custkey"),
        "name": F.col("c_name"),
        "balance": money("c_acctbal"),
        "segment": F.col("c_mktsegment"),
    }


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.tables_from_rows(
        read(spark, sf_dir, "lineitem"), "l_orderkey", ORDER_SORT, order_columns()
    )


#: Stored bytes of lines whose tables one task makes at most, where what is made of them takes many times their room.
DEALT_BYTES = 1 << 20


def dealt_order_tables(spark: SparkSession, sf_dir: str, stored_bytes: int = DEALT_BYTES) -> DataFrame:
    """``order_tables``, dealt by their ids into so many partitions that a task need not spill what it makes of its tables; those are not coalesced."""
    lines = read(spark, sf_dir, "lineitem")
    stored = int(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored // stored_bytes))
    dealt = lines.repartition(parts, F.col("l_orderkey").cast("string"))
    return ingest.tables_from_rows(dealt, "l_orderkey", ORDER_SORT, order_columns())


def customer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, twenty consecutive keys to a table."""
    customers = read(spark, sf_dir, "customer").withColumn("block", F.expr("c_custkey div 20"))
    return ingest.tables_from_rows(customers, "block", ["c_custkey"], customer_columns())


def conversation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"turn": F.col("turn"), "role": F.col("role"), "text": F.col("text")}
    return ingest.tables_from_rows(
        read(spark, sf_dir, "conversations"), "conv_id", ["turn"], columns
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = read(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id", "left").select(
        "doc_id",
        F.col("lang").alias("task"),
        F.col("source").alias("fmt"),
        (F.col("quality") == 1).alias("content_correct"),
        (F.col("quality") == 0).alias("content_partial"),
        (F.col("n_chars") > 500).alias("format_correct"),
        (F.col("toxic") == 1).alias("overinclusive"),
        (F.col("n_chars") > 2000).alias("instruction_following_error"),
    )


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _kept(df: DataFrame, folder: str) -> DataFrame:
    """What was read back from a query's own folder, settled, so that the folder can go."""
    ensure_checkpoints(df.sparkSession)
    try:
        return df.checkpoint()
    finally:
        versions.remove(df.sparkSession, folder)


def _shown(tables: DataFrame, *more: Column) -> DataFrame:
    return tables.select(
        "table_id",
        F.size("rows").alias("n_rows"),
        F.size("header").alias("n_cols"),
        F.to_json("header").alias("header"),
        F.to_json("rows").alias("rows"),
        *more,
    )


# --- corpora ----------------------------------------------------------------
def tables_from_rows(spark, sf_dir):
    return _shown(order_tables(spark, sf_dir))


def truncate_tables(spark, sf_dir):
    return _shown(ingest.truncate_tables(customer_tables(spark, sf_dir), max_rows=15, max_cols=3))


def parse_tables(spark, sf_dir):
    """Stored records in the alternative shapes, some unusable, parsed back to tables in the order of their files; the wanted split is missing."""
    t = order_tables(spark, sf_dir)
    kind = F.col("pos") % 5
    empty = F.array().cast("array<string>")
    raw = t.select(
        F.col("pos").alias("seq"),
        F.when(kind != 3, F.concat(F.lit("t"), F.col("table_id"))).alias("id"),
        F.concat(F.lit("  order "), F.col("table_id"), F.lit("? \n")).alias("question"),
        F.struct(
            F.when(kind == 0, F.col("header")).otherwise(empty).alias("header"),
            F.when(kind == 1, F.col("header")).alias("columns"),
            F.when(kind <= 1, F.col("rows")).alias("data"),
        ).alias("table"),
        F.when(kind >= 2, F.col("header")).alias("table_column_names"),
        F.when(kind >= 2, F.col("rows")).alias("content_values"),
        F.when(kind == 4, F.array(F.lit(" "))).otherwise(empty).alias("answer_text"),
        F.when(kind != 4, F.col("rows")[0][0]).alias("answer"),
    )
    folder = _folder(spark, "records")
    raw.orderBy("seq").drop("seq").write.json(f"{folder}/split=train")
    parsed = ingest.parse_tables(corpus.read_raw(spark, folder, "test", schema=raw.drop("seq").schema))
    return _kept(_shown(parsed, F.col("pos"), F.col("question"), F.to_json("answers").alias("answers")), folder)


def canonical_tables(spark, sf_dir):
    """Table records as JSON lines, numbered in the order of their files."""
    folder = _folder(spark, "canonical")
    t = order_tables(spark, sf_dir).orderBy("pos")
    t.select(F.concat(F.lit("t"), "table_id").alias("id"), F.lit("q").alias("question"), F.array(F.lit("a")).alias("answers"), "header", "rows").write.json(folder)
    return _kept(_shown(corpus.read_tables(spark, folder), F.col("pos"), F.col("question"), F.to_json("answers").alias("answers")), folder)


def task_records(spark, sf_dir):
    """Task records as JSON lines, numbered per table in the order of their files, of urgent orders."""
    folder = _folder(spark, "task-records")
    generate_tasks(order_tables(spark, sf_dir)).drop("task_seq").write.json(folder, compression="gzip")
    urgent = read(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").cast("string").alias("table_id"))
    return _kept(corpus.read_tasks(spark, folder, urgent), folder)


def cells(spark, sf_dir):
    return ingest.cells(order_tables(spark, sf_dir))


def largest_tables(spark, sf_dir):
    top = ingest.largest_tables(order_tables(spark, sf_dir), 200)
    return top.select("table_id", F.size("rows").alias("n_rows"), F.size("header").alias("n_cols"))


def first_tables(spark, sf_dir):
    return ingest.first_tables(order_tables(spark, sf_dir), 300).select("table_id", "pos")


def hash_sample_tables(spark, sf_dir):
    return sampling.sample_tables(order_tables(spark, sf_dir), 300).select("table_id", "draw")


def hash_sample_half(spark, sf_dir):
    """Half of all tables, drawn exactly."""
    half = read(spark, sf_dir, "lineitem").agg(F.count_distinct("l_orderkey")).first()[0] // 2
    return sampling.sample_tables(order_tables(spark, sf_dir), half).select("table_id", "draw")


def number_tables(spark, sf_dir):
    """Dense positions over a whole table, in value order."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return number_rows(orders, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "pos")


# --- formats ----------------------------------------------------------------
def format_query(fmt: str) -> Query:
    tables = conversation_tables if fmt in ("csv", "csv_q", "json") else order_tables

    def query(spark, sf_dir):
        return serialise_tables(tables(spark, sf_dir), [fmt])

    return query


def serialise_long(spark, sf_dir):
    """Whole customer lists per nation, in parts of 50 rows and all formats."""
    return longform.serialise_rows(
        read(spark, sf_dir, "customer"), "c_nationkey", ["c_custkey"], customer_columns(),
        longform.LONG_FORMATS, part_rows=50,
    )


# --- tasks ------------------------------------------------------------------
def value_positions_query(spark, sf_dir):
    return value_positions(order_tables(spark, sf_dir))


def unique_values_query(spark, sf_dir):
    return unique_values(order_tables(spark, sf_dir))


def task_query(tables: Query, kinds: Sequence[str]) -> Query:
    def query(spark, sf_dir):
        return generate_tasks(tables(spark, sf_dir), kinds=kinds)

    return query


def generate_tasks_query(spark, sf_dir):
    return generate_tasks(order_tables(spark, sf_dir))


def generate_tasks_mt19937(spark, sf_dir):
    return generate_tasks(order_tables(spark, sf_dir), sampler="mt19937")


def tasks_mt19937_checked(spark, sf_dir):
    """Tasks drawn by the standard library's generator: how many of each kind a table has, and how many golds its cells bear out."""
    tables = order_tables(spark, sf_dir)
    drawn = generate_tasks(tables, sampler="mt19937").join(tables.select("table_id", "header", "rows"), "table_id")
    header, rows, question, gold = F.col("header"), F.col("rows"), F.col("question"), F.col("gold")

    def number(text: Column) -> Column:
        return F.regexp_extract(text, "row ([0-9]+)", 1).cast("int")

    def column(text: Column) -> Column:
        return F.array_position(header, F.regexp_extract(text, "column '([^']*)'", 1)).cast("int")

    # found once per task: within a lambda it would be searched for again at each cell
    value = F.regexp_extract(question, "the value '(.*)' appear", 1)
    right = (
        F.when(F.col("task") == "size_detection", gold == F.concat(F.size("rows").cast("string"), F.lit(" rows, "), F.size("header").cast("string"), F.lit(" columns")))
        .when(F.col("task") == "cell_lookup", gold == F.get(F.get(rows, number(question) - 1), column(question) - 1))
        .when(
            F.col("task") == "reverse_lookup",
            let(value, lambda asked: (F.get(F.get(rows, number(gold) - 1), column(gold) - 1) == asked) & (F.size(F.filter(F.flatten(rows), lambda v: v == asked)) == 1)),
        )
        .when(F.col("task") == "row_retrieval", gold == F.array_join(F.get(rows, number(question) - 1), "\n"))
        .otherwise(gold == let(column(question) - 1, lambda c: F.array_join(F.transform(rows, lambda r: F.get(r, c)), "\n")))
    )
    kinds = ["size_detection", "cell_lookup", "reverse_lookup", "row_retrieval", "col_retrieval"]
    return drawn.groupBy("table_id").agg(
        *[F.count_if(F.col("task") == k).alias(f"n_{k}") for k in kinds], F.count_if(right).alias("n_right"), F.countDistinct("task", "question").alias("n_different")
    )


# --- prompts ----------------------------------------------------------------
def _prompt_sums(df: DataFrame) -> DataFrame:
    """Per table and format: how many prompts, their tokens and limits, characters of stop strings, and a sum of the prompts' 48-bit digests."""

    def digest(text: Column) -> Column:
        return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")

    return df.groupBy("table_id", "fmt").agg(
        F.count(F.lit(1)).alias("n_prompts"), F.count_if("is_list").alias("n_lists"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("max_new_tokens").alias("max_new_tokens"), F.sum(digest(F.col("prompt"))).alias("prompt_digests"),
        F.sum(F.length(F.array_join("stop_strings", "|"))).alias("stop_chars"),
    )


def prompts_zero_shot(spark, sf_dir):
    """All kinds of stored tasks, joined to their stored tables, in all formats."""
    folder = _folder(spark, "zero-shot")
    order_tables(spark, sf_dir).write.parquet(f"{folder}/tables")
    tables = spark.read.parquet(f"{folder}/tables")
    generate_tasks(tables).write.parquet(f"{folder}/tasks")
    built = prompts.build_prompts(build_instances(spark.read.parquet(f"{folder}/tasks"), tables, list(FORMATS)))
    return _kept(_prompt_sums(built), folder)


def prompts_one_shot(spark, sf_dir):
    """All kinds and formats straight from the tables, behind a worked example."""
    return _prompt_sums(prompts.build_prompts(generate_instances(order_tables(spark, sf_dir), list(FORMATS)), one_shot=True))


def prompts_questions(spark, sf_dir):
    """The tables' own questions, with several answers as gold."""
    tables = order_tables(spark, sf_dir).withColumns(
        {
            "question": F.concat(F.lit("Which parts are in order "), F.col("table_id"), F.lit("?")),
            "answers": F.transform("rows", lambda r: r[1]),
        }
    )
    built = prompts.build_prompts(question_instances(tables, ["tsv", "yaml"]))
    return built.select(
        "table_id", "task", "fmt", "gold", F.to_json("answers").alias("answers"), "n_rows", "n_cols",
        "prompt_tokens", F.md5("prompt").alias("prompt_md5"), F.md5(F.array_join("stop_strings", "|")).alias("stop_md5"),
    )


def chat_render(spark, sf_dir):
    return render_conversations(read(spark, sf_dir, "conversations"))


def template_fill(spark, sf_dir):
    """A template per document; its text may itself hold braces."""
    documents = read(spark, sf_dir, "documents")
    template = F.concat(
        F.lit("{context}\n{{"), F.col("source"), F.lit("}} {question} {{"), F.col("lang"), F.lit("}}")
    )
    question = F.concat(F.lit("what does {context} "), F.col("doc_id").cast("string"), F.lit(" say?"))
    filled = fill_dynamic(template, context=F.col("text"), question=question)
    return documents.select("doc_id", F.md5(filled).alias("prompt_md5"))


def mcq_prompt(spark, sf_dir):
    """The customers of a block of twenty as choices."""
    records = customer_tables(spark, sf_dir).select(
        "pos",
        F.concat(F.lit("Which customer is in block "), F.col("table_id"), F.lit("?")).alias("question"),
        F.transform("rows", lambda r: r[1]).alias("choices"),
    )
    return prompts.choice_prompts(records)


def judge_prompt_query(version: str) -> Query:
    def query(spark, sf_dir):
        asked = prompts.judge_prompts(_document_predictions(spark, sf_dir), version=version)
        return asked.select(
            "table_id", "task", "fmt", "target_field", "judge_prompt_tokens",
            F.md5("judge_prompt").alias("judge_prompt_md5"),
        )

    return query


def _document_predictions(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("table_id"),
        F.col("lang").alias("task"),
        F.col("source").alias("fmt"),
        F.concat(F.lit("question "), F.col("doc_id").cast("string")).alias("question"),
        F.col("n_chars").cast("string").alias("gold"),
        F.col("text").alias("raw"),
    )


# --- budgets and selection --------------------------------------------------
BUDGET = 1000


def _document_prompts(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.col("source").alias("table_id"),
        F.col("lang").alias("task"),
        F.col("doc_id").cast("string").alias("fmt"),
        token_count(F.col("text")).alias("prompt_tokens"),
    )


def prompt_budget(spark, sf_dir):
    return selection.budget_report(_document_prompts(spark, sf_dir), BUDGET)


def failing_instances(spark, sf_dir):
    return selection.failing_instances(_document_prompts(spark, sf_dir), BUDGET)


def mark_long_prompts(spark, sf_dir):
    return selection.mark_long_prompts(_document_prompts(spark, sf_dir), BUDGET).select(
        "fmt", "prompt_tokens", "skip_note"
    )


SELECT_BUDGET = 700
SELECT_N = 150


def select_until_n(spark, sf_dir):
    """Stored tables scanned until 150 fit 700 tokens in all kinds and formats, with their report."""
    folder = _folder(spark, "scan")
    order_tables(spark, sf_dir).write.parquet(folder)

    def measure(some: DataFrame) -> DataFrame:
        return prompts.build_prompts(generate_instances(some, list(FORMATS)))

    report, _ = selection.scan_until(spark.read.parquet(folder), measure, SELECT_BUDGET, SELECT_N)
    return _kept(selection.scanned_until(report, SELECT_N), folder)


def order_by_id_list(spark, sf_dir):
    """All tables with their place in a list of urgent orders, dearest first."""
    urgent = (
        read(spark, sf_dir, "orders")
        .filter(F.col("o_orderpriority") == "1-URGENT")
        .select(F.col("o_orderkey").cast("string").alias("table_id"), (-F.col("o_totalprice")).alias("_price"))
    )
    listed = number_rows(urgent, ["_price", "table_id"], name="ord")
    tables = order_tables(spark, sf_dir).select("table_id", F.size("rows").alias("n_rows"))
    return selection.with_list_order(tables, listed, keep_unlisted=True)


# --- extraction and verdicts ------------------------------------------------
def extract_scalar_query(spark, sf_dir):
    documents = read(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Reasoning. Answer: "), F.col("text"))).otherwise(
        F.concat(F.lit("- key: "), F.col("text"))
    )
    return documents.select("doc_id", extract_scalar(raw).alias("pred"))


def extract_list_query(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", extract_list(F.col("text")).alias("pred"))


def newline_escape(spark, sf_dir):
    documents = read(spark, sf_dir, "documents")
    escaped = escape_newlines(F.col("text"))
    return documents.select(
        "doc_id", F.md5(escaped).alias("escaped_md5"), F.md5(unescape_newlines(escaped)).alias("restored_md5")
    )


def parse_verdict(spark, sf_dir):
    """Judge texts of every shape: clean, in prose, doubled, broken, list, odd booleans."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id") % 8
    correct = F.when(k == 6, F.lit('"TRUE"')).when(k == 7, F.lit("1")).otherwise(F.lit("true"))
    body = F.concat(
        F.lit('{"content_correct": '), correct,
        F.lit(', "overinclusive": false, "score": '), F.round("value").cast("int").cast("string"),
        F.lit(', "reason": "'), F.col("event_type"), F.lit('", "extra": '), F.col("props"), F.lit("}"),
    )
    text = (
        F.when(k == 1, F.concat(F.lit("Sure, here it is:\n```json\n"), body, F.lit("\n``` done")))
        .when(k == 2, F.concat(body, F.lit(" "), body))
        .when(k == 3, F.concat(F.lit("["), body, F.lit("]")))
        .when(k == 4, F.concat(F.lit("no verdict "), F.col("props"), F.lit(" }")))
        .when(k == 5, F.concat(body, F.lit(" trailing")))
        .otherwise(body)
    )
    judged = e.select("event_id", text.alias("raw_judge"))
    return summaries.parse_verdicts(judged).drop("raw_judge")


def row_metrics(spark, sf_dir):
    v = summaries.row_metrics(verdicts(spark, sf_dir))
    return v.select("doc_id", "accuracy_clean", *summaries.METRICS)


def metrics_by_task_fmt(spark, sf_dir):
    return summaries.summarise(verdicts(spark, sf_dir), ["task", "fmt"], digits=None)


def metrics_by_fmt(spark, sf_dir):
    return summaries.summarise(verdicts(spark, sf_dir), ["fmt"])


def metrics_overall(spark, sf_dir):
    return summaries.summarise(verdicts(spark, sf_dir))


def metrics_grouping_sets(spark, sf_dir):
    return summaries.summarise_all(verdicts(spark, sf_dir), digits=None)


def metrics_pivot(spark, sf_dir):
    wide = summaries.summarise_pivot(verdicts(spark, sf_dir), digits=None)
    return wide.select([F.col(c) if c == "task" else F.col(c).cast("double") for c in wide.columns])


# --- incremental runs -------------------------------------------------------
def _document_keys(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


def resume_pending(spark, sf_dir):
    return resume.pending(_document_keys(spark, sf_dir), read(spark, sf_dir, "labels"), ["doc_id"])


def resume_keep(spark, sf_dir):
    """Kept verdicts plus the rows still to do, as one run."""
    documents, labels = _document_keys(spark, sf_dir), read(spark, sf_dir, "labels")
    kept = resume.carry_over(labels, documents, ["doc_id"]).select(
        "doc_id", F.col("quality").cast("string"), F.col("toxic").cast("string")
    )
    return resume.combine(kept, resume.pending(documents, labels, ["doc_id"]).select("doc_id", "lang"))


def run_counts(spark, sf_dir):
    documents = read(spark, sf_dir, "documents").withColumn(
        "raw",
        F.when(F.col("n_chars") > 5000, F.concat(F.lit("[SKIPPED: "), F.col("n_chars").cast("string"), F.lit("]")))
        .otherwise(F.col("text")),
    )
    return resume.run_counts(documents, read(spark, sf_dir, "labels"), ["doc_id"])


def merge_last_wins(spark, sf_dir):
    """Events twice: new values that are later for two thirds and stale for the rest."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    again = e.select(
        "event_id",
        F.upper("event_type").alias("event_type"),
        (F.col("value") * 2).alias("value"),
        F.when(F.col("event_id") % 3 != 0, 1).otherwise(-1).alias("version"),
    )
    return resume.merge_latest(e.withColumn("version", F.lit(0)).unionByName(again), ["event_id"], ["version"])


def contract_checks(spark, sf_dir):
    """Line items against a contract they break: repeated ids, late lines, free parts."""
    rules = {
        "not_in_first_five": F.col("l_linenumber") <= 5,
        "no_discount": F.col("l_discount") > 0,
    }
    return checks.check_contract(read(spark, sf_dir, "lineitem"), "l_orderkey", rules)


def missing_rows(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"))
    return checks.missing_rows(orders, lines, ["order_key"])


def duplicate_ids(spark, sf_dir):
    return checks.duplicates(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def _length_scorer():
    def scorer(batch):
        if (batch["text"].str.len() == 7).any():
            raise ValueError("seven characters")
        return batch["text"].str.len()

    return scorer


def score_batches(spark, sf_dir):
    """A callable per batch; long documents are marked and never sent, failures are data."""
    documents = read(spark, sf_dir, "documents").withColumn(
        "skip_note",
        F.when(
            F.col("n_chars") > 5000, F.concat(F.lit("[SKIPPED: "), F.col("n_chars").cast("string"), F.lit("]"))
        ),
    )
    scored = scoring.score(documents, _length_scorer, inputs=["text"], settings=["lang"], skip="skip_note")
    return scored.select("doc_id", "raw", "error")


def _fussy_scorer():
    def scorer(batch):
        if (batch["text"].str.len() % 7 == 0).any():
            raise ValueError("a multiple of seven")
        return batch["text"].str.len()

    return scorer


def retry_failed(spark, sf_dir):
    """A run in which some calls fail, and the next one, which tries only those again."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    first = scoring.score(documents, _fussy_scorer, inputs=["text"])
    todo = resume.pending(documents, resume.succeeded(first), ["doc_id"])
    second = scoring.score(todo, lambda: (lambda batch: batch["text"].str.len()), inputs=["text"])
    return resume.settled(first.unionByName(second), ["doc_id"]).select("doc_id", "raw", "error")


def _quality_judge():
    def scorer(batch):
        return ['{"content_correct": %s}' % str(len(p) % 2 == 0).lower() for p in batch["judge_prompt"]]

    return scorer


def judge_pending(spark, sf_dir):
    """Judging the documents that have no label yet."""
    predictions = _document_predictions(spark, sf_dir)
    done = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("table_id"))
    judged = judge(predictions, _quality_judge, done, key=["table_id"])
    return judged.select("table_id", "content_correct", "overinclusive", "raw_judge")


def stream_score(spark, sf_dir):
    """Documents as arriving files (one, or a folder of them), scored by an available-now stream."""
    schema = read(spark, sf_dir, "documents").schema
    folder = _folder(spark, "stream")
    # a pattern, as a stream's plain path has to be a folder
    stream = arriving(spark, f"{sf_dir}/documents.parque[t]", schema)

    def score_lengths(batch: DataFrame) -> DataFrame:
        sent = batch.select("doc_id", "text")
        return scoring.score(sent, lambda: (lambda b: b["text"].str.len()), inputs=["text"]).drop("text")

    incremental_score(stream, score_lengths, f"{folder}/out", f"{folder}/log").awaitTermination()
    return _kept(spark.read.parquet(f"{folder}/out").select("doc_id", "raw", "error"), folder)


# --- markup -----------------------------------------------------------------
def markup_html(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return marks.markup_sizes(pages, "html", "html").select("page_id", "n_chars", "n_markup_chars")


def markup_json_colsep(spark, sf_dir):
    texts = serialise_tables(order_tables(spark, sf_dir), ["json", "col_sep"])
    column = F.col("table_text")
    size = F.when(F.col("fmt") == "json", markup_length(column, "json")).otherwise(
        markup_length(column, "col_sep")
    )
    return texts.select("table_id", "fmt", F.length(column).alias("n_chars"), size.alias("n_markup_chars"))


def markup_spans_query(spark, sf_dir):
    """Every markup span of every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", markup_spans(F.col("html"), "html").alias("spans"))
    return marks.explode_spans(pages, ["page_id"], "spans").groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.sum(F.col("end") - F.col("start")).alias("n_markup_chars"),
        F.max("end").cast("bigint").alias("last_end"),
    )


def token_overlap(spark, sf_dir):
    """Markup tokens of every table text, by the sweep over tokens and spans."""
    texts = serialise_tables(order_tables(spark, sf_dir), ["col_sep"])
    located = texts.select(
        "table_id",
        token_offsets(F.col("table_text")).alias("tokens"),
        markup_spans(F.col("table_text"), "col_sep").alias("spans"),
    )
    return marks.swept_tokens(located, ["table_id"]).groupBy("table_id").agg(
        F.count(F.lit(1)).alias("n_markup_tokens"), F.sum("token_idx").alias("sum_token_idx")
    )


def segment_overlap(spark, sf_dir):
    """The same for tokens and spans that are rows of their own, by the segment join.

    Tables are dealt once; what is made of them stays and meets there.
    """
    # a line has some sixty tokens, each a row
    texts = serialise_tables(dealt_order_tables(spark, sf_dir, DEALT_BYTES // 4), ["col_sep"])
    text = F.col("table_text")
    located = texts.select("table_id", token_offsets_in_place(text).alias("tokens"), separator_spans_in_place(text).alias("spans"))
    tokens = marks.explode_spans(located, ["table_id"], "tokens", index="token_idx")
    spans = marks.explode_spans(located, ["table_id"], "spans")
    return marks.overlapping_tokens(tokens, spans, ["table_id"], dealt=True).groupBy("table_id").agg(
        F.count(F.lit(1)).alias("n_markup_tokens"), F.sum("token_idx").alias("sum_token_idx")
    )


def token_positions(spark, sf_dir):
    """The same tokens without a join, inside each text."""
    texts = serialise_tables(order_tables(spark, sf_dir), ["col_sep"])
    text = F.col("table_text")
    found = texts.select(
        "table_id", markup_tokens(text, F.lit(0), F.length(text), "col_sep")["positions"].alias("p")
    )
    return found.select(
        "table_id",
        F.size("p").cast("bigint").alias("n_markup_tokens"),
        F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_token_idx"),
    )


def random_positions(spark, sf_dir):
    """Both controls of every table: the markup one, and twenty random masks of as many positions as the table has lines."""
    texts = serialise_tables(order_tables(spark, sf_dir), ["col_sep"])
    sized = texts.select(
        "table_id",
        token_count(F.col("table_text")).alias("n_tokens"),
        F.regexp_count("table_text", F.lit("\n")).alias("budget"),
    )
    jobs = marks.control_jobs(sized)
    drawn = marks.random_positions(
        F.col("n_tokens"), F.col("budget"), F.col("random_seed"), F.col("table_id")
    )
    drawn = F.when(F.col("random_seed").isNotNull(), drawn)
    return jobs.select(
        "table_id", "patch_group", F.col("random_seed").cast("string").alias("random_seed"),
        F.array_join(F.transform(drawn, lambda p: p.cast("string")), ",").alias("positions"),
    )


def control_positions(spark, sf_dir):
    """Markup tokens in whole prompts and twenty random controls of the same size."""
    instances = generate_instances(order_tables(spark, sf_dir), ["col_sep"], kinds=["size_detection"])
    built = prompts.build_prompts(instances, formats=["col_sep"])
    placed = marks.control_positions(built, "col_sep")
    return placed.select(
        "table_id", "patch_group", F.col("random_seed").cast("string").alias("random_seed"), "patch_positions",
        F.md5(F.array_join(F.transform("positions", lambda p: p.cast("string")), ",")).alias("positions_md5"),
    )


def control_resume(spark, sf_dir):
    """Controls still to run: the markup one is done for even orders, the first (order modulo 20) masks for all, some of them failed."""
    tables = dealt_order_tables(spark, sf_dir)
    tasks = generate_tasks(tables, kinds=["row_retrieval", "col_retrieval"])
    instances = plan_instances(tasks, ["col_sep", "html"]).withColumn("n", F.col("table_id").cast("long"))
    jobs = marks.control_jobs(instances)
    finished = F.when(F.col("random_seed").isNull(), F.col("n") % 2 == 0).otherwise(F.col("random_seed") - 42 < F.col("n") % 20)
    error = F.when((F.col("n") + F.coalesce("random_seed", F.lit(0))) % 7 == 0, F.lit("failed")).alias("error")
    done = jobs.filter(finished).select("table_id", "task", "fmt", "question", "patch_group", "random_seed", error)
    left = marks.pending_controls(instances.select("table_id", "task_seq", "task", "fmt", "question"), done)
    return left.groupBy("table_id", "task_seq", "fmt", "patch_group").agg(F.count(F.lit(1)).alias("n_left"), F.sum("random_seed").alias("sum_seeds"))


def seeded_keys(spark, sf_dir):
    """Stable instance keys and their seeded digests."""
    p = _document_predictions(spark, sf_dir)
    return p.select(
        "table_id",
        marks.instance_key().alias("instance_key"),
        seeded_digest(F.lit(42), marks.instance_key()).alias("digest"),
    )


# --- sources and sinks: written to the shared folder and read back -----------
def stored_tables(spark, sf_dir):
    """Tables written with their manifest, and loaded again."""
    folder = _folder(spark, "tables")
    tables = order_tables(spark, sf_dir).withColumns({"question": F.lit("q"), "answers": F.array(F.lit("a"))})
    corpus.write_tables(tables, folder, {"seed": 42, "max_rows": None})
    manifest = spark.read.json(f"{folder}/manifest").select(F.col("n_tables").alias("n_stored"), "seed")
    stored = manifest.first()  # one row
    return _kept(_shown(corpus.load_tables(spark, folder), F.col("pos"), F.col("question"), *[F.lit(v).alias(c) for c, v in stored.asDict().items()]), folder)


def stored_tasks(spark, sf_dir):
    """Tasks written as rows and as one object per table; the objects, read back."""
    folder = _folder(spark, "tasks")
    corpus.write_tasks(generate_tasks(dealt_order_tables(spark, sf_dir)), folder, 42, sf_dir, compression="gzip")
    schema = "table_id STRING, part BIGINT, tasks ARRAY<STRUCT<task_seq: INT, task: STRING, question: STRING, gold: STRING, n_rows: INT, n_cols: INT>>"
    objects = spark.read.schema(schema).json(f"{folder}/tasks_by_table")
    return _kept(objects.select(
        "table_id", "part", F.size("tasks").alias("n_tasks"), F.md5(F.array_join(F.transform("tasks", lambda t: F.concat(t["task"], F.lit("|"), t["gold"])), "\n")).alias("tasks_md5")
    ), folder)


def stored_selection(spark, sf_dir):
    """A list of urgent orders, written and read back, then used to keep and order their tables."""
    folder = _folder(spark, "selection")
    urgent = read(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    chosen = urgent.select(F.col("o_orderkey").cast("string").alias("table_id"), F.col("o_orderkey").alias("pos"))
    corpus.write_selection(chosen, chosen.select("table_id"), folder, "m", ["tsv"], 100, 10)
    listed = corpus.read_selection(spark, f"{folder}/selection")
    tables = selection.keep_listed(order_tables(spark, sf_dir).select("table_id", F.size("rows").alias("n_rows")), listed)
    return _kept(selection.with_list_order(tables, listed), folder)


def stored_predictions(spark, sf_dir):
    """Predictions of two runs, appended, read together, one of them with failed calls."""
    folder = _folder(spark, "predictions")
    rows = _document_predictions(spark, sf_dir).withColumn("error", F.when(F.length("raw") % 5 == 0, F.lit("failed")))
    results.append_predictions(rows, folder, "first")
    results.append_predictions(rows.withColumn("error", F.lit(None).cast("string")), folder, "second")
    found = results.read_predictions(spark, [f"{folder}/run_id=first", f"{folder}/run_id=second"])
    return _kept(resume.judgeable(found).select("run_id", "table_id", "task", "fmt", F.md5("raw").alias("raw_md5")), folder)


def judge_csv_runs(spark, sf_dir):
    """Runs as CSV in two layouts and as Parquet by format, judged in one job; records without a whole number are set aside and counted."""
    folder = _folder(spark, "mixed-runs")
    rows = _document_predictions(spark, sf_dir).withColumns({"n_rows": F.lit(1), "error": F.lit(None).cast("string")})
    share = F.col("table_id").cast("long") % 3
    results.write_predictions_csv(rows.filter(share == 0), f"{folder}/plain.csv")
    odd = F.when(F.col("table_id").cast("long") % 10 == 1, "many").otherwise("7.0")
    other = rows.filter(share == 1).select(escape_newlines(F.col("raw")).alias("raw"), F.lit("x").alias("note"), *fixed.INSTANCE_KEY[::-1], "gold", odd.alias("n_rows"))
    other.write.options(**CSV).option("emptyValue", '""').csv(f"{folder}/turned.csv")
    results.append_predictions(rows.filter(share == 2), folder, "stored")
    paths = [f"{folder}/plain.csv", f"{folder}/turned.csv", f"{folder}/run_id=stored"]
    judged = run_judge(spark, paths, _quality_judge, f"{folder}/out", write_summary=False)
    aside = versions.load(spark, f"{folder}/out_malformed").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_malformed"))
    found = judged.join(F.broadcast(aside), "run_id", "left").select("run_id", "table_id", "task", "fmt", "content_correct", F.coalesce("n_malformed", F.lit(0)).alias("n_malformed"))
    return _kept(found, folder)


def csv_predictions(spark, sf_dir):
    """Predictions as interchange CSV and back, line ends and quotes included."""
    folder = _folder(spark, "csv")
    rows = _document_predictions(spark, sf_dir).select(
        "table_id", "task", "fmt", "question", "gold", F.lit(1).alias("n_rows"), F.lit(2).alias("n_cols"), F.lit('p"p\n,').alias("prompt"),
        F.lit(3).alias("prompt_tokens"), F.lit(None).cast("string").alias("pred"), "raw", F.lit(None).cast("string").alias("error"),
    )
    results.write_predictions_csv(rows, folder)
    found = results.read_predictions_csv(spark, folder)
    return _kept(found.select("table_id", "task", "fmt", "question", "gold", "prompt", "pred", F.md5("raw").alias("raw_md5")), folder)


def stored_verdicts(spark, sf_dir):
    """Verdicts appended, read back as texts, and parsed to nullable booleans again."""
    folder = _folder(spark, "verdicts")
    results.append_verdicts(verdicts(spark, sf_dir).withColumn("table_id", F.col("doc_id").cast("string")), folder)
    found = spark.read.parquet(folder)
    texts = found.select("table_id", "task", "fmt", *[F.initcap(F.col(c).cast("string")).alias(c) for c in ("content_correct", "content_partial", "overinclusive")])
    return _kept(summaries.verdicts_from_text(texts), folder)


def stored_summaries(spark, sf_dir):
    """The three summaries as CSV, read back: by format, overall, and the wide one by task, a row per format again."""
    folder = _folder(spark, "summaries")
    written = results.write_summaries(verdicts(spark, sf_dir), folder)
    files = {level: spark.read.option("header", True).csv(path) for level, path in written.items()}
    measures = ["n", *summaries.METRICS]

    def rows(level: str, task: Column, fmt: Column, values: list[Column]) -> list[Column]:
        kinds = ["bigint", *["double"] * len(summaries.METRICS)]
        return [F.lit(level).alias("level"), task.alias("task"), fmt.alias("fmt"), *[v.cast(k).alias(m) for v, k, m in zip(values, kinds, measures)]]

    none = F.lit(None).cast("string")
    wide = files["task_fmt"]
    names = [c.removesuffix("_n") for c in wide.columns if c.endswith("_n")]
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("fmt"), *[F.col(f"`{f}_{m}`").alias(m) for m in measures]) for f in names]))
    tall = wide.select("task", cells.alias("c")).filter(F.col("c.n").isNotNull())
    found = tall.select(rows("task_fmt", F.col("task"), F.col("c.fmt"), [F.col(f"c.{m}") for m in measures]))
    found = found.unionByName(files["fmt"].select(rows("fmt", none, F.col("fmt"), [F.col(m) for m in measures])))
    found = found.unionByName(files["overall"].select(rows("overall", none, none, [F.col(m) for m in measures])))
    return _kept(found, folder)


def stored_external(spark, sf_dir):
    """Results merged by id, new ones winning, written in the order of the ids as numbers."""
    folder = _folder(spark, "external")
    documents = read(spark, sf_dir, "documents")
    old = documents.select(F.col("doc_id").cast("string").alias("id"), F.array("lang").alias("prediction_list"))
    new = documents.filter(F.col("doc_id") % 3 == 0).select(F.col("doc_id").cast("string").alias("id"), F.array("source").alias("prediction_list"))
    kind = "id STRING, prediction_list ARRAY<STRING>"
    results.write_external(old, folder)
    results.write_external(results.merge_external(results.read_external_results(spark, folder, kind), new), folder)
    found = results.read_external_results(spark, folder, kind)
    order = Window.partitionBy(F.input_file_name()).orderBy(F.monotonically_increasing_id())
    placed = found.withColumn("before", F.lag(F.col("id").cast("bigint")).over(order))
    return _kept(
        placed.select("id", F.col("prediction_list")[0].alias("prediction"), F.coalesce(F.col("before") < F.col("id").cast("bigint"), F.lit(True)).alias("in_order")), folder
    )


def external_records(spark, sf_dir):
    """Records of an outside set, one task of two, read after their contract holds, with their prompts."""
    folder = _folder(spark, "outside")
    documents = read(spark, sf_dir, "documents")
    word = F.substring("text", 1, 40)
    documents.select(
        F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.lit("wanted")).otherwise("other").alias("task_name"),
        F.col("lang").alias("sub_task_name"), F.lit("read {context} then answer {question}").alias("instruction"),
        F.array(F.concat(F.lit("who is "), "source")).alias("question_list"), F.array("source").alias("golden_answer_list"),
        F.struct(F.concat(F.lit("h"), word).alias("context_html"), F.concat(F.lit("l"), word).alias("context_latex"), F.concat(F.lit("m"), word).alias("context_markdown")).alias("context"),
    ).write.json(folder)
    records = results.read_external(spark, folder, "wanted", expected_rows=None)
    asked = prompts.external_prompts(records)
    return _kept(asked.select("id", "sub_task_name", "fmt", F.col("golden_answer_list")[0].alias("gold"), F.md5("prompt").alias("prompt_md5")), folder)


def _answering(answer: str):
    def make():
        return lambda batch: [answer] * len(batch)

    return make


def seeded_run(spark, sf_dir):
    """A run over urgent orders, and one over all orders that begins with the first one's rows and asks only for the rest."""
    folder = _folder(spark, "runs")
    source = order_tables(spark, sf_dir).withColumns({"question": F.lit("q"), "answers": F.array(F.lit("a"), F.lit("b"))})
    # stored by buckets of their ids, the tables are read by each step without an exchange
    name = f"seeded_tables_{uuid.uuid4().hex}"
    try:
        corpus.save_bucketed(source, name, int(spark.conf.get("spark.sql.shuffle.partitions")), path=f"{folder}/tables")
        tables = spark.table(name)
        urgent = read(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").cast("string").alias("table_id"))
        run_predictions(tables, ["tsv", "md"], _answering("first"), f"{folder}/out", "first", selected=urgent, max_tokens=0)
        found = run_predictions(tables, ["tsv", "md"], _answering("second"), f"{folder}/out", "second", seed_path=f"{folder}/out/run_id=first", max_tokens=0)
        return _kept(found.select("run_id", "table_id", "fmt", "gold", "answers", "pred", "raw"), folder)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def plugged_tokens(spark, sf_dir):
    """A tokenizer of one's own for counts and for offsets: runs of characters other than spaces."""

    def make_counter():
        return lambda texts: [len([w for w in t.split(" ") if w]) for t in texts]

    def make_tokenizer():
        import re

        return lambda texts: [[m.span() for m in re.finditer("[^ ]+", t)] for t in texts]

    documents = read(spark, sf_dir, "documents").select("doc_id", counted_tokens(F.col("text"), make_counter).alias("n_counted"), token_offsets(F.col("text"), make_tokenizer).alias("t"))
    return documents.select(
        "doc_id", "n_counted", F.size("t").alias("n_tokens"), F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a + t["end"] - t["start"]).alias("n_inside")
    )


def counted_prompts(spark, sf_dir):
    """Prompts of documents, many of them copies, through a tokenizer of one's own that sees each text once."""

    def make_tokenizer():
        import re

        return lambda texts: [[m.span() for m in re.finditer("[^ ]+", t)] for t in texts]

    asked = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Read this: "), F.col("text")).alias("prompt"))
    found = evaluate_distinct(asked, "prompt", lambda text: token_offsets(text, make_tokenizer), "offsets", copies="n_copies")
    inside = F.aggregate("offsets", F.lit(0).cast("long"), lambda a, t: a + t["end"] - t["start"])
    return found.select("doc_id", F.size("offsets").alias("n_tokens"), inside.alias("n_inside"), "n_copies")


def stream_summaries(spark, sf_dir):
    """Summaries kept up to date over three arrivals of verdicts; the third replaces some, which are subtracted."""
    folder = _folder(spark, "verdict-stream")
    final = verdicts(spark, sf_dir).withColumn("version", F.col("doc_id") % 2)
    third = F.col("doc_id") % 3
    early = final.filter(third != 2).withColumns({"content_correct": ~F.coalesce("content_correct", F.lit(False)), "fmt": F.when(third == 1, F.col("fmt")).otherwise(F.lit("draft"))})
    for arrival in (early, final.filter(third == 2), final.filter(third != 2)):
        arrival.write.mode("append").parquet(f"{folder}/in")
        stream = arriving(spark, f"{folder}/in", final.schema)
        incremental_summaries(stream, f"{folder}/out", f"{folder}/log", ["doc_id"], ["version"]).awaitTermination()
    return _kept(summaries_now(spark, f"{folder}/out", digits=None), folder)


def sql_formats(spark, sf_dir):
    """All twelve formats as SQL functions."""
    from tabprobe.functions.sql_functions import register_formats

    names = register_formats(spark)
    view = f"tables_{uuid.uuid4().hex}"
    order_tables(spark, sf_dir).createOrReplaceTempView(view)
    each = ", ".join(f"md5({name}(header, rows)) AS {name}" for name in names)
    return spark.sql(f"SELECT table_id, {each} FROM {view}")


QUERIES: dict[str, Query] = {
    "stored_tables": stored_tables,
    "stored_tasks": stored_tasks,
    "stored_selection": stored_selection,
    "stored_predictions": stored_predictions,
    "csv_predictions": csv_predictions,
    "judge_csv_runs": judge_csv_runs,
    "counted_prompts": counted_prompts,
    "hash_sample_half": hash_sample_half,
    "stored_verdicts": stored_verdicts,
    "stored_summaries": stored_summaries,
    "stored_external": stored_external,
    "external_records": external_records,
    "seeded_run": seeded_run,
    "sql_formats": sql_formats,
    "tables_from_rows": tables_from_rows,
    "truncate_tables": truncate_tables,
    "parse_tables": parse_tables,
    "canonical_tables": canonical_tables,
    "task_records": task_records,
    "cells": cells,
    "largest_tables": largest_tables,
    "first_tables": first_tables,
    "hash_sample_tables": hash_sample_tables,
    "number_tables": number_tables,
    **{f"fmt_{fmt}": format_query(fmt) for fmt in FORMATS},
    "serialise_long": serialise_long,
    "value_positions": value_positions_query,
    "unique_values": unique_values_query,
    "task_size_detection": task_query(customer_tables, ["size_detection"]),
    "task_cell_lookup": task_query(order_tables, ["cell_lookup"]),
    "task_reverse_lookup": task_query(order_tables, ["reverse_lookup"]),
    "task_row_col_retrieval": task_query(customer_tables, ["row_retrieval", "col_retrieval"]),
    "generate_tasks": generate_tasks_query,
    "generate_tasks_mt19937": generate_tasks_mt19937,
    "tasks_mt19937_checked": tasks_mt19937_checked,
    "prompts_zero_shot": prompts_zero_shot,
    "prompts_one_shot": prompts_one_shot,
    "prompts_questions": prompts_questions,
    "chat_render": chat_render,
    "template_fill": template_fill,
    "mcq_prompt": mcq_prompt,
    "judge_prompt_current": judge_prompt_query("current"),
    "judge_prompt_suc_v1": judge_prompt_query("suc_v1"),
    "prompt_budget": prompt_budget,
    "failing_instances": failing_instances,
    "mark_long_prompts": mark_long_prompts,
    "select_until_n": select_until_n,
    "order_by_id_list": order_by_id_list,
    "extract_scalar": extract_scalar_query,
    "extract_list": extract_list_query,
    "newline_escape": newline_escape,
    "parse_verdict": parse_verdict,
    "row_metrics": row_metrics,
    "metrics_by_task_fmt": metrics_by_task_fmt,
    "metrics_by_fmt": metrics_by_fmt,
    "metrics_overall": metrics_overall,
    "metrics_grouping_sets": metrics_grouping_sets,
    "metrics_pivot": metrics_pivot,
    "resume_pending": resume_pending,
    "resume_keep": resume_keep,
    "run_counts": run_counts,
    "merge_last_wins": merge_last_wins,
    "contract_checks": contract_checks,
    "missing_rows": missing_rows,
    "duplicate_ids": duplicate_ids,
    "score_batches": score_batches,
    "retry_failed": retry_failed,
    "judge_pending": judge_pending,
    "stream_score": stream_score,
    "stream_summaries": stream_summaries,
    "markup_html": markup_html,
    "markup_json_colsep": markup_json_colsep,
    "markup_spans": markup_spans_query,
    "token_overlap": token_overlap,
    "segment_overlap": segment_overlap,
    "plugged_tokens": plugged_tokens,
    "token_positions": token_positions,
    "random_positions": random_positions,
    "control_positions": control_positions,
    "control_resume": control_resume,
    "seeded_keys": seeded_keys,
}
