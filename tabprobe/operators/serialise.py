"""Tables to texts and to (table, task, format) instances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe import fixed_values as fixed
from tabprobe.functions.formats import FORMATS, SUMMED_TOKENS, format_table
from tabprobe.functions.text import let, token_count
from tabprobe.operators.tasks import generate_tasks


def _texts(formats: Sequence[str], measure: bool = False, wanted: Column | None = None) -> Column:
    """Array of (fmt, table_text[, text_tokens]); formats that are not wanted stay NULL."""
    header, rows = F.col("header"), F.col("rows")

    def text(fmt: str) -> Column:
        built = format_table(fmt, header, rows)
        return built if wanted is None else F.when(F.array_contains(wanted, fmt), built)

    texts = F.array(
        *[F.struct(F.lit(f).alias("fmt"), text(f).alias("table_text")) for f in formats]
    )
    if not measure:
        return texts
    if not set(formats) & set(SUMMED_TOKENS):
        return F.transform(texts, lambda s: s.withField("text_tokens", token_count(s["table_text"])))
    # Cells are counted once for all formats that only put marks and header names between them.
    whole = F.forall("rows", lambda r: (F.size(r) == F.size(header)) & F.forall(r, lambda v: v.isNotNull()))
    regular = (F.size(header) > 0) & (F.size("rows") > 0) & whole & F.forall(header, lambda v: v.isNotNull())
    counts = F.struct(
        F.when(regular, token_count(F.array_join(header, "\t"))).alias("names"),
        F.when(regular, token_count(F.array_join(F.flatten(rows), "\t"))).alias("cells"),
        F.size("rows").alias("n"), F.size(header).alias("k"),
    )

    return let(counts, lambda m: F.transform(texts, lambda s: s.withField("text_tokens", _tokens_of(s, m, formats))))


def _tokens_of(s: Column, m: Column, formats: Sequence[str]) -> Column:
    summed = None
    for fmt in formats:
        if fmt in SUMMED_TOKENS:
            known = s["table_text"].isNotNull() & m["cells"].isNotNull() & (s["fmt"] == fmt)
            total = SUMMED_TOKENS[fmt](m["names"], m["n"], m["k"]) + m["cells"]
            summed = F.when(known, total) if summed is None else summed.when(known, total)
    return summed.otherwise(token_count(s["table_text"]))


PACK = 64


def _text_columns(measure: bool) -> list[str]:
    return ["s.fmt", "s.table_text", *(["s.text_tokens"] if measure else [])]


def _each_text(texts: Column | str) -> Column:
    # The array always has one element per format. A plain explode would add a filter
    # on its size, and that filter builds every text a second time.
    return F.explode_outer(texts).alias("s")


def serialise_tables(tables: DataFrame, formats: Sequence[str] = tuple(FORMATS)) -> DataFrame:
    """(table_id, fmt, table_text): every text is built once; map-only."""
    return tables.select("table_id", _each_text(_texts(formats))).select(
        "table_id", "s.fmt", "s.table_text"
    )


def plan_instances(tasks: DataFrame, formats: Sequence[str]) -> DataFrame:
    """Tasks times formats without any text: what a run wants, in slim rows."""
    return tasks.withColumn("fmt", F.explode(F.array(*[F.lit(f) for f in formats])))


def build_instances(
    tasks: DataFrame,
    tables: DataFrame,
    formats: Sequence[str],
    measure: bool = True,
) -> DataFrame:
    """Tasks x formats with the table text; tasks of unknown tables drop out.

    ``tasks`` (with task_seq) may already be planned instances, with ``fmt``; then only
    those are built. The tasks of a table are packed, at most 64 numbers to a row, and
    joined to the raw tables; texts are made after that, once per pack and format. So no
    text is ever shuffled or sorted. A table with very many packs is left to the adaptive
    skew join; bucketed tables and tasks join without an exchange. ``measure`` adds
    ``text_tokens``, the built-in token count, once per text, and ``question_tokens``, once
    per task.
    """
    planned = "fmt" in tasks.columns
    columns = list(tasks.columns)
    # With the input partition in the group, a pack stays bounded whatever is repeated.
    packs = (
        tasks.withColumns(
            {"_part": F.floor(F.col("task_seq") / PACK), "_source": F.spark_partition_id()}
        )
        .groupBy("table_id", "_part", "_source")
        .agg(F.collect_list(F.struct(*[c for c in columns if c != "table_id"])).alias("_wanted"))
        .select("table_id", "_wanted")
    )
    raw = tables.select("table_id", F.col("header"), F.col("rows"))
    joined = packs.join(raw, "table_id")
    texts = _texts(formats, measure, F.col("_wanted.fmt") if planned else None)
    each = joined.select("table_id", "_wanted", texts.alias("_texts")).select(
        "table_id", F.explode_outer("_wanted").alias("w"), "_texts"
    )
    if measure:
        each = each.withColumn("question_tokens", token_count(F.col("w.question")))
    if planned:
        matching = F.filter("_texts", lambda s: s["fmt"] == F.col("w.fmt"))
        each = each.withColumn("s", F.get(matching, F.lit(0)))
    else:
        each = each.select(*[c for c in each.columns if c != "_texts"], _each_text("_texts"))
    kept = ["table_id" if c == "table_id" else f"w.{c}" for c in columns if c != "fmt"]
    return each.select(*kept, *_text_columns(measure), *(["question_tokens"] if measure else []))


def generate_instances(
    tables: DataFrame, formats: Sequence[str], measure: bool = True, **task_options
) -> DataFrame:
    """Tasks of the tables times formats, straight from the table rows: no join, no shuffle.

    ``measure`` as in ``build_instances``, ``task_options`` as in ``tasks.generate_tasks``.
    """
    with_texts = tables.withColumn("_texts", _texts(formats, measure))
    tasks = generate_tasks(with_texts, keep=["_texts"], **task_options)
    if measure:
        tasks = tasks.withColumn("question_tokens", token_count(F.col("question")))
    columns = [c for c in tasks.columns if c != "_texts"]
    return tasks.select(*columns, _each_text("_texts")).select(*columns, *_text_columns(measure))


def _question_columns() -> list[Column]:
    return [
        F.col("table_id"),
        F.lit(0).alias("task_seq"),
        F.lit(fixed.QA_TASK).alias("task"),
        F.col("question"),
        F.array_join("answers", "\n").alias("gold"),
        F.col("answers"),
        F.size("rows").alias("n_rows"),
        F.size("header").alias("n_cols"),
    ]


def question_tasks(tables: DataFrame) -> DataFrame:
    """The tables' own questions in the form of tasks, several answers joined as gold."""
    return tables.select(*_question_columns())


def question_instances(
    tables: DataFrame, formats: Sequence[str], measure: bool = True
) -> DataFrame:
    """One instance per table and format for the tables' own questions; map-only."""
    each = tables.select(*_question_columns(), _each_text(_texts(formats, measure)))
    return each.select(*each.columns[:-1], *_text_columns(measure))


def encode_answers(df: DataFrame) -> DataFrame:
    """List answers as JSON text, for flat files."""
    return df.withColumn("answers", F.to_json("answers"))
