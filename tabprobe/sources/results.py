"""Reading and writing predictions, verdicts, summaries and external results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe import fixed_values as fixed
from tabprobe import schemas
from tabprobe.functions.text import escape_newlines, unescape_newlines
from tabprobe.operators import checks
from tabprobe.operators.resume import merge_latest
from tabprobe.operators.summary import formats_of, pivot_pairs, summarise_all
from tabprobe.session import ensure_checkpoints
from tabprobe.sources import versions
from tabprobe.sources.runs import CSV, read_runs

PREDICTION_COLUMNS = [
    "table_id", "task", "fmt", "question", "gold", "answers", "n_rows", "n_cols", "prompt",
    "prompt_tokens", "pred", "raw", "error", "patch_group", "patch_layer", "base_model", "quant_model",
    "patch_positions", "random_seed",
]
VERDICT_COLUMNS = [
    "table_id", "task", "fmt", "question", "gold", "target_field", "prediction_sent_to_judge",
    *fixed.VERDICT_FLAGS, "score", "reason", "raw_judge", *fixed.PASSTHROUGH_COLUMNS,
]


def exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(context._jsc.hadoopConfiguration()).exists(hadoop_path)


def require(spark: SparkSession, paths: Sequence[str]) -> None:
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError("Some prediction paths do not exist: " + ", ".join(missing))


def read_predictions(
    spark: SparkSession, paths: Sequence[str], run_ids: Sequence[str] | None = None
) -> DataFrame:
    """All prediction data sets, Parquet or CSV, in one frame; ``run_id`` tells the runs apart. ``runs.read_runs`` also gives the malformed records.

    Without ``run_ids`` the last path element names the run, without the ``run_id=`` of a partition folder.
    """
    require(spark, paths)
    return read_runs(spark, paths, run_ids)[0]


def read_predictions_csv(
    spark: SparkSession, path: str, schema: str = schemas.PREDICTIONS, unescape: bool = True
) -> DataFrame:
    """Interchange CSV with an explicit schema: empty and NA-like texts stay texts."""
    df = spark.read.options(**CSV).schema(schema).csv(path)
    return df.withColumn("raw", unescape_newlines(F.col("raw"))) if unescape else df


def write_predictions_csv(predictions: DataFrame, path: str) -> None:
    present = [c for c in PREDICTION_COLUMNS if c in predictions.columns]
    rows = predictions.select(*present).withColumn("raw", escape_newlines(F.col("raw")))
    rows.write.options(**CSV).option("emptyValue", '""').mode("overwrite").csv(path)


def append_predictions(
    predictions: DataFrame, path: str, run_id: str, partition_by: Sequence[str] = ("run_id", "fmt")
) -> None:
    """One committed append per job, instead of rewriting the whole file per batch."""
    present = [c for c in PREDICTION_COLUMNS if c in predictions.columns]
    predictions.select(*present, F.lit(run_id).alias("run_id")).write.mode("append").partitionBy(
        *partition_by
    ).parquet(path)


def verdict_rows(judged: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Verdict columns in order, with the pass-through columns that are present."""
    present = [c for c in VERDICT_COLUMNS if c in judged.columns]
    return judged.select(*present, *extra)


def append_verdicts(judged: DataFrame, path: str, extra: Sequence[str] = ()) -> None:
    verdict_rows(judged, extra).write.mode("append").parquet(path)


def write_summaries(
    verdicts: DataFrame,
    path: str,
    overwrite: bool = False,
    prefix: str | None = None,
    formats: Sequence[str] | None = None,
) -> dict[str, str]:
    """Three CSV summaries; nothing is done if all exist and ``overwrite`` is off."""
    spark = verdicts.sparkSession
    head = f"{prefix}_" if prefix and not prefix.endswith("_") else (prefix or "")
    outputs = {
        "task_fmt": f"{path}/{head}judge_accuracy_by_task_fmt",
        "fmt": f"{path}/{head}judge_accuracy_by_fmt",
        "overall": f"{path}/{head}judge_accuracy_overall",
    }
    if not overwrite and all(exists(spark, p) for p in outputs.values()):
        return outputs
    # one pass over the verdicts; its rows are as few as pairs of task and format
    ensure_checkpoints(spark)
    every = summarise_all(verdicts).checkpoint()
    pairs, by_fmt = every.filter("level = 'task_fmt'"), every.filter("level = 'fmt'")
    frames = {
        "task_fmt": pivot_pairs(pairs, formats_of(by_fmt) if formats is None else sorted(formats)).orderBy("task"),
        "fmt": by_fmt.drop("level", "task").orderBy("fmt"),
        "overall": every.filter("level = 'overall'").drop("level", "task", "fmt"),
    }
    for name, frame in frames.items():
        frame.coalesce(1).write.mode("overwrite").option("header", True).csv(outputs[name])
    return outputs


def read_external(
    spark: SparkSession,
    path: str,
    task: str = fixed.EXTERNAL_TASK,
    expected_rows: int | None = fixed.EXTERNAL_ROWS,
) -> DataFrame:
    """External benchmark records of one task, after the contract holds."""
    rows = spark.read.schema(schemas.EXTERNAL).json(path).filter(F.col("task_name") == task)
    checks.enforce(checks.check_contract(rows, "id", checks.external_rules()), expected_rows)
    return rows


def merge_external(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Results keyed by id, new ones win; numeric id order is applied when writing."""
    versions = new.withColumn("_version", F.lit(1))
    if existing is not None:
        versions = versions.unionByName(existing.withColumn("_version", F.lit(0)))
    return merge_latest(versions, ["id"], ["_version"]).drop("_version")


def write_external(results: DataFrame, path: str) -> None:
    """Replace the results below ``path``, sorted by integer id; until the new ones are complete, readers see the old ones."""
    versions.replace(results.orderBy(F.col("id").cast("bigint")), path, "json")


def read_external_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The current results below ``path``."""
    return versions.load(spark, path, schema, "json")
