"""Scoring prediction files as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabprobe.operators.resume import merge_latest
from tabprobe.operators.summary import METRICS, row_metrics
from tabprobe.sources.results import exists


def arriving(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """A folder as a stream: each file is read once, also when it comes late."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def incremental_score(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
) -> StreamingQuery:
    """Process all files that are new, then stop.

    ``transform`` is any batch plan, such as ``plans.jobs.judge`` with its judge. The
    stream's checkpoint replaces the set of finished keys. Each batch owns one
    partition and overwrites it, so a batch that is repeated after a failure leaves no
    duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(output)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _owned(df: DataFrame, batch_id: int, path: str) -> None:
    """Write a batch's rows into the partition that it owns; repeating the batch replaces them."""
    df.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch_id").parquet(path)


def _shares(verdicts: DataFrame, sign: int) -> DataFrame:
    """What each verdict adds to the sums (or, with -1, takes from them)."""
    parts = [F.lit(sign).cast("bigint").alias("n")]
    for m in METRICS:
        parts += [(sign * F.coalesce(F.col(m), F.lit(0.0))).alias(f"{m}_sum"), (sign * F.col(m).isNotNull().cast("bigint")).alias(f"{m}_n")]
    return row_metrics(verdicts).select("task", "fmt", *parts)


_SUMS = ["n", *[f"{m}_{part}" for m in METRICS for part in ("sum", "n")]]


def incremental_summaries(stream: DataFrame, output: str, checkpoint: str, key: Sequence[str], version: Sequence[str]) -> StreamingQuery:
    """Keep sums of verdicts by task and format up to date, batch by batch, then stop.

    Below ``output``: ``verdicts`` (what each batch brought, its latest per key by ``version``) and ``sums`` (what each batch changed: counts and sums per task
    and format). A verdict for a key that an earlier batch had takes that one's share back. Every batch owns one partition of both and looks only at
    earlier batches, so a repeated batch changes nothing. ``summaries_now`` merges the sums; verdicts are never read again for it.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        new = merge_latest(batch, key, version).persist()
        folder = f"{output}/verdicts"
        changes = _shares(new, 1)
        if exists(spark, folder):
            kind = T.StructType([*batch.schema.fields, T.StructField("batch_id", T.LongType())])
            earlier = spark.read.schema(kind).parquet(folder).filter(F.col("batch_id") < batch_id)
            again = earlier.join(new.select(*key), list(key), "left_semi")
            changes = changes.unionByName(_shares(merge_latest(again, key, ["batch_id"]), -1))
        _owned(changes.groupBy("task", "fmt").agg(*[F.sum(c).alias(c) for c in _SUMS]), batch_id, f"{output}/sums")
        _owned(new, batch_id, folder)
        new.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summaries_now(spark: SparkSession, output: str, digits: int | None = 4) -> DataFrame:
    """Summaries by (task, fmt), by fmt and overall from the batches' sums, as ``summary.summarise_all`` gives them."""
    sums = spark.read.parquet(f"{output}/sums")
    level = F.when(F.grouping_id() == 0, "task_fmt").when(F.grouping_id() == 2, "fmt").otherwise("overall")
    merged = sums.groupingSets([["task", "fmt"], ["fmt"], []], "task", "fmt").agg(level.alias("level"), *[F.sum(c).alias(c) for c in _SUMS])
    means = [F.when(F.col(f"{m}_n") > 0, F.col(f"{m}_sum") / F.col(f"{m}_n")).alias(m) for m in METRICS]
    rounded = means if digits is None else [F.bround(c, digits).alias(m) for c, m in zip(means, METRICS)]
    # groups all of whose verdicts have moved elsewhere are no groups any more
    return merged.filter((F.col("n") > 0) | (F.col("level") == "overall")).select("level", "task", "fmt", "n", *rounded)
