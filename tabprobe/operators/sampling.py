"""Exact seeded samples of tables."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.operators.ingest import limit_of
from tabprobe.operators.numbering import number_rows


#: The first three digits of a digest part the ids evenly into 4,096 buckets, whatever the ids are.
_DIGITS = 3


def _smallest_digests(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """(table_id, draw) of the n smallest md5(seed:id), for any n.

    Counts per bucket of digests, at most 4,096 rows, tell at which draw a bucket begins. Buckets that begin after the n-th draw are left out
    by a broadcast of the others, and each one kept is ranked by itself: no sort of all ids and no task that sees them all. Where ids
    repeat, every row is drawn on its own.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("table_id")))
    digests = ids.select("table_id", digest.alias("_h")).withColumn("_bucket", F.substring("_h", 1, _DIGITS))
    # one row per bucket, not per id
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = digests.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    begins = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin")).filter(F.col("_begin") < n)
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", "table_id")) - 1
    ranked = digests.join(F.broadcast(begins), "_bucket").withColumn("draw", (F.col("_begin") + place).cast("int"))
    return ranked.filter(F.col("draw") < n).select("table_id", "draw")


def sample_tables(
    tables: DataFrame, n: int | None, seed: int = 42, sampler: str = "hash"
) -> DataFrame:
    """Exactly ``min(n, population)`` tables, with ``draw`` as the order of drawing.

    ``hash`` takes the n smallest md5(seed:id), see ``_smallest_digests``. ``mt19937`` draws the positions with the standard library's
    generator from the corpus order, for samples that must equal an earlier run; its n draws are a list on the driver.
    """
    if limit_of(n) is None:
        return tables.withColumn("draw", F.lit(None).cast("int"))
    if sampler == "hash":
        return tables.join(_smallest_digests(tables.select("table_id"), n, seed), "table_id")
    if sampler != "mt19937":
        raise ValueError(f"Unknown sampler: {sampler}")
    dense = number_rows(tables, ["pos"], name="_dense")
    population = dense.count()
    if n >= population:
        return dense.withColumn("draw", F.col("_dense").cast("int")).drop("_dense")
    draws = list(enumerate(random.Random(seed).sample(range(population), n)))
    picked = tables.sparkSession.createDataFrame(draws, "draw INT, _dense BIGINT")
    return dense.join(picked, "_dense").drop("_dense")
