"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, minus the log of a hashed uniform number over its quality weight; in the
order of the keys, documents form a weighted sample without replacement. Each source has a budget of
words: complete epochs take all of its documents, and the rest of the budget
is filled from the smallest key on, down to the word.

No source is ever sorted in one task. Keys fall into buckets that keep their order, as many as the source has documents for;
sums per bucket, a few numbers, show in which bucket a budget ends, and only that bucket's documents are
sorted. The outcome is one threshold per source, so that documents are marked without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.llm.common import cut, named, packed, small, unpacked, whole_text, word_count

OWN = ["size", "source_size", "target", "taken", "copies"]
#: Documents per bucket, about.
BUCKET_DOCS = 2_000


def exponential_key(doc_id: Column, quality: Column, seed: int) -> Column:
    """-ln(u) / quality, with u in (0, 1) from the id. Lower keys come first; a quality that is null or not positive counts as 1."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.when(quality > 0, quality.cast("double")).otherwise(1.0)


def source_targets(sources: DataFrame, share: float, cycle: list[float], most: float) -> DataFrame:
    """Targets by weight: sources (source, docs, source_size) in code point order, null last, weigh ``cycle`` repeating.

    A target stops at ``most`` times its source's size; what is over goes to the others by weight, until none is above. That
    is a common level per unit of weight. It is found by raising it while any source stops: every round is an aggregate of a few numbers.
    """
    place = F.monotonically_increasing_id()
    ordered = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ordered = cut(ordered.withColumn("place", place))
    parts = ordered.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, starts = 0, {}
    for row in parts:  # one row per partition of a table of sources
        starts[row["part"]], before = before, before + row["n"]
    start = F.lit(0)
    for part, n in starts.items():
        start = F.when(F.shiftright("place", 33) == part, n).otherwise(start)
    rank = start + F.col("place").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (rank % len(cycle) + 1).cast("int"))
    weighed = ordered.withColumn("weight", weight)
    total = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    cap = F.col("source_size") * most
    level, stopped = 0.0, -1
    while True:
        over = cap <= F.col("weight") * level
        row = weighed.agg(
            F.sum(F.when(over, cap).otherwise(0.0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(over.cast("long")).alias("stopped"),
        ).first()
        if not row["open"] or row["stopped"] == stopped:
            break
        level, stopped = (total - row["full"]) / row["open"], row["stopped"]
    target = F.least(cap.cast("double"), F.col("weight") * level) if row["open"] else cap.cast("double")
    return weighed.select("source", "docs", "source_size", "weight", target.alias("target"))


def bucket(key: Column, docs: Column) -> Column:
    """Order-keeping bucket of a key: 1 - exp(-key) is uniform for quality 1, and close to it for others."""
    n = F.greatest(F.ceil(docs / BUCKET_DOCS), F.lit(1))
    return F.least(F.floor((1 - F.exp(-F.col("key"))) * n), n - 1).cast("long")


def mix(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, source_col: str = "source", quality_col: str | None = None,
    share: float = 1.5, cycle: tuple[float, ...] = (3.0, 1.0, 2.0), most: float = 2.0, seed: int = 42, carry: list[str] | None = None,
) -> DataFrame:
    """Say how many words of each document the mix takes.

    Adds ``size`` (words; null text: 0), ``source_size``, ``target`` (its source's), ``taken`` (words, repeats counted) and
    ``copies`` (whole repeats nearest to it); they replace input columns of the same name. Taken words of a source come to its
    target but for less than a word per document at the threshold. A null source is a source of its own. Documents without words
    take none, and are copied as their place among the keys says. Rows that tie in key and id share what is left evenly, so
    repeated rows have equal results and reruns agree. An empty table gives an empty table. Rows whose words are counted already
    (``size_col``) are slim, and are kept in the shared folder instead of being computed again.
    """
    carry = df.columns if carry is None else carry
    rows = df.select(
        packed(df, carry).alias("row"), named(id_col).alias("id"), named(source_col).alias("source"),
        (word_count(whole_text(named(text_col))) if size_col is None else named(size_col)).alias("size"),
        exponential_key(named(id_col), F.lit(None).cast("double") if quality_col is None else named(quality_col), seed).alias("key"),
    )
    if size_col is not None:
        rows = slim = cut(rows)
    else:
        slim = cut(rows.select("id", "source", "size", "key"))
    sources = cut(slim.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")))
    n_sources = sources.count()
    targets = source_targets(sources, share, list(cycle), most)
    targets = cut(
        targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
        .withColumn("name", F.coalesce("source", F.lit(""))).withColumn("missing", F.col("source").isNull()).drop("source")
    )
    budgets = small(targets, n_sources)
    keyed = slim.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("missing", F.col("source").isNull())
    dealt = keyed.join(budgets.select("name", "missing", "docs", "rest"), ["name", "missing"]).withColumn("bucket", bucket(F.col("key"), F.col("docs")))
    sums = dealt.groupBy("name", "missing", "bucket", "rest").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("name", "missing").orderBy("bucket"))
    # the bucket in which the budget ends, and the words before it
    ends = sums.withColumn("before", running - F.col("words")).where("before <= rest AND before + words > rest")
    ends = ends.select("name", "missing", "bucket", "before")
    within = Window.partitionBy("name", "missing").orderBy("key", "id")
    ties = dealt.join(small(ends, n_sources), ["name", "missing", "bucket"])
    ties = ties.groupBy("name", "missing", "key", "id", "rest", "before").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    last = (
        ties.withColumn("start", F.col("before") + F.sum("words").over(within) - F.col("words"))
        .where("start <= rest AND start + words > rest")
        .select("name", "missing", F.col("key").alias("end_key"), F.col("id").alias("end_id"), F.floor((F.col("rest") - F.col("start")) / F.col("n")).alias("part"))
    )
    plan = cut(targets.join(last, ["name", "missing"], "left"))
    marked = (
        rows.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("missing", F.col("source").isNull())
        .join(small(plan, n_sources), ["name", "missing"])
    )
    key_before = (F.col("key") < F.col("end_key")) | ((F.col("key") == F.col("end_key")) & (F.col("id") < F.col("end_id")))
    at_end = (F.col("key") == F.col("end_key")) & F.col("id").eqNullSafe(F.col("end_id"))
    none_left, all_left = F.col("rest") <= 0, F.col("end_key").isNull()
    extra = F.when(none_left, 0).when(all_left | key_before, F.col("size")).when(at_end, F.col("part")).otherwise(0)
    whole = F.when(none_left, 0).when(all_left | key_before, 1).when(at_end & (F.col("size") == 0), 1).otherwise(0)
    taken = (F.col("epochs") * F.col("size") + extra).cast("long")
    copies = F.when(F.col("size") > 0, F.floor(taken / F.col("size") + 0.5)).otherwise(F.col("epochs") + whole).cast("int")
    return marked.select(*unpacked("row", carry, OWN), "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"))


def sized(docs: DataFrame, labels: DataFrame, good: float = 2.0, poor: float = 0.5) -> DataFrame:
    """(doc_id, text_hash, source, size, quality) of documents, without their texts.

    The quality weight comes from labels: ``good`` for 1, ``poor`` for 0, 1 without a label; the best of several labels counts.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", word_count(whole_text(F.col("text"))).alias("size"))
    best = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("best"))
    weight = F.when(F.col("best") > 0, good).when(F.col("best") <= 0, poor).otherwise(1.0)
    return rows.join(best, "doc_id", "left").select("doc_id", "text_hash", "source", "size", weight.alias("quality"))


def mixed(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken whole, with the columns it came with."""
    def key(id_col, text_hash):
        return F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("null")), text_hash.cast("string")).alias("key")

    marked = mix(sized(docs, labels), size_col="size", quality_col="quality", carry=["doc_id", "text_hash"], **how)
    copies = marked.groupBy(key(F.col("doc_id"), F.col("text_hash"))).agg(F.max("copies").alias("copies")).where("copies > 0")
    rows = docs.select(packed(docs).alias("row"), key(F.col("doc_id"), F.xxhash64("text")))
    repeated = rows.join(copies, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*unpacked("row", docs.columns, []))
