"""Spelling variants: words one edit apart, found by asymmetric chunks, and the form each rare word is a variant of.

One edit leaves at least one of two disjoint chunks of a word as it is. So of two near words the shorter one (of equally long ones,
either) contributes its two halves, the other its positional grams of the same lengths, and the two are joined where a chunk
equals a gram at the same place or one further on; the distance is verified after that.

What lies outside a kept chunk must be within one edit as well. A chunk that many words share is therefore not joined: the same step is taken again
on the rest of its words, whose two halves become chunks beside the first one, until few words share them or the rest is a single letter.
Words that then still meet differ in that letter alone, so a group holds no more words than there are letters (one more place: their
square). No key brings together a number of words that grows with the corpus, and no pair is lost.

In a row, ``[lo, lo + n)`` is the stretch of the word that the edit must lie in, after which the key is named: all that lies
outside it, and the length of the shorter word's stretch. A row on the chunk side has such a stretch itself; on the gram side it is as
long (a replaced letter) or one longer (an inserted one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import cut, lower_ascii, named, whole_text

#: Fixed value: a run of these letters is a word.
RUN = "[A-Za-zÀ-ÿ]+"
#: Words a key may hold on its two sides together before its chunks are cut again.
CROWD = 40


def words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = 6, min_count: int = 5, noise: int = 199) -> DataFrame:
    """Distinct words and their occurrences (word, n) in all texts; A-Z count as a-z.

    Where ``noise`` divides the crc32 of ``<id>:<lower-cased run>``, one letter is missing: the one at crc32 modulo the length. A null id is
    written as nothing. Null texts have no words; repeated rows count as often as they occur. Aggregated before the shuffle.
    """
    runs = df.select(
        F.coalesce(named(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower_ascii(whole_text(named(text_col))), F.lit(RUN), F.lit(0))).alias("run"),
    )
    # a run that is too short stays so
    runs = runs.where(F.length("run") >= min_length)
    mark = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    place = (F.col("mark") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    word = F.when(F.col("mark") % noise == 0, shorter).otherwise(F.col("run"))
    counted = runs.select("run", mark.alias("mark")).select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") >= min_count) & (F.length("word") >= min_length))


def _key(word: Column, lo: Column, n: Column, shorter: Column) -> Column:
    """The letters before and after the stretch, their border, and the length of the shorter word's stretch."""
    return F.xxhash64(F.substring(word, F.lit(1), lo), F.substring(word, lo + n + 1, F.length(word)), lo, shorter)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row's stretch cut in two: once the first half is kept as a chunk or gram, once the second.

    ``more`` is how much longer the stretch is than the shorter word's; a kept second half then stands one place further on.
    """
    short = F.col("n") - F.col("more")
    first, second = (short / 2).cast("int"), short - (short / 2).cast("int")
    parts = F.array(
        F.struct((F.col("lo") + first).alias("lo"), (second + F.col("more")).alias("n")),
        F.struct(F.col("lo").alias("lo"), (first + F.col("more")).alias("n")),
    )
    return rows.select("word", "more", "chunk", F.explode(parts).alias("part")).select("word", "more", "chunk", "part.lo", "part.n")


def near_pairs(vocabulary: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of distinct words that differ by exactly one replaced, inserted or deleted code point, each pair once, a being the shorter word
    or the smaller of equally long ones. ``vocabulary`` needs distinct words in ``word``; empty words are near to single letters only.
    """
    length = F.length("word")
    # a word offers its chunks once, and its grams for words as long and for words one shorter
    sides = F.array(*[F.struct(F.lit(more).alias("more"), F.lit(chunk).alias("chunk")) for more, chunk in ((0, True), (0, False), (1, False))])
    rows = vocabulary.select("word", F.explode(sides).alias("side")).select("word", "side.*").where(length >= F.col("more"))
    rows = _halves(rows.withColumns({"lo": F.lit(0), "n": length}))
    found = None
    while True:
        rows = cut(rows.withColumn("key", _key(F.col("word"), F.col("lo"), F.col("n"), F.col("n") - F.col("more"))))
        sizes = rows.groupBy("key").agg(F.count_if("chunk").alias("chunks"), F.count_if(~F.col("chunk")).alias("grams"), F.max(F.col("n") - F.col("more")).alias("short"))
        # a single letter cannot be cut again
        sizes = cut(sizes.where((F.col("chunks") > 0) & (F.col("grams") > 1)).withColumn("crowded", (F.col("chunks") + F.col("grams") > crowd) & (F.col("short") > 1)))
        quiet = sizes.where(~F.col("crowded")).select("key")
        chunks, grams = (rows.where(F.col("chunk") == side).select("key", F.col("word").alias(name)) for side, name in ((True, "a"), (False, "b")))
        met = chunks.join(quiet, "key").join(grams, "key")
        met = met.where((F.length("a") < F.length("b")) | (F.col("a") < F.col("b")))
        near = met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b")
        found = near if found is None else found.unionByName(near)
        crowded = sizes.where("crowded").select("key")
        if crowded.isEmpty():
            break
        rows = _halves(rows.join(crowded, "key").drop("key"))
    # an inserted letter between two halves, or next to its like, is found from both sides
    return found.distinct()


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = 6, min_count: int = 5, noise: int = 199, factor: int = 5, crowd: int = CROWD) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    The form is the near word with the largest n (ties: smallest in code-point order) if that is at least ``factor`` times the word's own;
    the root is where following forms ends. Words without a form are their own root, with nulls in form and form_n. An empty table gives no rows.
    """
    vocabulary = cut(words(df, id_col, text_col, min_length=min_length, min_count=min_count, noise=noise))
    pairs = near_pairs(vocabulary.select("word"), crowd=crowd)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.*")
    best = both.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best")
    )
    rows = vocabulary.join(best, "word", "left")
    has = -F.col("best.minus") >= factor * F.col("n")
    rows = cut(rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.minus")).alias("form_n"),
    ))
    # Every step multiplies n by the factor, so chains are short; each round doubles what has been followed.
    steps = rows.where("form IS NOT NULL").select("word", F.col("form").alias("at"))
    while True:
        onward = steps.select(F.col("word").alias("at"), F.col("at").alias("next"))
        moved = cut(steps.join(onward, "at", "left").select("word", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("moved")))
        steps = moved.select("word", "at")
        if moved.where("moved").isEmpty():
            break
    roots = steps.select("word", F.col("at").alias("root"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
