"""Markup sizes, markup tokens and budget-matched random controls."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe import fixed_values as fixed
from tabprobe.functions import markup as M
from tabprobe.functions.text import let, pipe_key

SEGMENT = 64
ABSENT = "the prompt does not hold the table's text"


def markup_sizes(texts: DataFrame, fmt: str, text: str = "table_text") -> DataFrame:
    """Add n_chars and n_markup_chars; built-in functions only."""
    column = F.col(text)
    return texts.withColumns(
        {"n_chars": F.length(column), "n_markup_chars": M.markup_length(column, fmt)}
    )


def explode_spans(df: DataFrame, key: Sequence[str], spans: str, index: str | None = None) -> DataFrame:
    """Array of spans to rows (key, [index,] start, end)."""
    # Outer, then without the empty ones: a plain explode would first filter on the
    # array's size, and compute the spans once more for it.
    if index is None:
        rows = df.select(*key, F.explode_outer(spans).alias("s"))
    else:
        rows = df.select(*key, F.posexplode_outer(spans).alias(index, "s"))
    return rows.filter(F.col("s").isNotNull()).select(
        *[c for c in rows.columns if c != "s"], F.col("s.start").alias("start"), F.col("s.end").alias("end")
    )


def overlapping_tokens(
    tokens: DataFrame, spans: DataFrame, key: Sequence[str], segment: int = SEGMENT, dealt: bool = False
) -> DataFrame:
    """Tokens that touch at least one span of the same text.

    Both sides are cut into segments of the character axis (of at most 64 characters), and the join is on
    (key, segment): a very long text is spread over many groups. The spans of a segment become one word of 64 bits, a bit per
    covered character, before they are exchanged; a token meets that one word. Words are the side that is hashed, one slim row per segment whatever
    the number of spans, so the tokens are neither sorted nor spilled. A token within one segment is judged where it stands and travels once; only
    those that cross a border are tried in several, exchanged again and reported once.

    ``dealt``: both sides are dealt by the key already, with no more of a text to a task than that task may sort. A join would exchange them all the same, as it
    asks for rows dealt by all of (key, segment); so tokens and words are stacked and grouped, which leaves rows where they are. The result is the same.
    """
    width = min(segment, 64)
    first, last = F.floor(F.col("start") / width).cast("int"), F.floor((F.col("end") - 1) / width).cast("int")

    def bits(side: str = "") -> Column:
        start, end, at = F.col(f"{side}start"), F.col(f"{side}end"), F.col(f"{side}_segment") * width
        low, high = F.greatest(start - at, F.lit(0)).cast("int"), F.least(end - at, F.lit(width)).cast("int")
        return F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), 64 - (high - low)), low)

    def pieces(df: DataFrame) -> DataFrame:
        return df.withColumn("_segment", F.explode(F.sequence(first, last)))

    drawn = pieces(spans.filter(F.col("end") > F.col("start"))).withColumn("_bits", bits())
    if dealt:
        return _grouped_tokens(tokens, drawn, pieces, key, width)
    words = drawn.groupBy(*key, "_segment").agg(F.bit_or("_bits").alias("_covered")).hint("shuffle_hash").alias("m")
    known = tokens.filter(F.col("end") > F.col("start"))

    def touching(side: DataFrame) -> DataFrame:
        condition = [F.col(f"t.{c}") == F.col(f"m.{c}") for c in [*key, "_segment"]]
        # the token's bits are made behind the exchange
        condition.append(bits("t.").bitwiseAND(F.col("m._covered")) != 0)
        return side.alias("t").join(words, condition, "left_semi")

    own = [F.col(c) for c in tokens.columns]
    inside = touching(known.filter(first == last).withColumn("_segment", first)).dropDuplicates([*tokens.columns, "_segment"])
    across = touching(pieces(known.filter(first < last))).select(*own).distinct()
    return inside.select(*own).unionByName(across)


def _grouped_tokens(tokens: DataFrame, drawn: DataFrame, pieces: Callable[[DataFrame], DataFrame], key: Sequence[str], width: int) -> DataFrame:
    """``overlapping_tokens`` without an exchange of sides that are dealt by the key."""
    group = [*key, "_segment"]
    rest = F.struct(*[c for c in tokens.columns if c not in key])
    # as for equality, a null key is no key
    words = drawn.dropna(subset=list(key)).groupBy(*group).agg(F.bit_or("_bits").alias("_covered"))
    asked = pieces(tokens.dropna(subset=list(key)).filter(F.col("end") > F.col("start"))).select(*group, rest.alias("_token"))
    met = asked.unionByName(words, allowMissingColumns=True).groupBy(*group).agg(F.collect_list("_token").alias("_tokens"), F.max("_covered").alias("_covered"))

    def touches(token: Column) -> Column:
        at = F.col("_segment") * width
        low, high = F.greatest(token["start"] - at, F.lit(0)).cast("int"), F.least(token["end"] - at, F.lit(width)).cast("int")
        own = F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), 64 - (high - low)), low)
        return own.bitwiseAND(F.col("_covered")) != 0

    found = met.filter(F.col("_covered").isNotNull()).select(*key, F.explode_outer(F.filter("_tokens", touches)).alias("_token")).filter(F.col("_token").isNotNull())
    # a token that crosses a border is found in several segments
    return found.select(*[F.col(c) if c in key else F.col("_token")[c].alias(c) for c in tokens.columns]).distinct()


#: Kept for callers of the sweep by stretches.
STRETCH = 1 << 16


def swept_tokens(
    located: DataFrame, key: Sequence[str], tokens: str = "tokens", spans: str = "spans", stretch: int = STRETCH
) -> DataFrame:
    """Tokens (key, token_idx, start, end) that touch at least one span of the same row, each once.

    ``located`` holds arrays of tokens and spans per row, rows having different keys. The spans of a row, sorted, are laid out as a line of one byte per
    character, 1 where a span covers it; a token touches a span exactly if its stretch of the line holds a 1. So the row answers for itself, in proportion
    to its length: only the tokens found leave it, with no join, no sort of tokens, and no exchange where the rows are dealt by their key already.

    ``stretch`` was the length of the pieces that long texts were swept in; nothing is left to be cut, and it changes nothing.
    """
    kept = F.sort_array(F.filter(F.col(spans), lambda s: s["end"] > s["start"]))

    def disjoint(sorted_spans: Column) -> Column:
        """Spans without what earlier ones cover; looked for only where some overlap."""

        def reached(i: Column) -> Column:
            return F.array_max(F.transform(F.slice(sorted_spans, F.lit(1), i), lambda s: s["end"]))

        def rest(s: Column, i: Column) -> Column:
            start = F.greatest(s["start"], F.when(i > 0, reached(i)))
            return F.struct(start.alias("start"), F.greatest(start, s["end"]).alias("end"))

        overlap = F.exists(
            F.transform(sorted_spans, lambda s, i: s["start"] < F.get(sorted_spans, i - 1)["end"]), lambda x: F.coalesce(x, F.lit(False))
        )
        plain = F.transform(sorted_spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.when(overlap, F.transform(sorted_spans, rest)).otherwise(plain)

    def line(parts: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            gap = s["start"] - F.coalesce(F.get(parts, i - 1)["end"], F.lit(0))
            return F.concat(F.repeat(F.lit("0"), gap), F.repeat(F.lit("1"), s["end"] - s["start"]))

        return F.array_join(F.transform(parts, piece), "").cast("binary")

    def found(covered: Column) -> Column:
        def touches(t: Column) -> Column:
            own = F.substring(covered, t["start"] + 1, t["end"] - t["start"])
            return (t["end"] > t["start"]) & F.contains(own, F.lit(b"1"))

        numbered = F.transform(F.col(tokens), lambda t, i: F.struct(i.alias("index"), t["start"].alias("start"), t["end"].alias("end")))
        return F.filter(numbered, touches)

    touched = let(let(let(kept, disjoint), line), found)
    rows = located.select(*key, F.explode_outer(touched).alias("e")).filter(F.col("e").isNotNull())
    return rows.select(*key, F.col("e.index").alias("token_idx"), F.col("e.start").alias("start"), F.col("e.end").alias("end"))


def markup_budgets(touched: DataFrame, key: Sequence[str]) -> DataFrame:
    """Number of markup tokens per text: the size of a matching random control."""
    return touched.groupBy(*key).agg(F.count(F.lit(1)).alias("n_markup_tokens"))


def control_jobs(
    instances: DataFrame,
    groups: Sequence[str] = (fixed.FORMAT_GROUP, fixed.RANDOM_GROUP),
    masks: int = fixed.RANDOM_MASKS,
    seed: int = 42,
    keep: Callable[[Column], Column] = lambda jobs: jobs,
) -> DataFrame:
    """Every instance once per control: the markup one, and one per random mask.

    ``random_seed`` is NULL for the markup control. ``keep`` may leave jobs (g, s) out of a row's list; ``pending_controls`` leaves out
    finished ones. Instances without jobs go.
    """
    known = {
        fixed.FORMAT_GROUP: F.array(
            F.struct(F.lit(fixed.FORMAT_GROUP).alias("g"), F.lit(None).cast("int").alias("s"))
        ),
        fixed.RANDOM_GROUP: F.transform(
            F.sequence(F.lit(seed), F.lit(seed + masks - 1)),
            lambda s: F.struct(F.lit(fixed.RANDOM_GROUP).alias("g"), s.cast("int").alias("s")),
        ),
    }
    jobs = keep(F.concat(*[known[g] for g in groups]))
    return instances.withColumn("_job", F.explode(jobs)).withColumns(
        {"patch_group": F.col("_job.g"), "random_seed": F.col("_job.s")}
    ).drop("_job")


#: Seeds whose state one word of a control mark holds.
WORD_SEEDS = 62


def control_marks(done: DataFrame, key: Sequence[str] = tuple(fixed.INSTANCE_KEY), seed: int = 42) -> DataFrame:
    """One row per instance with finished controls: its key as texts (``_part0``, ...) and ``marks``, a map from group and word to a bitmap of finished seeds.

    The markup control, whose seed is NULL, has a word of its own. Bitmaps are put together map-side, so repeated rows cost nothing, and
    the result has one slim row per instance, whatever the number of masks. Seeds below ``seed`` are of another grid and ignored.
    Rows that are dealt by some of the key's columns already stay where they are.
    """
    offset = F.col("random_seed") - seed
    word = F.when(F.col("random_seed").isNull(), F.lit(-1)).otherwise(F.floor(offset / WORD_SEEDS).cast("int"))
    bit = F.when(F.col("random_seed").isNull(), F.lit(0)).otherwise(offset % WORD_SEEDS).cast("int")
    parts = [f"_part{i}" for i in range(len(key))]
    marked = done.filter(F.col("random_seed").isNull() | (offset >= 0)).select(
        *[F.col(c).cast("string").alias(p) for c, p in zip(key, parts)], "patch_group", word.alias("_word"), bit.alias("_bit")
    )
    words = marked.groupBy(*parts, "patch_group", "_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    named = F.struct(F.concat_ws(":", "patch_group", F.col("_word").cast("string")), F.col("_bits")).alias("_named")
    return words.select(*parts, named).groupBy(*parts).agg(F.map_from_entries(F.collect_list("_named")).alias("marks"))


def _with_marks(instances: DataFrame, marks: DataFrame, key: Sequence[str]) -> DataFrame:
    """``instances`` with the marks of their keys, null-safe; instances of one key, as a rule one, are held together in a row.

    Both sides are stacked and grouped instead of joined: a join asks for rows dealt by all columns of the key, grouping is content with some of them. So
    what is dealt by its table already, as tables and all that is made of them are, meets where it is.
    """
    parts = [f"_part{i}" for i in range(len(key))]
    # a key column that is text comes back from the group, and with it how the rows are dealt
    texts = {c: p for c, p in zip(key, parts) if isinstance(instances.schema[c].dataType, T.StringType)}
    rest = [c for c in instances.columns if c not in texts]
    own = F.struct(F.lit(True).alias("_is"), *[F.col(c) for c in rest])
    asked = instances.select(*[F.col(c).cast("string").alias(p) for c, p in zip(key, parts)], own.alias("_own"))
    met = asked.unionByName(marks, allowMissingColumns=True).groupBy(*parts).agg(F.collect_list("_own").alias("_owns"), F.any_value("marks", F.lit(True)).alias("marks"))
    # outer, then without the empty ones: see explode_spans
    each = met.select(*parts, F.explode_outer("_owns").alias("_own"), "marks").filter(F.col("_own").isNotNull())
    return each.select(*[F.col(texts[c]).alias(c) if c in texts else F.col("_own")[c].alias(c) for c in instances.columns], "marks")


def pending_controls(
    instances: DataFrame,
    done: DataFrame,
    groups: Sequence[str] = (fixed.FORMAT_GROUP, fixed.RANDOM_GROUP),
    masks: int = fixed.RANDOM_MASKS,
    seed: int = 42,
    key: Sequence[str] = tuple(fixed.INSTANCE_KEY),
) -> DataFrame:
    """``control_jobs`` without those that ``done`` (key, patch_group, random_seed) has: the instances meet it once, before they are multiplied.

    What is finished is subtracted within the row, bit by bit. A row of ``done`` with an ``error`` is not finished.
    """
    if "error" in done.columns:
        done = done.filter(F.col("error").isNull())
    marks = control_marks(done, key, seed)
    known = _with_marks(instances, marks, key)

    def open_jobs(jobs: Column) -> Column:
        def unfinished(job: Column) -> Column:
            offset = job["s"] - seed
            word = F.when(job["s"].isNull(), F.lit(-1)).otherwise(F.floor(offset / WORD_SEEDS).cast("int"))
            bit = F.when(job["s"].isNull(), F.lit(0)).otherwise(offset % WORD_SEEDS).cast("int")
            bits = F.element_at(F.col("marks"), F.concat_ws(":", job["g"], word.cast("string")))
            return F.coalesce(F.getbit(bits, bit), F.lit(0)) == 0

        return F.filter(jobs, unfinished)

    return control_jobs(known, groups, masks, seed, open_jobs).drop("marks")


def random_positions(n: Column, count: Column, seed: Column, key: Column) -> Column:
    """Sorted positions: ``min(count, n)`` of 0 .. n-1, every choice as likely as any other, seeded per instance.

    Only as many numbers are drawn as positions are wanted. For each of the last ``count`` places p in turn, a place up to p
    is drawn by sha256(seed:key:p); if it is taken already, p itself is. A set per row tells what is taken, so the work is in proportion to ``count``.
    """

    @F.arrow_udf("array<int>")
    def draw(lengths: pa.Array, counts: pa.Array, seeds: pa.Array, keys: pa.Array) -> pa.Array:
        out = []
        for length, wanted, seed, key in zip(lengths.to_pylist(), counts.to_pylist(), seeds.to_pylist(), keys.to_pylist()):
            if length is None or wanted is None or seed is None or key is None:
                out.append(None)
                continue
            prefix, taken = hashlib.sha256(f"{seed}:{key}:".encode()), set()
            for p in range(length - max(min(wanted, length), 0), length):
                digest = prefix.copy()
                digest.update(b"%d" % p)
                place = int.from_bytes(digest.digest()[:6]) % (p + 1)
                taken.add(p if place in taken else place)
            out.append(sorted(taken))
        return pa.array(out, pa.list_(pa.int32()))

    return draw(n.cast("int"), count.cast("int"), seed.cast("long"), key)


def instance_key() -> Column:
    return pipe_key(*[F.col(c) for c in fixed.INSTANCE_KEY])


def control_positions(
    prompts: DataFrame,
    fmt: str,
    jobs: Callable[[DataFrame], DataFrame] = control_jobs,
    make_tokenizer: Callable[[], Callable] | None = None,
) -> DataFrame:
    """Token positions of the markup and of its random controls, per prompt and job.

    Tokens and their overlap with the markup are found once per prompt, before the jobs
    multiply the rows.
    """
    start = F.instr(F.col("prompt"), F.col("table_text")) - 1
    located = prompts.select(
        *fixed.INSTANCE_KEY,
        M.markup_tokens(
            F.col("prompt"), start, F.length("table_text"), fmt, make_tokenizer
        ).alias("_found"),
    )
    slim = located.select(
        *fixed.INSTANCE_KEY,
        F.col("_found.positions").alias("_marked"),
        F.col("_found.n_tokens").alias("_length"),
        F.when(F.col("_found.positions").isNull(), F.lit(ABSENT)).alias("error"),
    )
    expanded = jobs(slim)
    drawn = random_positions(
        F.col("_length"), F.size("_marked"), F.coalesce("random_seed", F.lit(0)), instance_key()
    )
    positions = F.when(F.col("patch_group") == fixed.FORMAT_GROUP, F.col("_marked")).when(
        F.col("_marked").isNotNull(), drawn
    )
    return expanded.withColumn("positions", positions).select(
        *fixed.INSTANCE_KEY, "patch_group", "random_seed", "positions",
        F.size("positions").alias("patch_positions"), "error",
    )
