"""Conversations to prompts in the bracket chat layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.functions.prompts import assistant_turn, user_turn, with_system
from tabprobe.operators.numbering import number_rows


def render_conversations(
    turns: DataFrame,
    conv: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    bos: str = "<s>",
    eos: str = "</s>",
    part_turns: int | None = None,
    renumber: bool = False,
) -> DataFrame:
    """(conv, part, prompt): the turns of a conversation, rendered and joined.

    A leading system message is folded into the next message; other system messages
    and unknown roles are left out. ``order`` must be an integer, unique within the
    conversation. A conversation is one prompt, part 0, unless ``part_turns`` is given: then
    parts hold the turns with the same ``order div part_turns``, and the prompt is its parts in order.

    ``renumber`` counts the turns first, for orders that are no integers, leave large gaps
    or repeat (copied turns are rendered as often as they occur).
    """
    if renumber:
        turns, order = number_rows(turns, [order, role, text], key=[conv], name="_turn"), "_turn"
    def part_of(number: Column) -> Column:
        return (F.lit(0).cast("long") if part_turns is None else F.floor(number / part_turns)).alias("part")

    part = part_of(F.col(order))
    # The two first turns of each conversation; row_number() <= 2 is cut before the shuffle.
    first_two = Window.partitionBy(conv).orderBy(order)
    heads = (
        turns.withColumn("_rn", F.row_number().over(first_two))
        .filter(F.col("_rn") <= 2)
        .groupBy(conv)
        .agg(
            F.max(F.when((F.col("_rn") == 1) & (F.col(role) == "system"), F.col(text))).alias("_system"),
            F.max(F.when(F.col("_rn") == 2, F.col(order))).alias("_second"),
        )
        .filter(F.col("_system").isNotNull() & F.col("_second").isNotNull())
        .select(conv, part_of(F.col("_second")), "_second", "_system")
    )
    parts = turns.groupBy(conv, part).agg(
        F.sort_array(
            F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("r"), F.col(text).alias("t")))
        ).alias("_turns")
    )

    def piece(turn: Column) -> Column:
        content = F.when(
            turn["o"] == F.col("_second"), with_system(F.col("_system"), turn["t"])
        ).otherwise(turn["t"])
        return F.when(turn["r"] == "user", user_turn(content, bos)).when(
            turn["r"] == "assistant", assistant_turn(content, eos)
        )

    return parts.join(heads, [conv, "part"], "left").select(
        conv, "part", F.array_join(F.transform("_turns", piece), "").alias("prompt")
    )
