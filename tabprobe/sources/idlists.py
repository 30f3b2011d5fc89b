"""Lists of ids as one JSON document of any length, read and written in parts."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabprobe.operators.numbering import number_rows, source_order

_SPLIT = ["_file", "_block"]
#: The rest of the document behind the opening of the wanted list: a bare list, or the value of a key, whose quotes are no part of a text.
_OPENING = r'^\s*(?:\[|\{?\s*"%s"\s*:\s*\[)'
#: One value at the start of a piece: a text, or anything without marks.
_VALUE = r'^\s*("(?:[^"\\]++|\\.)*+"|[^\s"\[\]{}]++)'
_TEXTS = r'"(?:[^"\\]++|\\.)*+"'


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(_ord, piece): the document cut at the commas outside its texts, numbered; at the borders of files, too.

    Spark reads byte ranges and cuts them at every comma. Whether a piece begins inside a text hangs on the quotes before it: within a
    range a running sum tells, and one row per range, summed in order, tells with what each range begins. No row holds more than
    one piece, and the document is moved once.
    """
    raw = source_order(spark.read.option("lineSep", ",").text(path))
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    odd = (F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))) % 2
    marked = raw.withColumns({"_seq": F.monotonically_increasing_id(), "_odd": odd})
    order = Window.partitionBy(*_SPLIT).orderBy("_seq")
    inside = F.coalesce(F.sum("_odd").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    local = marked.withColumn("_inside", inside)
    # a piece starts where the state is "outside"; blank ones, between files, are none
    filled = F.regexp_like("value", F.lit(r"\S"))
    per_split = local.groupBy(*_SPLIT).agg(
        (F.sum("_odd") % 2).alias("_flip"), F.count_if(filled & (F.col("_inside") == 0)).alias("_n0"), F.count_if(filled & (F.col("_inside") == 1)).alias("_n1")
    )
    # one row per byte range
    before = Window.orderBy(*_SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    states = per_split.withColumn("_state", F.coalesce(F.sum("_flip").over(before), F.lit(0)) % 2)
    starts = F.when(F.col("_state") == 0, F.col("_n0")).otherwise(F.col("_n1"))
    states = states.select(*_SPLIT, "_state", F.coalesce(F.sum(starts).over(before), F.lit(0)).alias("_before"))
    placed = local.join(F.broadcast(states), _SPLIT).withColumn("_first", (F.col("_inside") + F.col("_state")) % 2 == 0)
    upto = F.sum(F.when(F.col("_first") & filled, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = placed.withColumn("_ord", F.col("_before") + upto - 1).filter(filled | ~F.col("_first"))
    # a text that holds commas comes in several rows: only those are gathered
    joined = F.sort_array(F.collect_list(F.struct(*_SPLIT, "_seq", "value")))
    return numbered.groupBy("_ord").agg(F.array_join(F.transform(joined, lambda p: p["value"]), ",").alias("piece"))


def read_ids(spark: SparkSession, path: str, key: str = "table_ids") -> DataFrame:
    """(ord, table_id) from {"table_ids": [...]} or from a bare list, a file or a folder of parts of one document.

    The list may be longer than a row or a task can hold, on one line or on many, with commas, quotes and line ends in its ids. A null keeps its
    place; an empty list has no rows, and so has a document without the key. The key counts where it first stands, at whatever depth; the list holds no lists.
    Parts are cut between two ids, never inside one.
    """
    pieces = _pieces(spark, path)
    opening = _OPENING % key
    opens = F.regexp_like("piece", F.lit(opening)) & ((F.col("_ord") == 0) | ~F.regexp_like("piece", F.lit(r"^\s*\[")))
    first = pieces.filter(opens).agg(F.min("_ord")).scalar()
    inner = pieces.filter(F.col("_ord") >= first)
    closes = F.regexp_replace("piece", _TEXTS, "").contains("]")
    last = inner.filter(closes).agg(F.min("_ord")).scalar()
    rest = F.when(F.col("_ord") == first, F.regexp_replace("piece", opening, "")).otherwise(F.col("piece"))
    listed = inner.filter(F.col("_ord") <= last).select((F.col("_ord") - first).cast("int").alias("ord"), F.regexp_extract(rest, _VALUE, 1).alias("value"))
    text = F.get(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "ARRAY<STRING>"), F.lit(0))
    return listed.filter(F.col("value") != "").select("ord", text.alias("table_id"))


def write_ids(ids: DataFrame, path: str, fields: Mapping[str, object], count: str, key: str = "table_ids") -> None:
    """(pos, table_id) in that order as one JSON object: ``fields``, the number of ids as ``count``, and the list, an id to a line.

    The parts are text files; in the order of their names they make up the document, which has one part where the list is short.
    Every line is made from its row alone, so no task holds the list.
    """
    numbered = number_rows(ids.select("pos", "table_id"), ["pos", "table_id"], name="_ord")
    n = ids.agg(F.count(F.lit(1))).scalar()
    begun = json.dumps(dict(fields), ensure_ascii=False)[1:-1]
    head = F.concat(F.lit("{" + begun + (", " if begun else "") + json.dumps(count) + ": "), n.cast("string"), F.lit(f', {json.dumps(key)}: ['))
    value = F.coalesce(F.regexp_extract(F.to_json(F.array("table_id")), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    line = F.concat(F.when(F.col("_ord") == 0, head).otherwise(F.lit(",")), value, F.when(F.col("_ord") == n - 1, F.lit("]}")).otherwise(F.lit("")))
    empty = ids.sparkSession.range(1).filter(n == 0).select(F.lit(0).cast("long").alias("_ord"), F.concat(head, F.lit("]}")).alias("value"))
    lines = numbered.select("_ord", line.alias("value")).unionByName(empty)
    lines.orderBy("_ord").select("value").write.mode("overwrite").text(path)
