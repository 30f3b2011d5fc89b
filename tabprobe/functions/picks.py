"""Seeded choice without replacement inside one row, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabprobe.functions.text import let


def ranked(seed: int, table_id: Column, kind: str, items: Column) -> Column:
    """``items`` (integers) in the order of md5(seed:table:kind:item), ties by item."""
    def rank(prefix: Column) -> Column:
        digests = F.transform(
            items,
            lambda i: F.struct(F.md5(F.concat(prefix, i.cast("string"))).alias("h"), i.alias("i")),
        )
        return F.transform(F.sort_array(digests), lambda x: x["i"])

    return let(F.concat(F.lit(f"{seed}:"), table_id, F.lit(f":{kind}:")), rank)


def pick(seed: int, table_id: Column, kind: str, items: Column, k: int) -> Column:
    """The first ``k`` of ``ranked``; all of them if there are fewer.

    Bare digests are sorted, and the items of the few chosen ones looked up: no struct per item is made, copied and compared.
    """
    def hashed(prefix: Column) -> Column:
        return F.transform(items, lambda i: F.md5(F.concat(prefix, i.cast("string"))))

    def chosen(digests: Column) -> Column:
        first = F.slice(F.sort_array(digests), 1, k)
        return F.transform(first, lambda h: F.get(items, F.array_position(digests, h).cast("int") - 1))

    return let(let(F.concat(F.lit(f"{seed}:"), table_id, F.lit(f":{kind}:")), hashed), chosen)


def indexes(n: Column) -> Column:
    """0 .. n-1, empty for 0 (a bare sequence would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
