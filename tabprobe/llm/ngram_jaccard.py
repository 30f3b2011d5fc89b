"""N-gram Jaccard join, light and heavy sets apart, and the components of its links.

Sets of word n-grams are linked when their Jaccard similarity reaches a threshold.

* Light sets, of few n-grams, meet in subsets: if the smaller of two linked sets has l n-grams, they share at least c(l) of them,
  so both list all subsets of c(l) n-grams under l. Any shared subset makes a candidate.
* Heavy sets scan inverted lists. N-grams are ordered from rare to common, and the first common n-gram of two linked sets
  stands near the front of both, so only front n-grams are listed, and a place in the list tells whether enough can follow.
* The boundary has the least cost: subsets to list, against list entries to write and scan, by the sizes found in the data.

Equal sets are one class from the start. So that big groups of near copies don't meet in all pairs, a first round links each class
to one partner per min-hash and joins what is verified into components; the exact round then drops every list whose
members are one component already, and otherwise pairs members of different components only. As long as lists hold many more such
pairs than entries, further rounds come first: in every list, one central member meets those of other components.
What they link shrinks the lists for all that follows. That loses no link between components, and the components are those of all links.

N-grams are compared by 64-bit hashes of their words. For classes of n n-grams, the chance that a verdict meets a collision is below
n * n / 2**64.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.llm.common import cut, giving_back, named, packed, remove, shared_path, short_batches, small, unpacked
from tabprobe.llm.graph import components

N_GRAM, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Min-hashes of the first round: it saves work; any number gives the same result.
MIN_HASHES = 6
#: Rounds of stars before the exact round, at most, and pairs of an entry that call for one: they save work; any numbers give the same result.
STAR_ROUNDS, STAR_PAIRS = 12, 4
#: Counters of the table that orders n-grams: its size is fixed, and only the order's quality depends on it.
COUNTER_BITS = 20
#: Largest set that may count as light.
LIGHT_MOST = 14
#: N-grams from which a set's top bytes are stored as steps.
STEPPED_FROM = 64
#: Bytes of text that are hashed in one go.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch that are unpacked in one go.
SLICE_ROWS = 500
#: Bits of the table that tells which lists still matter: its size is fixed, and only the amount shuffled depends on it.
OPEN_BITS = 26
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of lower-cased texts, and the number of words of each text."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    borders = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, borders), prepend=0)


def gram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams; a text of fewer words has one, all its words; without words, none."""
    words, counts = word_hashes(texts)
    factors = powers(np.uint64(0xD6E8FEB86659FD93), n)
    m = max(0, len(words) - n + 1)
    grams = np.zeros(m, np.uint64)
    for i in range(n):
        grams += words[i : i + m] * factors[i]
    grams = mix64(grams)
    out, start = [], 0
    for count in counts.tolist():
        if count >= n:
            out.append(np.unique(grams[start : start + count - n + 1]))
        elif count:
            tail = (words[start : start + count] * factors[:count]).sum(dtype=np.uint64) + np.uint64(count)
            out.append(mix64(mix64(np.array([tail]))))
        else:
            out.append(np.empty(0, np.uint64))
        start += count
    return out


def stored(grams: np.ndarray) -> bytes:
    """Sorted hashes as bytes. In longer sets the top bytes, which only rise, are a line of bits: a one per hash, a zero per step."""
    n = len(grams)
    if n < STEPPED_FROM:
        return b"\0" + grams.astype("<u8").tobytes()
    whole = grams.astype(">u8").view(np.uint8).reshape(n, 8)
    line = np.zeros(n + 256, np.uint8)
    line[whole[:, 0].astype(np.int64) + np.arange(n)] = 1
    return b"\1" + np.packbits(line).tobytes() + whole[:, 1:].tobytes()


def restored(data: bytes) -> np.ndarray:
    """The hashes that ``stored`` was given."""
    if data[0] == 0:
        return np.frombuffer(data, "<u8", offset=1).astype(np.uint64, copy=False)
    n = (8 * (len(data) - 1) - 256) // 57
    flat = np.frombuffer(data, np.uint8, offset=1)
    whole = np.empty((n, 8), np.uint8)
    whole[:, 0] = np.flatnonzero(np.unpackbits(flat[: -7 * n], count=n + 256)) - np.arange(n)
    whole[:, 1:] = flat[-7 * n :].reshape(n, 7)
    return whole.view(">u8").reshape(n).astype(np.uint64)


def overlap_needed(a, b):
    """Least common n-grams of linked sets of a and b n-grams: t / (1 + t) of their sum, rounded up."""
    return -(-(a + b) * NUMERATOR // (NUMERATOR + DENOMINATOR))


def light_levels(n: int) -> list[tuple[int, int]]:
    """(size of the smaller set, subset size) for which a light set of n n-grams lists its subsets."""
    return [(low, overlap_needed(low, low)) for low in range(-(-n * NUMERATOR // DENOMINATOR), n + 1)]


def light_cost(n: int) -> int:
    return sum(comb(n, c) for _, c in light_levels(n))


def best_boundary(sizes: dict[int, int], scanned: dict[int, float]) -> int:
    """Size up to which sets are light: least subsets to list plus list entries to write and scan.

    ``sizes``: sets by size, ``scanned``: entries that a heavy set of that size meets, on average. Light sets near the
    boundary are listed for their heavier partners too.
    """
    def cost(limit: int) -> float:
        light = sum(k * light_cost(n) for n, k in sizes.items() if n <= limit)
        listed = sum(k * (n - overlap_needed(n, -(-n * 4 // 5)) + 1 + scanned.get(n, 0.0)) for n, k in sizes.items() if 5 * n >= 4 * (limit + 1))
        return light + listed

    return min(range(LIGHT_MOST + 1), key=lambda limit: (cost(limit), limit))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


class GramTable:
    """Sets of n-grams by a unique number, in a table bucketed by that number, so that joins on it move only the other side.

    The table's files lie in the shared checkpoint folder, and go with the table.
    """

    def __init__(self, rows: DataFrame, n: int, buckets: int):
        self.spark, self.name = rows.sparkSession, f"gram_sets_{uuid.uuid4().hex}"
        self.folder = shared_path(self.spark, "gram-sets")
        id_type = rows.schema["id"].dataType.simpleString()
        schema = f"id {id_type}, text_hash long, n long, digest binary, grams binary, mins array<long>"
        salts = mix64(np.arange(1, MIN_HASHES + 1, dtype=np.uint64))

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for batch in slices(batches):
                texts = [t.encode().lower() if t else b"" for t in batch.column("text").to_pylist()]
                sets, at = [], 0
                while at < len(texts):
                    end, held = at, 0
                    while end < len(texts) and (end == at or held + len(texts[end]) <= CHUNK_BYTES):
                        held += len(texts[end])
                        end += 1
                    sets += gram_sets(texts[at:end], n)
                    at = end
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                grams, mins = [], []
                for s, d in zip(sets, digests):
                    first = d not in seen and len(s) > 0
                    if first and len(seen) < 2_000_000:
                        seen.add(d)
                    grams.append(stored(s) if first else None)
                    mins.append(mix64(s[None, :] ^ salts[:, None]).min(axis=1).view(np.int64).tolist() if first else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()), pa.array(grams, pa.binary()), pa.array(mins, pa.list_(pa.int64())),
                    ],
                    names=["id", "text_hash", "n", "digest", "grams", "mins"],
                )

        made = rows.mapInArrow(giving_back(build), schema).withColumn("tag", F.monotonically_increasing_id())
        try:
            made.write.bucketBy(buckets, "tag").saveAsTable(self.name, format="parquet", path=self.folder)
            self.rows = self.spark.table(self.name)
        except Exception:
            self.drop()
            raise

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.folder)


def verified(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """The pairs (u, v) of classes whose sets are similar enough."""
    sets = table.select(F.col("tag").alias("u"), F.col("grams").alias("gu"))
    others = table.select(F.col("tag").alias("v"), F.col("grams").alias("gv"))

    @F.arrow_udf("boolean")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(a), SLICE_ROWS):  # sets leave the batch's buffers a few at a time
            for x, y in zip(a.slice(at, SLICE_ROWS).to_pylist(), b.slice(at, SLICE_ROWS).to_pylist()):
                x, y = restored(x), restored(y)
                both = np.sort(np.concatenate((x, y)))
                common = int((both[1:] == both[:-1]).sum())
                out.append(DENOMINATOR * common >= NUMERATOR * (len(x) + len(y) - common))
        return pa.array(out, pa.bool_())

    return pairs.join(sets, "u").join(others, "v").where(similar("gu", "gv")).select("u", "v")


def gram_counters(classes: DataFrame) -> np.ndarray:
    """How often n-grams fall on each counter, over all classes; ready to be held by every task, being of fixed size."""
    blocks, width = 64, (1 << COUNTER_BITS) // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in slices(batches):
            every = np.concatenate([np.zeros(0, np.uint64), *map(restored, batch.column("grams").to_pylist())])
            total += np.bincount((every >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=1 << COUNTER_BITS).astype(np.uint32)
        # what a task counts beyond 65,535 changes nothing in the order
        parts = np.minimum(total, 65_535).astype(np.uint16).reshape(blocks, width)
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.uint16).astype(np.int64) for c in frame["counts"])
        return pd.DataFrame({"block": frame["block"].iloc[:1], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    kinds = "block int, counts binary"
    rows = classes.select("grams").mapInArrow(giving_back(count), kinds).groupBy("block").applyInPandas(add, kinds).collect()
    out = np.zeros((blocks, width), np.uint32)
    for row in rows:
        out[row["block"]] = np.frombuffer(row["counts"], np.uint32)
    return out.reshape(-1)


def open_places(keys: DataFrame) -> np.ndarray:
    """A table of bits in which those of all ``keys`` are set; ready to be held by every task, being of fixed size."""
    blocks, width = 64, (1 << OPEN_BITS) // 64

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << OPEN_BITS >> 3, np.uint8)
        for batch in batches:
            at = np.unique(place_of(batch.column("key").to_numpy()))
            byte = at >> 3
            first = np.flatnonzero(np.diff(byte, prepend=-1))
            if len(first):
                bits[byte[first]] |= np.add.reduceat(128 >> (at & 7), first).astype(np.uint8)
        parts = [(b, p) for b, p in enumerate(bits.reshape(blocks, width // 8)) if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([p.tobytes() for _, p in parts], pa.binary())], names=["block", "bits"])

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        every = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in frame["bits"]])
        return pd.DataFrame({"block": frame["block"].iloc[:1], "bits": [every.tobytes()]})

    kinds = "block int, bits binary"
    out = np.zeros((blocks, width // 8), np.uint8)
    for row in keys.mapInArrow(giving_back(mark), kinds).groupBy("block").applyInPandas(join, kinds).collect():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def place_of(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.astype(np.int64).view(np.uint64)) >> np.uint64(64 - OPEN_BITS)).astype(np.int64)


def ordered(grams: bytes, counters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set from rare to common, with the counters' values."""
    values = restored(grams)
    counts = counters[(values >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
    order = np.lexsort((values, counts))
    return values[order], counts[order]


def postings(classes: DataFrame, held: Broadcast, boundary: int) -> DataFrame:
    """List entries (key, tag, root, n, place) of classes (tag, root, n, grams); place -1 marks a subset of a light set.

    ``held``: the counters, and a table of bits or None; entries whose key has no bit there are left out.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, wanted = held.value
        for batch in slices(batches):
            keys, lengths, places = [], [], []
            for grams, n in zip(batch.column("grams").to_pylist(), batch.column("n").to_pylist()):
                values, _ = ordered(grams, counters)
                mine, place = [], []
                if n <= boundary:
                    for low, c in light_levels(n):
                        chosen = np.array(list(combinations(range(n), c)), np.int64).reshape(-1, c)
                        subset = mix64(values)[chosen].sum(axis=1, dtype=np.uint64) + np.uint64(low * 1000 + c)
                        mine.append(mix64(subset))
                        place.append(np.full(len(chosen), -1, np.int32))
                if 5 * n >= 4 * (boundary + 1):
                    front = n - overlap_needed(n, -(-n * NUMERATOR // DENOMINATOR)) + 1
                    mine.append(values[:front])
                    place.append(np.arange(front, dtype=np.int32))
                mine, place = np.concatenate(mine), np.concatenate(place)
                if wanted is not None:
                    at = place_of(mine.view(np.int64))
                    some = (wanted[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                    mine, place = mine[some], place[some]
                keys.append(mine)
                places.append(place)
                lengths.append(len(mine))
            if not keys:
                continue
            rows = np.repeat(np.arange(len(keys)), lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys).view(np.int64)), batch.column("tag").take(pa.array(rows)), batch.column("root").take(pa.array(rows)),
                    batch.column("n").take(pa.array(rows)).cast(pa.int32()), pa.array(np.concatenate(places)),
                ],
                names=["key", "tag", "root", "n", "place"],
            )

    return classes.select("tag", "root", "n", "grams").mapInArrow(giving_back(build), "key long, tag long, root long, n int, place int")


def boundary_of(classes: DataFrame, counters: np.ndarray) -> int:
    """The boundary by cost, from the number of small sets by size and the lists they would scan.

    A counter holds other n-grams as well, as many as the mean counter; so much is taken off.
    """
    mean = float(counters.mean())

    @F.arrow_udf("double")
    def scan(grams: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(grams), SLICE_ROWS):
            for g, k in zip(grams.slice(at, SLICE_ROWS).to_pylist(), n.slice(at, SLICE_ROWS).to_pylist()):
                counts, front = ordered(g, counters)[1], k - overlap_needed(k, -(-k * NUMERATOR // DENOMINATOR)) + 1
                out.append(float(counts[:front].astype(float).clip(mean).sum() - mean * front))
        return pa.array(out, pa.float64())

    found = classes.where(F.col("n") <= 2 * LIGHT_MOST).withColumn("s", scan("grams", "n")).groupBy("n").agg(F.count("*").alias("k"), F.avg("s").alias("s")).collect()
    return best_boundary({r["n"]: r["k"] for r in found}, {r["n"]: r["s"] for r in found})


def may_link(x: str, y: str, boundary: int) -> Column:
    """Whether sizes and places of two entries of a list leave it open that their sets are similar enough."""
    n, m, i, j = (F.col(f"{side}.{name}") for name in ("n", "place") for side in (x, y))
    needed = F.ceil((n + m).cast("long") * NUMERATOR / (NUMERATOR + DENOMINATOR))
    heavy = (i >= 0) & (j >= 0) & (F.greatest(n, m) > boundary) & (i + needed <= n) & (j + needed <= m)
    return (DENOMINATOR * F.least(n, m) >= NUMERATOR * F.greatest(n, m)) & (((i < 0) & (j < 0)) | heavy)


def joined_by_stars(entries: DataFrame, boundary: int, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links (u, v) of rounds of stars, and the entries that may still link two components, with the components' roots so far.

    The centre of a list's star is the member in which the fewest rarer n-grams stand in front of the list's own: of copies with a few changes each,
    the one that was changed least, to which most others are similar. Later rounds add a growing chance number to that rank. The centre
    meets the members of other components, so the pairs of a round are no more than the entries.
    """
    links = entries.select(F.col("tag").alias("u"), F.col("tag").alias("v")).limit(0)
    before = None
    for k in range(STAR_ROUNDS):
        chance = F.xxhash64("tag", F.lit(k))
        first = F.struct((F.col("place") + F.pmod(chance, F.lit(k + 1))).alias("rank"), chance.alias("chance"), "tag", "root", "n", "place")
        square = F.col("k").cast("double") * F.col("k")
        of_roots = entries.groupBy("key", "root").agg(F.count("*").alias("k"), F.min(first).alias("c"))
        lists = cut(of_roots.groupBy("key").agg(F.sum("k").alias("k"), F.sum(square).alias("own"), F.min("c").alias("c")).where(square > F.col("own")))
        all_of_them = lists.agg(F.sum("k").alias("entries"), (F.sum(square - F.col("own")) / 2).alias("pairs")).first()
        if not all_of_them["entries"] or all_of_them["pairs"] <= STAR_PAIRS * all_of_them["entries"] or (before and all_of_them["pairs"] > 0.95 * before):
            break
        before = all_of_them["pairs"]
        pairs = (
            entries.alias("x").join(lists.select("key", "c"), "key").where((F.col("x.root") != F.col("c.root")) & may_link("x", "c", boundary))
            .select(F.least("x.tag", "c.tag").alias("u"), F.greatest("x.tag", "c.tag").alias("v"), F.least("x.root", "c.root").alias("a"), F.greatest("x.root", "c.root").alias("b"))
            .distinct()
        )
        pairs = cut(pairs)
        found = cut(verified(pairs.select("u", "v"), table))
        if found.isEmpty():
            break
        links = links.union(found)
        roots = components(pairs.join(found, ["u", "v"], "left_semi").select(F.col("a").alias("u"), F.col("b").alias("v")))
        now = entries.join(roots.withColumnRenamed("node", "old").withColumnRenamed("root", "new"), F.col("root") == F.col("old"), "left")
        entries = cut(now.select("key", "tag", F.coalesce("new", "root").alias("root"), "n", "place"))
    return cut(links), entries


def link_edges(classes: DataFrame, table: DataFrame) -> DataFrame:
    """Verified links (u, v) between classes, enough to connect whatever any links connect."""
    # round one: a partner per min-hash
    mins = classes.select("tag", "n", F.posexplode("mins").alias("i", "value"))
    centre = mins.groupBy("i", "value").agg(F.min(F.struct("tag", "n")).alias("c"), F.count("*").alias("k")).where("k > 1")
    pairs = (
        mins.join(centre, ["i", "value"])
        .where((F.col("tag") != F.col("c.tag")) & (DENOMINATOR * F.least("n", "c.n") >= NUMERATOR * F.greatest("n", "c.n")))
        .select(F.col("c.tag").alias("u"), F.col("tag").alias("v")).distinct()
    )
    first = cut(verified(pairs, table))
    roots = cut(components(first))
    # round two: whatever may still link two components
    rooted = classes.join(roots.withColumnRenamed("node", "tag"), "tag", "left").withColumn("root", F.coalesce("root", "tag"))
    counters = gram_counters(classes)
    boundary = boundary_of(classes, counters)
    context = classes.sparkSession.sparkContext
    held = context.broadcast((counters, None))
    open_keys = cut(postings(rooted, held, boundary).groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key"))
    held.destroy()
    held = context.broadcast((counters, open_places(open_keys)))
    some = cut(postings(rooted, held, boundary).join(small(open_keys, open_keys.count()), "key"))
    held.destroy()
    links, some = joined_by_stars(some, boundary, table)
    x, y = some.alias("x"), some.alias("y")
    candidates = (
        x.join(y, F.col("x.key") == F.col("y.key"))
        .where(F.col("x.root") < F.col("y.root"))
        .where(may_link("x", "y", boundary))
        .select(F.col("x.tag").alias("u"), F.col("y.tag").alias("v")).distinct()
    )
    return cut(first.union(links).union(verified(candidates, table)))


def by_components(table: DataFrame) -> DataFrame:
    """What ``jaccard_components`` returns, from the table of sets."""
    by_set = cut(
        table.groupBy("digest").agg(
            F.min(F.when(F.col("grams").isNotNull(), F.col("tag"))).alias("tag"), F.min(F.struct(F.col("id").isNull().alias("no"), "id", F.col("tag"))).alias("first"),
            F.count("*").alias("copies"), F.first("n").alias("n"),
        )
    )
    chosen = by_set.where("n > 0").select("tag")
    classes = table.where(F.col("grams").isNotNull()).join(chosen, "tag", "left_semi").select("tag", "n", "mins", "grams")
    roots = components(link_edges(classes, table))
    rooted = by_set.where("n > 0").join(roots.withColumnRenamed("node", "tag"), "tag", "left").withColumn("root", F.coalesce("root", "tag"))
    groups = rooted.groupBy("root").agg(F.min("first").alias("best"), F.sum("copies").alias("size"))
    found = cut(rooted.select("digest", "root").join(groups, "root").select("digest", "best", "size"))
    return cut(
        table.select("id", "text_hash", "n", "digest", "tag").join(found, "digest", "left").select(
            "id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("best.id")).otherwise(F.col("id")).alias("component_id"),
            F.coalesce("size", F.lit(1)).alias("component_size"), F.coalesce(F.col("best.tag") == F.col("tag"), F.lit(True)).alias("stays"),
        )
    )


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = N_GRAM, buckets: int = 32) -> DataFrame:
    """Components of documents whose n-gram sets have a Jaccard similarity of at least 0.8.

    Words are runs without ASCII white space, with A-Z lower-cased. Returns one row per input row: ``id``, ``text_hash``, ``n_shingles``,
    ``component_id`` (smallest id in the component), ``component_size`` (rows) and ``stays`` (true for one row of each component, the one with
    its smallest id). Texts without words, null ones included, have empty sets and are linked with nothing, not with each other. Rows that
    repeat an id or a whole row are documents of their own. Null ids rank last; a component of null ids has a null ``component_id``. An
    empty table gives an empty table. ``buckets``: files by which a temporary table of sets is dealt; raise it with the input.
    """
    rows = df.select(named(id_col).alias("id"), F.xxhash64(named(text_col)).alias("text_hash"), named(text_col).alias("text"))
    with short_batches(df.sparkSession):
        made = GramTable(rows, n, buckets)
        try:
            return by_components(made.rows)
        finally:
            made.drop()


def keep_representatives(docs: DataFrame, **how) -> DataFrame:
    """One document of each component, the one with the smallest id, with the columns it came with."""
    found = jaccard_components(docs, **how)
    # a row's text is found again by its id and hash; only where rows repeat both, and not all of them stay, are rows ranked
    keys = cut(found.groupBy("id", "text_hash").agg(F.count("*").alias("rows"), F.count_if("stays").alias("stay")).where("stay > 0"))
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash"))
    whole = rows.join(keys.where("rows = stay").select("id", "text_hash"), same, "left_semi").select("row")
    place = F.row_number().over(Window.partitionBy("id", "text_hash").orderBy("own_hash"))
    some = rows.join(keys.where("rows > stay"), same).withColumn("place", place).where("place <= stay").select("row")
    return whole.unionByName(some).select(*unpacked("row", docs.columns, []))
