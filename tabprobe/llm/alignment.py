"""Cross-tokenizer alignment: which tokens of two tokenizers meet, and in how many documents.

Both tokenizers cut the same bytes. Where tokens of both end, a group ends; an A token and a B token are linked where their
byte ranges overlap. Since both sequences cover the bytes without gaps, every stretch between two neighbouring ends, of
either kind, is exactly one link.

0. Every text is encoded once; its ids, packed and compressed, are kept in the shared checkpoint folder for the passes.
1. First pass: each task aligns its documents and keeps, per different id pair, in how many of them it is linked; sorted
   pairs and counts leave the task dealt by A id.
2. Per shard of A ids, a minimal perfect hash over the distinct pairs. A shard's pairs are bounded by its A ids times the
   size of B's vocabulary, whatever the corpus.
3. The tasks' counts become dense vectors indexed by that hash, which are summed as a tree of bounded fan-in. Keys in hash
   order stay beside the counts, so that a lookup can verify what it found; each A id's highest count is taken within its shard.
4. Second pass: documents are aligned again and look their pairs up in a table of bounded size that every task holds.
   More pairs than that are looked up slice by slice of A ids, each in a pass of its own; the results add up.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import cut, named, packed, unpacked, whole_text
from tabprobe.llm.perfect_hash import PerfectHash, mixed
from tabprobe.llm.vocabularies import ByteLevel, Pieces

OWN = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
SHARDS = 128
#: Vectors summed by one task of the tree.
FAN = 32
#: Pairs of one slice of the lookup table: 16 bytes each for key and count, about 64 MB.
SLICE_PAIRS = 4_000_000
#: Characters encoded at a time, ids aligned at a time, and pairs that a task gathers before it lets go of them.
BATCH_CHARS, BATCH_IDS, HELD_PAIRS = 1_000_000, 1_000_000, 4_000_000
#: How a document's ids are compressed.
CODEC = "zstd"
CODED = "n_a long, n_b long, ids binary"


class Aligned:
    """The links of a batch of texts as flat arrays: stretches in text order, ``docs[i]`` to ``docs[i + 1]`` being text i's."""

    def __init__(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        ends_a, ends_b = np.cumsum(a_lengths[a]), np.cumsum(b_lengths[b])
        ends = np.zeros(int(ends_a[-1]) + 1 if len(a) else 1, np.int8)
        ends[ends_a] = 1
        ends[ends_b] += 2
        at = np.flatnonzero(ends)
        self.kind = ends[at]
        is_a, is_b = (self.kind & 1).astype(np.int64), (self.kind >> 1).astype(np.int64)
        self.to_a, self.to_b = np.cumsum(is_a), np.cumsum(is_b)
        self.link_a, self.link_b = a[self.to_a - is_a], b[self.to_b - is_b]
        last = np.concatenate([[0], ends_a])[np.cumsum(n_a)]
        self.docs = np.concatenate([[0], np.searchsorted(at, last, side="right")])
        self.both = self.kind == 3

    def n_links(self) -> np.ndarray:
        return np.diff(self.docs)

    def n_groups(self) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(self.both)])[self.docs])

    def group_texts(self, names: np.ndarray, width: int) -> list[bytes]:
        """Per text ``a1,a2|b1;...``. ``names`` holds, at id + width * (0, 1, 2), the id's decimals and a comma, bar or semicolon."""
        a_till, b_till = self.to_a[self.both], self.to_b[self.both]  # tokens up to each group's end
        before = np.cumsum(self.both) - self.both
        a_at, b_at = (self.kind & 1) == 1, self.kind >= 2
        a_place = np.arange(len(self.a)) + np.concatenate([[0], b_till])[before[a_at]]
        b_place = np.arange(len(self.b)) + a_till[before[b_at]]
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[a_place] = self.a + width * self.both[a_at]
        codes[b_place] = self.b + 2 * width * self.both[b_at]
        parts, stops = names[codes], np.cumsum(self.n_a + self.n_b)
        return [b"".join(parts[s:e].tolist())[:-1] for s, e in zip([0, *stops.tolist()], stops.tolist())]


class Aligner:
    """Both tokenizers of one Python worker."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path, plain_specials=True), Pieces(b_path)
        self.width = max(len(self.a.token_bytes), len(self.b.token_bytes))
        self.names = np.array([f"{i}{end}".encode() for end in ",|;" for i in range(self.width)], object)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Per text the number of A's and of B's ids, and these ids, packed; none for texts that not both tokenizers spell byte by byte."""
        a, n_a, good_a = self.a.encode([" " + t if t else "" for t in texts])
        b, n_b, good_b = self.b.encode(texts)
        good = good_a & good_b & np.array([bool(t) for t in texts], bool)
        a, b = a.tobytes(), b.tobytes()
        a_stops, b_stops = np.cumsum(n_a * self.a.kind.itemsize).tolist(), np.cumsum(n_b * self.b.kind.itemsize).tolist()
        bounds = zip([0, *a_stops], a_stops, [0, *b_stops], b_stops, good.tolist())
        ids = [pa.compress(a[sa:ea] + b[sb:eb], codec=CODEC, asbytes=True) if fine else b"" for sa, ea, sb, eb, fine in bounds]
        return n_a * good, n_b * good, ids

    def align(self, n_a: np.ndarray, n_b: np.ndarray, ids: list[bytes]) -> tuple[Aligned, np.ndarray]:
        """The links of encoded texts that have ids, and which texts those are."""
        good = n_a > 0
        size_a, size_b = self.a.kind.itemsize, self.b.kind.itemsize
        a, b = [], []
        for x, n, m in zip(ids, n_a.tolist(), n_b.tolist()):
            if n:
                whole = pa.decompress(x, decompressed_size=n * size_a + m * size_b, codec=CODEC, asbytes=True)
                a.append(whole[: n * size_a])
                b.append(whole[n * size_a :])
        a, b = np.frombuffer(b"".join(a), self.a.kind).astype(np.int64), np.frombuffer(b"".join(b), self.b.kind).astype(np.int64)
        return Aligned(a, n_a[good], b, n_b[good], self.a.lengths, self.b.lengths), good

    def keys(self, links: Aligned) -> np.ndarray:
        return links.link_a * len(self.b.token_bytes) + links.link_b


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def worker_aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[(a_path, b_path)] = Aligner(a_path, b_path)
    return _ALIGNERS[(a_path, b_path)]


def batches(texts: list[str | None], chars: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Consecutive texts, about ``chars`` characters at a time; a longer text comes alone. Nulls come as empty texts."""
    batch, held = [], 0
    for text in texts:
        text = text or ""
        if batch and held + len(text) > chars:
            yield batch
            batch, held = [], 0
        batch.append(text)
        held += len(text)
    if batch:
        yield batch


def coded_batches(n_a: np.ndarray, n_b: np.ndarray, ids: list[bytes], most: int = BATCH_IDS) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Consecutive encoded texts, about ``most`` ids at a time; a longer text comes alone."""
    start, held = 0, 0
    for k, n in enumerate((n_a + n_b).tolist()):
        if k > start and held + n > most:
            yield n_a[start:k], n_b[start:k], ids[start:k]
            start, held = k, 0
        held += n
    if start < len(ids):
        yield n_a[start:], n_b[start:], ids[start:]


def encoded(df: DataFrame, a_path: str, b_path: str, text: str) -> DataFrame:
    """The rows with the ids of column ``text`` in its place (``CODED``), computed once and kept in the shared folder."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        aligner = worker_aligner(a_path, b_path)
        for texts in series:
            found = [aligner.encode(batch) for batch in batches(texts.tolist())]
            yield pd.DataFrame({
                "n_a": np.concatenate([np.zeros(0, np.int64), *[n for n, _, _ in found]]), "n_b": np.concatenate([np.zeros(0, np.int64), *[n for _, n, _ in found]]),
                "ids": pd.Series([x for _, _, ids in found for x in ids], dtype=object),
            })

    others = [named(c) for c in df.columns if c != text]
    return cut(df.select(*others, F.pandas_udf(run, CODED)(named(text)).alias("coded")))


class PairCounts:
    """Distinct keys with summed counts, merged whenever as much again has been added."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.new.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > max(len(self.keys), 1 << 16):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.new]])
        counts = np.concatenate([self.counts, *[c for _, c in self.new]])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.new, self.waiting = [], 0


def shard_of(a_ids: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(a_ids, 77) % np.uint64(shards)).astype(np.int64)


def document_counts(coded: DataFrame, a_path: str, b_path: str, shards: int) -> DataFrame:
    """Rows (shard, slot, keys, counts) from encoded texts: per task and shard, its distinct pairs in ascending order and how many of its documents hold them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, held, slot = worker_aligner(a_path, b_path), PairCounts(), TaskContext.get().partitionId()
        width = len(aligner.b.token_bytes)

        def flush() -> Iterator[pa.RecordBatch]:
            held.merge()
            shard = shard_of(held.keys // width, shards)
            order = np.argsort(shard, kind="stable")
            keys, counts, edges = held.keys[order], held.counts[order], np.searchsorted(shard[order], np.arange(shards + 1))
            filled = [s for s in range(shards) if edges[s] < edges[s + 1]]
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(filled, pa.int32()), "slot": pa.array([slot] * len(filled), pa.int32()),
                "keys": pa.array([keys[edges[s] : edges[s + 1]].astype("<i8").tobytes() for s in filled], pa.binary()),
                "counts": pa.array([counts[edges[s] : edges[s + 1]].astype("<i8").tobytes() for s in filled], pa.binary()),
            })

        for part in parts:
            for batch in coded_batches(part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_pylist()):
                links, _ = aligner.align(*batch)
                doc = np.repeat(np.arange(len(links.n_a)), links.n_links())
                # once per document
                pairs = np.unique(aligner.keys(links) | doc << 40) & (1 << 40) - 1
                held.add(*np.unique(pairs, return_counts=True))
                if len(held.keys) > HELD_PAIRS:
                    yield from flush()
                    held = PairCounts()
        yield from flush()

    return coded.select("coded.*").mapInArrow(run, "shard int, slot int, keys binary, counts binary")


def hashes(contributions: DataFrame) -> DataFrame:
    """Rows (shard, sizes, words, keys): the shard's minimal perfect hash and its keys in the order of their numbers."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def built(shard: int, held: PairCounts) -> pa.RecordBatch:
            held.merge()
            found = PerfectHash.build(held.keys)
            keys = np.empty(found.n, np.int64)
            keys[found.lookup(held.keys)] = held.keys
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "sizes": pa.array([found.sizes], pa.list_(pa.int64())),
                "words": pa.array([found.words.tobytes()], pa.binary()), "keys": pa.array([keys.astype("<i8").tobytes()], pa.binary()),
            })

        current, held = None, PairCounts()
        for part in parts:
            for shard, keys in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if shard != current:
                    if current is not None:
                        yield built(current, held)
                    current, held = shard, PairCounts()
                found = np.frombuffer(keys, "<i8")
                held.add(found, np.ones(len(found), np.int64))
        if current is not None:
            yield built(current, held)

    rows = contributions.select("shard", "keys").repartition(F.col("shard")).sortWithinPartitions("shard")
    return rows.mapInArrow(run, "shard int, sizes array<bigint>, words binary, keys binary")


def summed(contributions: DataFrame, hashed: DataFrame, fan: int = FAN) -> DataFrame:
    """Rows (shard, counts): dense vectors in hash order, summed level by level, ``fan`` of them at a time."""
    leaves = contributions.select("shard", "slot", F.col("keys").alias("at"), "counts")
    groups = leaves.select("shard", F.expr(f"slot div {fan}").alias("slot")).distinct()
    # every group of a shard's rows gets the shard's hash in front of them
    fronts = groups.join(hashed.select("shard", "sizes", "words"), "shard")
    rows = fronts.selectExpr("shard", "slot", "0 AS kind", "sizes", "words AS at", "CAST(NULL AS BINARY) AS counts").unionByName(
        leaves.selectExpr("shard", f"slot div {fan} AS slot", "1 AS kind", "CAST(NULL AS ARRAY<BIGINT>) AS sizes", "at", "counts")
    )

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(place: tuple[int, int], vector: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([place[0]], pa.int32()), "slot": pa.array([place[1]], pa.int64()), "counts": pa.array([vector.astype("<i8").tobytes()], pa.binary()),
            })

        current, hashing, vector = None, None, None
        for part in parts:
            for row in part.to_pylist():
                if (row["shard"], row["slot"]) != current:
                    if current is not None:
                        yield done(current, vector)
                    current, hashing, vector = (row["shard"], row["slot"]), None, None
                if row["kind"] == 0:
                    hashing = PerfectHash(row["sizes"], np.frombuffer(row["at"], np.uint64))
                    vector = np.zeros(hashing.n, np.int64)
                elif row["at"] is not None:
                    vector[hashing.lookup(np.frombuffer(row["at"], "<i8"))] += np.frombuffer(row["counts"], "<i8")
                else:  # an inner node's vector
                    found = np.frombuffer(row["counts"], "<i8")
                    vector = found.copy() if vector is None else vector + found
        if current is not None:
            yield done(current, vector)

    def level(rows: DataFrame) -> DataFrame:
        return rows.repartition("shard", "slot").sortWithinPartitions("shard", "slot", "kind").mapInArrow(add, "shard int, slot bigint, counts binary")

    vectors = level(rows)
    width = contributions.agg(F.max("slot")).first()[0]
    width = 0 if width is None else width // fan
    while width > 0:
        vectors = level(vectors.selectExpr(
            "shard", f"slot div {fan} AS slot", "1 AS kind", "CAST(NULL AS ARRAY<BIGINT>) AS sizes", "CAST(NULL AS BINARY) AS at", "counts"))
        width //= fan
    return vectors.select("shard", "counts")


class CountTable:
    """One slice of the counts: shards' hashes, their keys for verification, and each A id's highest count."""

    def __init__(self, rows: list, shards: int, width: int, a_ids: int):
        self.shards, self.width = shards, width
        self.parts = {}
        self.highest = np.zeros(a_ids, np.int64)
        for row in rows:
            keys, counts = np.frombuffer(row.keys, "<i8"), np.frombuffer(row.counts, "<i8")
            self.parts[row.shard] = PerfectHash(row.sizes, np.frombuffer(row.words, np.uint64)), keys, counts
            np.maximum.at(self.highest, keys // width, counts)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct keys; 0 for keys of other slices. A key of this slice that is missing is an error."""
        out = np.zeros(len(keys), np.int64)
        shard = shard_of(keys // self.width, self.shards)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s, (hashing, known, counts) in self.parts.items():
            rows = order[edges[s] : edges[s + 1]]
            if len(rows):
                at = hashing.lookup(keys[rows])
                if (at < 0).any() or (known[at] != keys[rows]).any():
                    raise LookupError("a pair of the second pass is not in the table of the first")
                out[rows] = counts[at]
        return out


def pair_counts(df: DataFrame, a_path: str, b_path: str, text_col: str = "text", *, shards: int = SHARDS, fan: int = FAN) -> DataFrame:
    """Rows (shard, n, sizes, words, keys, counts): in how many documents each linked id pair occurs, behind the shard's perfect hash.

    A key is A id * size of B's vocabulary + B id. Repeated rows count as several documents; an empty table gives no rows.
    """
    texts = df.select(whole_text(named(text_col)).alias("text"))
    return _pair_counts(encoded(texts, a_path, b_path, "text"), a_path, b_path, shards, fan)


def _pair_counts(coded: DataFrame, a_path: str, b_path: str, shards: int, fan: int) -> DataFrame:
    contributions = cut(document_counts(coded, a_path, b_path, shards))
    hashed = cut(hashes(contributions))
    return cut(hashed.join(summed(contributions, hashed, fan), "shard").select("shard", F.expr("length(keys) div 8").alias("n"), "sizes", "words", "keys", "counts"))


def align(
    df: DataFrame, a_path: str, b_path: str, text_col: str = "text", *, carry: list[str] | None = None, shards: int = SHARDS,
    slice_pairs: int = SLICE_PAIRS, groups: bool = False,
) -> DataFrame:
    """Align every text's tokens of the byte-level vocabulary at ``a_path`` with those of the piece model at ``b_path``.

    Adds n_a, n_b (tokens), n_groups, n_links, n_best (links whose count is the highest of their A id in all documents, ties included),
    count_sum (counts added over links) and groups_sha256; with ``groups`` also ``groups``, the digested string. These replace
    columns of the same name, others pass through. The text is space + text in A. Null texts, empty texts and texts that a tokenizer
    does not spell byte by byte have zeros and ''. Repeated rows count and come back as often as they occur; an empty table stays empty.
    """
    spark = df.sparkSession
    own = OWN + ["groups"] * groups
    carry = df.columns if carry is None else carry
    rows = encoded(df.select(packed(df, carry).alias("row"), whole_text(named(text_col)).alias("text")), a_path, b_path, "text")
    table = _pair_counts(rows, a_path, b_path, shards, FAN)
    sizes = sorted((r.shard, r.n) for r in table.select("shard", "n").collect())
    slices: list[list[int]] = [[]]
    held = 0
    for shard, n in sizes:  # at most ``shards`` rows
        if slices[-1] and held + n > slice_pairs:
            slices.append([])
            held = 0
        slices[-1].append(shard)
        held += n
    zero = F.lit(0).cast("long")
    rows = rows.select("row", "coded", F.struct(*[(F.lit("") if c in OWN[6:] + ["groups"] else zero).alias(c) for c in own]).alias("found"))
    run_name = uuid.uuid4().hex
    for k, shard_ids in enumerate(slices):
        found = table.where(F.col("shard").isin(shard_ids)).select("shard", "sizes", "words", "keys", "counts").collect()
        held_table = spark.sparkContext.broadcast([tuple(r) for r in found])
        looked = F.pandas_udf(_lookup(a_path, b_path, held_table, f"{run_name}-{k}", shards, groups), ", ".join(f"{c} {'string' if c in ('groups', 'groups_sha256') else 'long'}" for c in own))
        rows = rows.withColumn("now", looked("coded.n_a", "coded.n_b", "coded.ids"))
        add = [(F.col(f"found.{c}") + F.col(f"now.{c}") if c in ("n_best", "count_sum") else F.col(f"now.{c}")).alias(c) for c in own]
        rows = rows.select("row", "coded", F.struct(*add).alias("found"))
        if k + 1 < len(slices):
            rows = cut(rows)
            held_table.unpersist()
    return rows.select(*unpacked("row", carry, own), *[F.col(f"found.{c}").alias(c) for c in own])


_TABLES: dict[str, CountTable] = {}


def _lookup(a_path: str, b_path: str, held_table, table_name: str, shards: int, groups: bool):
    def run(series: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from collections import namedtuple

        aligner = worker_aligner(a_path, b_path)
        width, kind = len(aligner.b.token_bytes), namedtuple("row", "shard sizes words keys counts")
        if table_name not in _TABLES:
            _TABLES.clear()
            _TABLES[table_name] = CountTable([kind(*r) for r in held_table.value], shards, width, len(aligner.a.token_bytes))
        table = _TABLES[table_name]
        for n_a, n_b, ids in series:
            out: dict[str, list[np.ndarray]] = {c: [] for c in OWN + ["groups"] * groups}
            for batch in coded_batches(n_a.to_numpy(), n_b.to_numpy(), ids.tolist()):
                links, good = aligner.align(*batch)
                keys, back = np.unique(aligner.keys(links), return_inverse=True)
                counts = table.counts(keys)
                # links of other slices have count 0 and are no best ones
                best = (counts == table.highest[keys // width]) & (counts > 0)
                named_groups = links.group_texts(aligner.names, aligner.width)
                till = [np.concatenate([[0], np.cumsum(x[back])]) for x in (best.astype(np.int64), counts)]
                sums = [np.diff(t[links.docs]) for t in till]
                digests = [hashlib.sha256(g).hexdigest() for g in named_groups]
                values = [links.n_a, links.n_b, links.n_groups(), links.n_links(), *sums, digests]
                for name, value in zip(out, values + [[g.decode() for g in named_groups]] * groups):
                    whole = np.full(len(good), "", object) if name in ("groups", "groups_sha256") else np.zeros(len(good), np.int64)
                    whole[good] = value
                    out[name].append(whole)
            yield pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()})

    # pandas_udf reads the types of an iterator function from its signature
    run.__annotations__ = {"series": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return run
