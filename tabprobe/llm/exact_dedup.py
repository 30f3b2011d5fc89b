"""Exact duplicates by owners in Patricia tries.

Each task puts its texts, as full byte strings, into a compressed radix trie whose terminal nodes
hold the group so far; only distinct texts leave it, so a text that fills a third of all
rows crosses the network once per task. The distinct texts are dealt by byte length and
content hash, and a second trie per length and hash prefix settles the owners. A
trie above its budget gives up its largest subtree: before the exchange the subtree's terminals simply
travel early; after it, rows come in hash order, so that every terminal but the
current one is final. Texts are compared byte by byte in the tries; the hash only deals
and names them, and two texts under one name stop the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabprobe.llm.common import lower_ascii, named, packed, unpacked, whole_text

OWN = ["keep_id", "group_size", "kept", "text_sha256"]
#: Bytes of labels that a task's trie may hold.
TRIE_BYTES = 48 << 20


class OwnerTrie:
    """Radix trie over bytes. Terminals are [name, best id, rows, rows with the best id, bytes]."""

    def __init__(self, largest: bool, budget: int):
        self.largest, self.budget = largest, budget
        self.edges: dict = {}
        self.held = 0

    def insert(self, key: bytes, name, best, rows: int, top: int) -> list:
        """Add rows of a text; returns its terminal."""
        if not key:
            terminal = self.edges.get(-1)
            if terminal is None:
                terminal = self.edges[-1] = [name, best, rows, top, key]
                return terminal
            return self._add(terminal, best, rows, top)
        edges, at = self.edges, 0
        while True:
            edge = edges.get(key[at])
            if edge is None:
                terminal = [name, best, rows, top, key]
                edges[key[at]] = [key[at:], {-1: terminal}]
                self.held += len(key) - at + 200
                return terminal
            label = edge[0]
            if not key.startswith(label, at):
                edge = self._split(edges, edge, key, at)
                label = edge[0]
            at, edges = at + len(label), edge[1]
            if at == len(key):
                terminal = edges.get(-1)
                if terminal is None:
                    terminal = edges[-1] = [name, best, rows, top, key]
                    return terminal
                return self._add(terminal, best, rows, top)

    @staticmethod
    def _split(edges: dict, edge: list, key: bytes, at: int) -> list:
        """Part an edge where the key leaves its label; the common length is found by bisection."""
        label = edge[0]
        low, high = 1, len(label) - 1
        while low < high:
            middle = (low + high + 1) // 2
            if key.startswith(label[:middle], at):
                low = middle
            else:
                high = middle - 1
        above = [label[:low], {label[low]: [label[low:], edge[1]]}]
        edges[label[0]] = above
        return above

    def _add(self, terminal: list, best, rows: int, top: int) -> list:
        mine = terminal[1]
        if best == mine:
            terminal[3] += top
        elif mine is None or (best is not None and (best > mine) == self.largest):
            terminal[1], terminal[3] = best, top
        terminal[2] += rows
        return terminal

    @staticmethod
    def _walk(edges: dict) -> Iterator[list]:
        stack = [edges]
        while stack:
            here = stack.pop()
            for first, what in here.items():
                if first == -1:
                    yield what
                else:
                    stack.append(what[1])

    def drain(self) -> list[list]:
        found = list(self._walk(self.edges))
        self.edges, self.held = {}, 0
        return found

    def spill(self, current: list) -> list[list]:
        """Over budget, all terminals of the largest subtrees, leaving the current one."""
        out: list[list] = []
        parts = sorted(
            ((sum(len(t[4]) + 200 for t in self._walk(e[1])), first) for first, e in self.edges.items() if first != -1),
            reverse=True,
        )
        for size, first in parts:
            if self.held <= self.budget // 2:
                break
            gone = list(self._walk(self.edges.pop(first)[1]))
            out.extend(t for t in gone if t is not current)
            self.held = max(0, self.held - size)
            if any(t is current for t in gone):
                self._put_back(current)
        return out

    def _put_back(self, terminal: list) -> None:
        key = terminal[4]
        self.edges[key[0]] = [key, {-1: terminal}]
        self.held += len(key) + 200


def _batches(found: list[list], schema: pa.Schema, texts: bool) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(found), 2000):
        part = found[start : start + 2000]
        columns = [
            [len(t[4]) for t in part], [t[0] for t in part], [t[1] for t in part], [t[2] for t in part], [t[3] for t in part],
        ]
        if texts:
            columns.append([t[4] for t in part])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def text_owners(rows: DataFrame, largest: bool = True, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Owners of texts: from (id, name, text), one row (n_bytes, name, keep_id, group_size, n_top) per distinct text.

    ``name`` must be a function of the text, such as a digest. Rows without an id count, and own a group only
    if no row of it has one. ``n_top`` counts the rows that carry the owner's id.
    """
    id_type = rows.schema["id"].dataType
    slim = StructType().add("n_bytes", "long").add("name", "string").add("keep_id", id_type).add("group_size", "long").add("n_top", "long")
    full = StructType(list(slim.fields)).add("bytes", "binary")
    slim_arrow, full_arrow = to_arrow_schema(slim), to_arrow_schema(full)

    def combine(batches):
        trie = OwnerTrie(largest, trie_bytes)
        for batch in batches:
            for key, name, text in zip(*(batch.column(c).to_pylist() for c in ("id", "name", "text"))):
                terminal = trie.insert(text.encode(), name, key, 1, 1)
                if trie.held > trie_bytes:
                    yield from _batches(trie.spill(terminal), full_arrow, True)
        yield from _batches(trie.drain(), full_arrow, True)

    def settle(batches):
        trie, bucket, last = OwnerTrie(largest, trie_bytes), None, None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("n_bytes", "name", "keep_id", "group_size", "n_top", "bytes"))
            for n_bytes, name, best, n, top, text in zip(*columns):
                if (n_bytes, name[:4]) != bucket:
                    yield from _batches(trie.drain(), slim_arrow, False)
                    bucket, last = (n_bytes, name[:4]), None
                terminal = trie.insert(text, name, best, n, top)
                if last is not None and last[0] == name and last[4] != text:
                    raise ValueError(f"two texts share the digest {name}")
                last = terminal
                if trie.held > trie_bytes:
                    yield from _batches(trie.spill(terminal), slim_arrow, False)
        yield from _batches(trie.drain(), slim_arrow, False)

    return (
        rows.mapInArrow(combine, full)
        .repartition(F.col("n_bytes"), F.substring("name", 1, 4))
        .sortWithinPartitions("n_bytes", "name")
        .mapInArrow(settle, slim)
    )


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, carry: list[str] | None = None, largest: bool = True,
    trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """Mark exact duplicates: texts equal but for the case of A-Z.

    Adds ``keep_id`` (largest id of the group, or smallest), ``group_size``, ``kept`` and ``text_sha256`` to every
    row; these replace input columns of the same name. ``carry`` names the columns to return (default: all).
    A null text counts as empty. Rows that share both id and text are one document written
    twice: one of them is kept. Null ids rank last; a group of null ids keeps one row with a null
    ``keep_id``. An empty table gives an empty table.
    """
    carry = df.columns if carry is None else carry
    rows = df.select(packed(df, carry).alias("row"), named(id_col).alias("id"), lower_ascii(whole_text(named(text_col))).alias("text"))
    rows = rows.withColumn("name", F.sha2("text", 256)).withColumn("n_bytes", F.octet_length("text").cast("long"))
    owners = text_owners(rows.select("id", "name", "text"), largest, trie_bytes)
    joined = rows.select("row", "id", "name", "n_bytes").join(owners, ["n_bytes", "name"])
    first = F.row_number().over(Window.partitionBy("name", "id").orderBy("n_bytes"))
    return joined.withColumn("n", first).select(
        *unpacked("row", carry, OWN), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == 1)).alias("kept"),
        F.col("name").alias("text_sha256"),
    )


def keep_owners(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns they came with; rows written twice stay once."""
    def key(digest, id_col):
        return F.concat_ws(":", digest, id_col.cast("string")).alias("key")

    kept = exact_dedup(docs, carry=["doc_id"]).where("kept").select(key(F.col("text_sha256"), F.col("doc_id")))
    rows = docs.select(packed(docs).alias("row"), key(F.sha2(lower_ascii(whole_text(F.col("text"))), 256), F.col("doc_id")))
    once = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return rows.join(kept, "key").withColumn("n", once).where("n = 1").select(*unpacked("row", docs.columns, []))
