"""Token ids of a corpus as files of coded blocks, in ascending order of the documents' ids.

Documents are dealt by ranges of their id, so that the files' order is the documents' order, and sorted within each. A task encodes its texts,
appends the end id to each, and cuts the stream of ids into blocks of a fixed number of ids (the last one of a file may be shorter), whatever the
documents' borders; blocks are coded in step (``range_coder``). Rows of the Parquet files: ``part`` (the file's place in the order),
``block``, ``n_ids`` and ``payload``, the block with its list of documents and its checksums. A block can be read without any other; Spark's own
committer makes a lost task's output vanish.

Reading decodes blocks wherever they lie and puts a document's pieces together by its ordinal; starts come from one count per file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe.llm import range_coder
from tabprobe.llm.common import named, whole_text
from tabprobe.llm.range_coder import Block, decode_blocks, encode_blocks
from tabprobe.llm.vocabularies import ByteLevel

#: Characters of text per file.
FILE_CHARS = 20_000_000
#: Characters encoded at a time.
BATCH_CHARS = 1_000_000
SCHEMA = "part int, block int, n_ids int, payload binary"

_CODERS: dict[str, ByteLevel] = {}


def worker_coder(path: str) -> ByteLevel:
    if path not in _CODERS:
        _CODERS[path] = ByteLevel(path)
    return _CODERS[path]


class _Stream:
    """Ids of documents in order, cut into blocks."""

    def __init__(self, size: int):
        self.size, self.first, self.ordinal = size, 0, -1
        self.held: list[np.ndarray] = []
        self.n_held = 0
        #: Documents with ids not yet in a block: ordinal, id, ids left.
        self.docs: list[list] = []

    def add(self, ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        for doc_id, n in zip(doc_ids, lengths):
            self.ordinal += 1
            self.docs.append([self.ordinal, doc_id, n])

    def blocks(self, all_of_them: bool) -> list[Block]:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint16)
        stop = len(ids) if all_of_them else len(ids) // self.size * self.size
        out, at = [], 0
        for s in range(0, stop, self.size):
            block = ids[s : min(s + self.size, stop)]
            left, first, doc_ids, lengths = len(block), self.docs[at][0], [], []
            while left:
                doc = self.docs[at]
                taken = min(left, doc[2])
                doc_ids.append(doc[1])
                lengths.append(taken)
                left -= taken
                doc[2] -= taken
                at += doc[2] == 0
            out.append(Block(self.first + s, block, first, doc_ids, lengths))
        self.docs = self.docs[at:]
        self.first += stop
        self.held, self.n_held = [ids[stop:]], len(ids) - stop
        return out


def write_ids(
    df: DataFrame, vocabulary: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, block_ids: int = range_coder.BLOCK,
    file_chars: int = FILE_CHARS,
) -> None:
    """Encode a text column with the byte-level vocabulary and write the ids, each document's followed by ``end_id``, below ``path``.

    Null ids come first; rows with the same id are in the order of a hash of their text, repeated rows stay repeated. Null texts are
    empty: their only id is ``end_id``. An empty table writes no blocks. Other columns are not written.
    """
    rows = df.select(named(id_col).cast("long").alias("doc_id"), whole_text(named(text_col)).alias("text"))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tie = F.xxhash64("text")
    dealt = rows.withColumn("tie", tie).repartitionByRange(max(1, -(-chars // file_chars)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, stream, n_blocks = worker_coder(vocabulary), _Stream(block_ids), 0
        end = np.array([end_id], coder.kind)
        part_no = TaskContext.get().partitionId()

        def coded(blocks: list[Block]) -> Iterator[pa.RecordBatch]:
            nonlocal n_blocks
            for s in range(0, len(blocks), range_coder.LANES):
                some = blocks[s : s + range_coder.LANES]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part_no] * len(some), pa.int32()), pa.array(range(n_blocks, n_blocks + len(some)), pa.int32()),
                    pa.array([len(b.ids) for b in some], pa.int32()), pa.array(encode_blocks(some), pa.binary()),
                ], ["part", "block", "n_ids", "payload"])
                n_blocks += len(some)

        def add(texts: list[str], doc_ids: list[int | None]) -> None:
            ids, counts, _ = coder.encode(texts)
            # the end id goes behind each document's ids
            whole = np.insert(ids, np.cumsum(counts), end)
            stream.add(whole, doc_ids, (counts + 1).tolist())

        for part in parts:
            texts, doc_ids, held = [], [], 0
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if texts and held + len(text) > BATCH_CHARS:
                    add(texts, doc_ids)
                    texts, doc_ids, held = [], [], 0
                    # a quarter more than can be coded in step, so that the last blocks of a file are no small rest
                    if stream.n_held > block_ids * range_coder.LANES * 5 // 4:
                        yield from coded(stream.blocks(False))
                texts.append(text)
                doc_ids.append(doc_id)
                held += len(text)
            add(texts, doc_ids)
        yield from coded(stream.blocks(True))

    dealt.mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(path)


def _pieces(blocks: DataFrame) -> DataFrame:
    """Rows (part, ordinal, doc_id, at, n, crc): the stretches of documents' ids found in the blocks; ``at`` is a place in the file."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []

        def decoded() -> pa.RecordBatch:
            rows: list[tuple] = []
            for (part, _), block in zip(held, decode_blocks([p for _, p in held])):
                data, at = block.ids.astype("<u4").tobytes(), 0
                for k, (doc_id, n) in enumerate(zip(block.doc_ids, block.lengths)):
                    rows.append((part, block.ordinal + k, doc_id, block.first + at, n, zlib.crc32(data[4 * at : 4 * (at + n)])))
                    at += n
            kinds = [pa.int32(), *[pa.int64()] * 5]
            columns = zip(*rows) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["part", "ordinal", "doc_id", "at", "n", "crc"])

        for part in parts:
            for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                held.append(row)
                if len(held) == range_coder.LANES:
                    yield decoded()
                    held = []
        yield decoded()

    return blocks.select("part", "payload").mapInArrow(run, "part int, ordinal bigint, doc_id bigint, at bigint, n bigint, crc bigint")


def _zero_steps() -> np.ndarray:
    """What 2^k zero bits make of each bit of a crc32, for k below 64: one zero bit shifts and folds, squaring doubles their number."""
    steps = [[0xEDB88320, *[1 << k for k in range(31)]]]
    for _ in range(63):
        last = steps[-1]
        steps.append([_applied(last, row) for row in last])
    return np.array(steps, np.uint64)


def _applied(matrix: list[int], vector: int) -> int:
    out = 0
    for k, row in enumerate(matrix):
        out ^= row * (vector >> k & 1)
    return out


_ZEROS = _zero_steps()


def joined_crcs(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of two byte strings in a row from theirs: the first one's, moved on by ``lengths`` zero bytes, with the second one's."""
    first, zeros = first.astype(np.uint64), 8 * lengths.astype(np.int64)
    for k in range(int(zeros.max(initial=0)).bit_length()):
        rows = np.flatnonzero(zeros >> k & 1)
        if len(rows):
            bits = first[rows, None] >> np.arange(32, dtype=np.uint64) & np.uint64(1)
            first[rows] = np.bitwise_xor.reduce(bits * _ZEROS[k], axis=1)
    return first ^ second.astype(np.uint64)


@F.pandas_udf(T.LongType())
def _joined(crcs: pd.Series, lengths: pd.Series) -> pd.Series:
    whole = np.array([c[0] for c in crcs], np.uint64)
    counts = np.array([len(c) for c in crcs], np.int64)
    for k in range(1, int(counts.max(initial=0))):
        rows = np.flatnonzero(counts > k)
        whole[rows] = joined_crcs(whole[rows], np.array([crcs.iat[r][k] for r in rows], np.uint64), 4 * np.array([lengths.iat[r][k] for r in rows], np.int64))
    return pd.Series(whole.astype(np.int64))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Decode every file below ``path``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers).

    One row per written document. A damaged block is an error. Files without blocks give no rows.
    """
    blocks = spark.read.schema(SCHEMA).parquet(path)
    # one number per file; the files' order is the documents'
    totals = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    offsets, before = [], 0
    for part, n in totals:
        offsets.append((part, before))
        before += n
    pieces = _pieces(blocks).groupBy("part", "ordinal").agg(F.max("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces"))
    whole = pieces.select("part", "doc_id", F.col("pieces")[0]["at"].alias("at"), F.aggregate("pieces.n", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_tokens"),
                          _joined("pieces.crc", "pieces.n").alias("ids_crc32"))
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    return whole.join(starts, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The blocks' ids as rows (part, block, ids), for readers that need the stream itself."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def ids(payloads: pd.Series) -> pd.Series:
        return pd.Series([b.ids.astype(np.int64) for b in decode_blocks(payloads.tolist())], dtype=object)

    return spark.read.schema(SCHEMA).parquet(path).select("part", "block", ids("payload").alias("ids"))
