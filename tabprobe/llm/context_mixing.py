"""Language-model scores by online logistic context mixing, beside a word-count baseline.

The model predicts a text's bytes bit by bit. For each bit, predictors of several orders look up how often zero and one followed the last
bytes and the bits of the current byte in all training documents; every context has counts of its own. A gate, the bit's place and the
longest context that has been seen, chooses the weights with which the predictions are mixed in the logistic domain; a table
over the mixed prediction and the last byte refines it. Each occurrence is taken out of the counts while it is predicted for learning. The score is
minus the total of bits.

With a fixed model, the cost of a byte depends on it and on the five bytes before it alone. Tasks turn documents into chunks and send each
chunk's distinct strings of six bytes, with their training counts, to the partition of the hash of the three bytes before the last one. All contexts of
orders 3 to 5 lie there whole; those of orders 0 to 2, at most 2**24 strings, are summed over the partitions and go to all of them. Weights are
learnt in each partition and averaged; each chunk gets back the costs of its strings.

The baseline counts words. Tasks turn documents into chunks: the texts, written once, and distinct words with their
training counts, which go to the partition of the word's hash and come back with the totals. However common a word
is, it crosses the network once per chunk each way.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import cut, giving_back, named, remove, shared_path, short_batches, training_fold, whole_text
from tabprobe.llm.ngram_jaccard import mix64, word_hashes

#: Predictors; order k looks at the last k bytes.
ORDERS = 6
START, END = 0xFF, 0xFF  # a byte that no UTF-8 text has
#: Bytes scored, or documents' bytes turned into a chunk, in one go.
CHUNK_BYTES, MODEL_CHUNK_BYTES = 2 << 20, 4 << 20
STEPS = 33
FRONT = ORDERS - 1
#: The largest order whose counts go to every task.
LOW = 2
#: Rates of the passes over all training strings.
RATES = (0.3, 0.1, 0.03)


def held_out(doc_id: Column) -> Column:
    return training_fold(doc_id, 10) == 0


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -25, 25)))


def strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Six-byte strings that end at each byte, and at the end, of lower-cased texts, and the number of them per text."""
    front = bytes([START]) * FRONT
    data = np.frombuffer(b"".join(front + t + bytes([END]) for t in texts), np.uint8)
    keys = np.zeros(max(0, len(data) - FRONT), np.uint64)
    for i in range(FRONT + 1):
        keys <<= np.uint64(8)
        keys |= data[i : len(data) - FRONT + i]
    counts = np.array([len(t) + 1 for t in texts], np.int64)
    # strings that would end in the next text's front are left out
    inside = np.ones(len(keys), bool)
    ends = np.cumsum(counts + FRONT) - FRONT
    for i in range(FRONT):
        inside[ends[:-1] + i] = False
    return keys[inside], counts


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their total times, in 64 bits."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order].astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(times, starts) if len(starts) else times


def tail(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & np.uint64((1 << (8 * n)) - 1)


class Contexts:
    """Counts after every context: those up to order LOW from ``low`` strings of LOW + 1 bytes, the others from ``keys``."""

    def __init__(self, keys: np.ndarray, times: np.ndarray, low: np.ndarray, low_times: np.ndarray):
        self.orders = []
        for order in range(FRONT + 1):
            distinct, total = summed(tail(low, order + 1), low_times) if order <= LOW else summed(tail(keys, order + 1), times)
            self.orders.append((distinct, np.append(0, np.cumsum(total))))

    def counts(self, keys: np.ndarray, bit: int) -> Iterator[np.ndarray]:
        """Per order, counts of zeros and ones at the given bit of each string's last byte: strings with one front lie side by side."""
        for order, (distinct, before) in enumerate(self.orders):
            low = tail(keys, order + 1) >> np.uint64(bit + 1) << np.uint64(bit + 1)
            a, b, c = (before[np.searchsorted(distinct, low + np.uint64(step << bit))] for step in range(3))
            yield np.stack((b - a, c - b), axis=1)


@dataclass
class Mixer:
    table: Contexts | None
    weights: np.ndarray  # gates, orders
    refine: np.ndarray  # 256, STEPS

    @staticmethod
    def fresh(table: Contexts | None) -> Mixer:
        grid = squash((np.arange(STEPS) - STEPS // 2) / 2.0)
        return Mixer(table, np.full((8 * (ORDERS + 1), ORDERS), 0.3), np.tile(grid, (256, 1)))

    def inputs(self, keys: np.ndarray, bit: int, without: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretched predictions of all orders, the gate and the true bit. ``without``: each occurrence is left out of its counts."""
        one = ((keys >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)
        x = np.zeros((len(keys), ORDERS))
        longest = np.zeros(len(keys), np.int64)
        for order, counts in enumerate(self.table.counts(keys, bit)):
            counts = counts.astype(float)
            if without:
                counts[np.arange(len(keys)), one] = np.maximum(counts[np.arange(len(keys)), one] - 1, 0)
            total = counts.sum(axis=1)
            seen = total > 0
            x[:, order] = np.where(seen, stretch((counts[:, 1] + 0.05) / (total + 0.1)), 0.0)
            longest[seen] = order + 1
        return x, bit * (ORDERS + 1) + longest, one

    def refined(self, mixed: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip(mixed * 2 + STEPS // 2, 0, STEPS - 1.001)
        low = at.astype(np.int64)
        return low, at - low, (1 - (at - low)) * self.refine[last, low] + (at - low) * self.refine[last, low + 1]

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Cost in bits of the last byte of each string."""
        cost = np.zeros(len(keys))
        last = ((keys >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
        for bit in range(7, -1, -1):
            x, gate, one = self.inputs(keys, bit, False)
            mixed = (x * self.weights[gate]).sum(axis=1)
            p = np.clip(0.5 * squash(mixed) + 0.5 * self.refined(mixed, last)[2], 1e-5, 1 - 1e-5)
            cost -= np.log2(np.where(one == 1, p, 1 - p))
        return cost

    def learn(self, keys: np.ndarray, times: np.ndarray, rate: float, batch: int = 512) -> np.ndarray:
        """One online pass of the weights over strings that occurred ``times`` times; returns the bits that each gate saw."""
        seen = np.zeros(len(self.weights))
        for at in range(0, len(keys), batch):
            k, t = keys[at : at + batch], times[at : at + batch].astype(float)
            for bit in range(7, -1, -1):
                x, gate, one = self.inputs(k, bit, True)
                wrong = (one - squash((x * self.weights[gate]).sum(axis=1))) * t
                hits = np.bincount(gate, t, len(self.weights))
                seen += hits
                for order in range(x.shape[1]):
                    self.weights[:, order] += rate * np.bincount(gate, wrong * x[:, order], len(self.weights)) / np.maximum(hits, 1e-9)
        return seen

    def hits(self, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often a one came, and any bit, by last byte and step of the mixed prediction: (2, 256, STEPS)."""
        out = np.zeros((2, 256 * STEPS))
        for at in range(0, len(keys), 1 << 15):
            k, t = keys[at : at + (1 << 15)], times[at : at + (1 << 15)].astype(float)
            last = ((k >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
            for bit in range(7, -1, -1):
                x, gate, one = self.inputs(k, bit, True)
                low, part, _ = self.refined((x * self.weights[gate]).sum(axis=1), last)
                flat = last * STEPS + low + (part > 0.5)
                out += np.bincount(flat, t * one, 256 * STEPS), np.bincount(flat, t, 256 * STEPS)
        return out.reshape(2, 256, STEPS)


def text_batches(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= most):
            held += len(texts[end])
            end += 1
        yield at, end
        at = end


def lowered(column: pa.Array) -> list[bytes]:
    return [t.encode().lower() if t else b"" for t in column.to_pylist()]


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each string, by the three bytes before its last one."""
    return (mix64(tail(keys >> np.uint64(8), LOW + 1)) % np.uint64(parts)).astype(np.int64)


def deflated(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def inflated(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def packed_keys(keys: np.ndarray) -> bytes:
    return deflated(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(inflated(data, np.uint64), dtype=np.uint64)


def parted(sizes: bytes, texts: bytes) -> list[bytes]:
    """The texts of a chunk."""
    ends, whole = np.cumsum(np.frombuffer(sizes, np.int64)).tolist(), zlib.decompress(texts)
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def model_chunks(rows: DataFrame, parts: int, folder: str) -> DataFrame:
    """Rows (id, text, text_hash, training) as chunks below ``folder``: the texts, and by partition the distinct strings with their training counts."""
    spark = rows.sparkSession
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"ids array<{id_type}>, hashes binary, sizes binary, texts binary, part array<int>, part_keys array<binary>, part_times array<binary>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = lowered(batch.column("text"))
            learns = np.array(batch.column("training").to_pylist(), bool)
            for at, end in text_batches(texts, MODEL_CHUNK_BYTES):
                n = end - at
                keys, counts = strings(texts[at:end])
                learnt, times = np.unique(keys[np.repeat(learns[at:end], counts)], return_counts=True)
                distinct = np.unique(keys)
                del keys
                train = np.zeros(len(distinct), np.int64)
                train[np.searchsorted(distinct, learnt)] = times
                part = part_of(distinct, parts)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                mine = {p: order[cuts[p] : cuts[p + 1]] for p in range(parts) if cuts[p] < cuts[p + 1]}
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("id").slice(at, n).to_pylist()], pa.list_(batch.schema.field("id").type)),
                        pa.array([np.array(batch.column("text_hash").slice(at, n).to_pylist(), np.int64).tobytes()], pa.binary()),
                        pa.array([np.array([len(t) for t in texts[at:end]], np.int64).tobytes()], pa.binary()), pa.array([zlib.compress(b"".join(texts[at:end]), 1)], pa.binary()),
                        pa.array([list(mine)], pa.list_(pa.int32())), pa.array([[packed_keys(distinct[m]) for m in mine.values()]], pa.list_(pa.binary())),
                        pa.array([[deflated(train[m]) for m in mine.values()]], pa.list_(pa.binary())),
                    ],
                    names=["ids", "hashes", "sizes", "texts", "part", "part_keys", "part_times"],
                )

    rows.select("id", "text", "text_hash", "training").mapInArrow(giving_back(build), schema).withColumn("chunk", F.monotonically_increasing_id()).write.parquet(folder)
    return spark.read.schema(schema + ", chunk long").parquet(folder)


def string_counts(asked: DataFrame, parts: int) -> DataFrame:
    """(part, part_keys, part_times): the training strings of each partition, once each, with their counts."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, keys, times in zip(*(c.to_pylist() for c in batch.columns)):
                keys, times = unpacked_keys(keys), inflated(times, np.int64)
                held.setdefault(part, []).append((keys[times > 0], times[times > 0]))
        made = {part: summed(*(np.concatenate([p[i] for p in pieces]) for i in range(2))) for part, pieces in sorted(held.items())}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(made), pa.int32()), pa.array([packed_keys(k) for k, _ in made.values()], pa.binary()), pa.array([deflated(t) for _, t in made.values()], pa.binary())],
            names=["part", "part_keys", "part_times"],
        )

    return cut(asked.select("part", "part_keys", "part_times").repartition(parts, "part").mapInArrow(giving_back(total), "part int, part_keys binary, part_times binary"))


def low_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Strings of LOW + 1 bytes with their counts; there are at most 2**24 of them, so every task may hold them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, times in zip(*(c.to_pylist() for c in batch.columns)):
                keys, times = summed(tail(unpacked_keys(keys), LOW + 1), inflated(times, np.int64))
                block = keys % np.uint64(64)
                some = np.unique(block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array([packed_keys(keys[block == b]) for b in some], pa.binary()), pa.array([deflated(times[block == b]) for b in some], pa.binary())],
                    names=["block", "part_keys", "part_times"],
                )

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        keys, times = summed(np.concatenate([unpacked_keys(k) for k in frame["part_keys"]]), np.concatenate([inflated(t, np.int64) for t in frame["part_times"]]))
        return pd.DataFrame({"block": frame["block"].iloc[:1], "part_keys": [packed_keys(keys)], "part_times": [deflated(times)]})

    kinds = "block int, part_keys binary, part_times binary"
    found = counts.select("part_keys", "part_times").mapInArrow(giving_back(send), kinds).groupBy("block").applyInPandas(add, kinds).collect()
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return summed(np.concatenate([unpacked_keys(r["part_keys"]) for r in found]), np.concatenate([inflated(r["part_times"], np.int64) for r in found]))


def fit(counts: DataFrame, low: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and refinement from the training strings (part, part_keys, part_times) of all partitions.

    Each pass starts in every partition with the weights of the pass before, and averages over the partitions by the bits that each gate saw.
    The refinement has the sums of all partitions.
    """
    spark = counts.sparkSession.sparkContext
    held = spark.broadcast(low)
    blocks = 64

    def mixers(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[tuple]:
        for batch in batches:
            for part, keys, times in zip(*(c.to_pylist() for c in batch.columns)):
                keys, times = unpacked_keys(keys), inflated(times, np.int64)
                mixer = Mixer.fresh(Contexts(keys, times, *held.value))
                mixer.weights = weights.copy()
                yield mixer, keys, times, part

    def over_all(work: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple) -> np.ndarray:
        """Sums of what tasks return, by blocks."""

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = np.array_split(work(batches).reshape(-1), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([deflated(x) for x in pieces], pa.binary())], names=["block", "sums"])

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            rows = sorted(frame["sums"])  # one order of adding for one result
            return pd.DataFrame({"block": frame["block"].iloc[:1], "sums": [deflated(sum(inflated(s, float) for s in rows))]})

        kinds = "block int, sums binary"
        found = {r["block"]: r["sums"] for r in counts.mapInArrow(giving_back(send), kinds).groupBy("block").applyInPandas(add, kinds).collect()}
        return np.concatenate([inflated(found[b], float) for b in range(blocks)]).reshape(shape) if found else np.zeros(shape)

    fresh = Mixer.fresh(None)
    weights = fresh.weights
    for rate in RATES:

        def learn(batches: Iterator[pa.RecordBatch], weights=weights, rate=rate) -> np.ndarray:
            out = np.zeros((len(weights), weights.shape[1] + 1))
            for mixer, keys, times, part in mixers(batches, weights):
                order = np.random.default_rng(part).permutation(len(keys))
                seen = mixer.learn(keys[order], times[order], rate)
                out += np.column_stack((mixer.weights * seen[:, None], seen))
            return out

        found = over_all(learn, (len(weights), weights.shape[1] + 1))
        weights = np.where(found[:, -1:] > 0, found[:, :-1] / np.maximum(found[:, -1:], 1e-9), weights)

    def refine(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        return sum((mixer.hits(keys, times) for mixer, keys, times, _ in mixers(batches, weights)), np.zeros((2, 256, STEPS)))

    ones, every = over_all(refine, (2, 256, STEPS))
    held.destroy()
    return weights, (ones + 200 * fresh.refine) / (every + 200)


def mixing_scores(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, bits, n_bytes) of every row's whole text, its end included; null texts count as empty. ``training`` says which rows are counted."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(named(id_col).alias("id"), whole_text(named(text_col)).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    folder = shared_path(spark, "strings")
    chunks = model_chunks(rows.withColumn("text_hash", F.xxhash64("text")), parts, folder)
    asked = chunks.select("chunk", F.explode(F.arrays_zip("part", "part_keys", "part_times")).alias("z")).select("z.part", "z.part_keys", "z.part_times", "chunk")
    counts = string_counts(asked, parts)
    low = low_counts(counts)
    held = spark.sparkContext.broadcast((low, *fit(counts, low)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, weights, refine = held.value
        asks: dict[int, list] = {}
        known: dict[int, tuple] = {}
        for batch in batches:
            for part, keys, times, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk is None:
                    known[part] = unpacked_keys(keys), inflated(times, np.int64)
                else:
                    asks.setdefault(part, []).append((chunk, unpacked_keys(keys)))
        for part, pieces in asks.items():
            model = Mixer(Contexts(*known.get(part, (np.empty(0, np.uint64), np.empty(0, np.int64))), *low), weights, refine)
            distinct, back = np.unique(np.concatenate([p[1] for p in pieces]), return_inverse=True)
            cost = np.concatenate([model.bits(distinct[i : i + (1 << 15)]) for i in range(0, len(distinct), 1 << 15)]).astype(np.float32)
            cuts = np.cumsum([len(p[1]) for p in pieces])
            told = [cost[back[b - len(p[1]) : b]].tobytes() for p, b in zip(pieces, cuts.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.int64()), pa.array([part] * len(pieces), pa.int32()), pa.array(told, pa.binary())], names=["chunk", "part", "costs"])

    everything = asked.withColumn("part_times", F.lit(None).cast("binary")).unionByName(counts.withColumn("chunk", F.lit(None).cast("long")))
    told = everything.select("part", "part_keys", "part_times", "chunk").repartition(parts, "part").mapInArrow(giving_back(answer), "chunk long, part int, costs binary")
    answers = told.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "costs"))).alias("answers"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, hashes, sizes, texts, found in zip(*(c.to_pylist() for c in batch.columns)):
                keys, counts = strings(parted(sizes, texts))
                distinct, back = np.unique(keys, return_inverse=True)
                cost = np.empty(len(distinct))
                cost[np.argsort(part_of(distinct, parts), kind="stable")] = np.concatenate([np.frombuffer(a["costs"], np.float32) for a in found])
                bits = np.add.reduceat(cost[back], np.cumsum(counts) - counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.schema.field("ids").type.value_type), pa.array(np.frombuffer(hashes, np.int64)), pa.array(bits), pa.array(counts - 1)], names=["id", "text_hash", "bits", "n_bytes"]
                )

    joined = chunks.select("chunk", "ids", "hashes", "sizes", "texts").join(answers, "chunk")
    id_type = rows.schema["id"].dataType.simpleString()
    found = cut(joined.select("ids", "hashes", "sizes", "texts", "answers").mapInArrow(giving_back(finish), f"id {id_type}, text_hash long, bits double, n_bytes long"))
    held.destroy()
    remove(spark, folder)
    return found


def numbered_words(texts: list[bytes], parts: int) -> tuple[np.ndarray, ...]:
    """Tokens per text; each token's text and number; distinct words by number; their numbers in the order of their parts, and where parts begin."""
    words, counts = word_hashes(texts)
    n = len(texts)
    # the end of a text has a hash that no word has
    distinct, word = np.unique(np.concatenate((np.maximum(words, np.uint64(1)), np.zeros(n, np.uint64))), return_inverse=True)
    part = (distinct % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return counts + 1, np.concatenate((np.repeat(np.arange(n), counts), np.arange(n))), word, distinct, order, np.searchsorted(part[order], np.arange(parts + 1))


def baseline_scores(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word-count scores: (id, text_hash, n_tokens, n_known, train_tokens, base_score) of every row.

    Tokens are words, A-Z lower-cased, and one end per document. ``training`` says which rows are counted. With c the token's count, N all
    training tokens and V distinct ones, a token scores log10((c + 0.1) / (N + 0.1 * (V + 1))).
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(named(id_col).alias("id"), whole_text(named(text_col)).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    chunk_schema = f"ids array<{id_type}>, hashes binary, sizes binary, texts binary, part array<int>, part_words array<binary>, part_counts array<binary>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = lowered(batch.column("text"))
            learns = np.array(batch.column("training").to_pylist(), bool)
            for at, end in text_batches(texts, CHUNK_BYTES):
                n = end - at
                _, doc, word, distinct, order, cuts = numbered_words(texts[at:end], parts)
                train = np.bincount(word, learns[at + doc], len(distinct)).astype(np.int64)
                filled = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
                ids = batch.column("id").slice(at, n).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids], pa.list_(batch.schema.field("id").type)), pa.array([np.array(batch.column("text_hash").slice(at, n).to_pylist(), np.int64).tobytes()], pa.binary()),
                        pa.array([np.array([len(t) for t in texts[at:end]], np.int64).tobytes()], pa.binary()), pa.array([zlib.compress(b"".join(texts[at:end]), 1)], pa.binary()),
                        pa.array([filled], pa.list_(pa.int32())),
                        pa.array([[distinct[order[cuts[p] : cuts[p + 1]]].tobytes() for p in filled]], pa.list_(pa.binary())),
                        pa.array([[deflated(train[order[cuts[p] : cuts[p + 1]]]) for p in filled]], pa.list_(pa.binary())),
                    ],
                    names=["ids", "hashes", "sizes", "texts", "part", "part_words", "part_counts"],
                )

    folder = shared_path(spark, "chunks")
    rows.select("id", "text", "text_hash", "training").mapInArrow(giving_back(build), chunk_schema).withColumn("chunk", F.monotonically_increasing_id()).write.parquet(folder)
    chunks = spark.read.schema(chunk_schema + ", chunk long").parquet(folder)
    asked = chunks.select("chunk", F.explode(F.arrays_zip("part", "part_words", "part_counts")).alias("z")).select("chunk", "z.part", "z.part_words", "z.part_counts")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for chunk, part, words, counts in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(part, []).append((chunk, np.frombuffer(words, np.uint64), inflated(counts, np.int64)))
        for part, pieces in held.items():
            distinct, back = np.unique(np.concatenate([p[1] for p in pieces]), return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, back, np.concatenate([p[2] for p in pieces]))
            at, told = 0, []
            for _, words, _ in pieces:
                told.append(deflated(total[back[at : at + len(words)]]))
                at += len(words)
            first = np.arange(len(pieces)) == 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in pieces], pa.int64()), pa.array([part] * len(pieces), pa.int32()), pa.array(told, pa.binary()),
                    pa.array(np.where(first, total.sum(), 0)), pa.array(np.where(first, (total > 0).sum(), 0)),
                ],
                names=["chunk", "part", "totals", "n", "v"],
            )

    told = cut(asked.repartition(parts, "part").mapInArrow(giving_back(answer), "chunk long, part int, totals binary, n long, v long"))
    sums = told.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_train, distinct = sums["n"] or 0, sums["v"] or 0
    scale = float(np.log10(n_train + 0.1 * (distinct + 1)))
    answers = told.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "totals"))).alias("answers"))
    out_schema = f"id {id_type}, text_hash long, n_tokens long, n_known long, train_tokens long, base_score double"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, hashes, sizes, texts, found in zip(*(c.to_pylist() for c in batch.columns)):
                tokens, doc, word, distinct, order, _ = numbered_words(parted(sizes, texts), parts)
                c = np.empty(len(distinct), np.int64)
                c[order] = np.concatenate([inflated(a["totals"], np.int64) for a in found])
                known = np.bincount(doc, (c > 0)[word], len(ids)).astype(np.int64)
                score = np.bincount(doc, np.log10(c + 0.1)[word], len(ids)) - tokens * scale
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.schema.field("ids").type.value_type), pa.array(np.frombuffer(hashes, np.int64)), pa.array(tokens), pa.array(known), pa.array(np.full(len(ids), n_train)), pa.array(score)],
                    names=["id", "text_hash", "n_tokens", "n_known", "train_tokens", "base_score"],
                )

    joined = chunks.select("chunk", "ids", "hashes", "sizes", "texts").join(answers, "chunk")
    found = cut(joined.select("ids", "hashes", "sizes", "texts", "answers").mapInArrow(giving_back(finish), out_schema))
    remove(spark, folder)
    return found


def scores(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both scores of every row: (id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    ``score`` is the model's log10 probability of the lower-cased text with its end. Null texts count as empty. Rows that share id and text have equal scores and
    stay as many as they are. Without training rows, all counts are zero and predictions are even. An empty table gives an empty table.
    """
    slim = df.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    with short_batches(df.sparkSession):
        base, bits = baseline_scores(slim, training), mixing_scores(slim, training)
    model = bits.groupBy("id", "text_hash").agg(F.first("bits").alias("bits"), F.first("n_bytes").alias("n_bytes"))
    key = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("text_hash").cast("string"))
    joined = base.withColumn("key", key).join(model.withColumn("key", key).select("key", "bits", "n_bytes"), "key")
    return joined.select(
        "id", "n_tokens", "n_known", "train_tokens", "base_score", (-F.col("bits") * float(np.log10(2))).alias("score"), (F.col("bits") / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
