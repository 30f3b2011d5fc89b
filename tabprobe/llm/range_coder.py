"""An adaptive context-mixing range coder for token ids, many blocks at a time.

Ids are coded in blocks that know nothing of each other: each block starts with a fresh model, lists the different ids it holds, and
carries checksums of its bytes and of its ids. Blocks of one call are coded in step, one id of every block at a time, so that numpy's
loops run over blocks while each block stays a plain sequence.

The model of a block, over the places of its ids in its own list:

* order 2: a slot per hash of the last two ids, holding the id that came next and how often that held;
* order 1: the same by the last id alone;
* order 0: how often each id came, brought up to date at fixed steps.

Whether order 2's id comes next is decided by a logistic mixture: hit rates of its slot's confidence, of order 1's confidence
and agreement, and order 0's share of the id are stretched, weighted and squashed; weights and rates learn from every id. If it misses,
order 1's id gets a share by its own confidence, and order 0 the rest. All arithmetic is on integers, so that every machine decodes
what any other has written. One interval per id goes into a carry-less range coder of 64 bits, which puts out 16 at a time.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Ids per block, and blocks coded in step.
BLOCK, LANES = 4096, 2048
SLOT_BITS = 12
MAGIC = b"TCM1"
#: magic, ids, first position, different ids, bytes of the id list, of the directory and of the code, checksum of the ids
HEAD = struct.Struct("<4sIQIIIII")

#: Logistic scale: 1/256 steps up to 2047, probabilities of 16 bits.
_SQUASH = np.array([min(65472, max(64, round(65536 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int64)
_STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], np.int64)
#: A slot's next confidence: after a miss (halved, or a new id's first), after a hit.
_CONFIDENCE = np.array([1, 1, *[c // 2 for c in range(2, 16)], *range(1, 16), 15], np.int64)
_TOP = np.uint64(1 << 48)
_LOW = np.uint64((1 << 48) - 1)
_ONE, _WORD, _HALF, _REST = np.uint64(1), np.uint64(16), np.uint64(32), np.uint64(48)
_MOST = np.uint64((1 << 32) - 1)


class _Model:
    """State of all lanes, longest block first; flat tables, of which a lane owns a stretch.

    A slot is place of an id * 16 + confidence. Per lane, 48 hit rates by confidence: of order 2's id, of the same by order 1's
    confidence, and of order 1's id after a miss; and three weights, by whether both orders name the same id.
    """

    def __init__(self, sizes: np.ndarray):
        n = len(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.sizes, self.starts, self.n = sizes, starts, n
        lane = np.arange(n, dtype=np.int64)
        self.slots = np.zeros((n << SLOT_BITS) + int(sizes.sum()), np.int64)
        self.two, self.one = lane << SLOT_BITS, (n << SLOT_BITS) + starts
        by_confidence = np.array([65536 * (c + 1) // (c + 3) for c in range(16)], np.int64)
        self.rates = np.tile(np.concatenate([by_confidence, by_confidence, by_confidence // 2]), n)
        self.of_rates = np.stack([lane * 48, lane * 48 + 16])
        self.weights = np.tile(np.array([40000, 40000, 20000, 20000, 10000, 10000], np.int64), n)
        self.of_weights = np.stack([lane * 6, lane * 6 + 2, lane * 6 + 4])
        self.times = np.ones(int(sizes.sum()), np.int64)
        self.last = self.before = np.zeros(n, np.int64)
        self.refresh()
        self.keep(n)

    def refresh(self) -> None:
        """Bring order 0 up to date."""
        self.counted = self.times.copy()
        self.sums = np.concatenate([[0], np.cumsum(self.times)])
        self.base = self.sums.take(self.starts)
        self.total = self.sums.take(self.starts + self.sizes) - self.base

    def keep(self, n: int) -> None:
        """Go on with the first ``n`` lanes."""
        for name in ("sizes", "starts", "two", "one", "of_rates", "of_weights", "last", "before", "base", "total"):
            setattr(self, name, getattr(self, name)[..., :n])
        self.n = n
        self.at, self.of = np.empty((2, n), np.int64), np.empty((3, n), np.int64)
        self.inputs, self.target = np.empty((3, n), np.int64), np.empty((3, n), np.int64)

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shares, of 2^32, of order 2's id and of order 1's, and of one count of order 0."""
        at, of, inputs = self.at, self.of, self.inputs
        np.add(self.two, (self.before * 0x2F0B4C47 + self.last * 0x1E3779B1 >> 12) & (1 << SLOT_BITS) - 1, out=at[0])
        np.add(self.one, self.last, out=at[1])
        self.slot = self.slots.take(at)
        self.ids, self.sure = self.slot >> 4, self.slot & 15
        self.differ = self.ids[0] != self.ids[1]
        np.add(self.of_rates, self.sure, out=of[:2])
        np.add(of[1], 16, out=of[2])
        self.rate = self.rates.take(of)
        inputs[:2] = _STRETCH.take(self.rate[:2] >> 4)
        share = (self.counted.take(self.starts + self.ids[0]) << 12) // self.total
        inputs[2] = _STRETCH.take(share, mode="clip")
        self.of_weight = self.of_weights + self.differ
        self.weight = self.weights.take(self.of_weight)
        dot = (self.weight * inputs).sum(0) >> 16
        self.chance = _SQUASH.take(dot + 2047, mode="clip")
        first = self.chance << 16
        rest = (1 << 32) - first
        second = (rest >> 16) * self.rate[2] * self.differ
        return first, second, (rest - second) // self.total

    def learn(self, symbol: np.ndarray, place: np.ndarray, same: np.ndarray) -> None:
        """``same``: whether the id is the one that order 2 named, and order 1."""
        hit = same[0]
        np.multiply(hit, 65535, out=self.target[:2])
        np.multiply(same[1], 64448, out=self.target[2])
        self.target[2] += 64
        step = self.target - self.rate >> 4
        step[2] *= self.differ & ~hit
        self.rates[self.of] = self.rate + step
        self.weights[self.of_weight] = self.weight + (self.inputs * (self.target[0] - self.chance) >> 15)
        kept = np.where(same | (self.sure > 1), self.ids, symbol)
        self.slots[self.at] = (kept << 4) + _CONFIDENCE.take(self.sure + (same << 4))
        self.times[place] = self.times.take(place) + 2
        self.before, self.last = self.last, symbol


def _refreshes(step: int) -> bool:
    return step % 256 == 0 or (step >= 16 and step & step - 1 == 0)


def _lane_order(lengths: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Blocks by falling length, and stretches of steps (from, to, lanes) with the same lanes."""
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths, stretches, at = lengths[order], [], 0
    for stop in np.unique(lengths).tolist():
        if stop > at:
            stretches.append((at, stop, int((sorted_lengths >= stop).sum())))
            at = stop
    return order, stretches


def _encode(symbols: list[np.ndarray], sizes: np.ndarray) -> list[bytes]:
    order, stretches = _lane_order(np.array([len(s) for s in symbols], np.int64))
    model = _Model(sizes[order])
    low, width = np.zeros(len(order), np.uint64), np.full(len(order), (1 << 64) - 1, np.uint64)
    lanes_out, words_out = [], []
    for start, stop, n in stretches:
        model.keep(n)
        lo, wide = low[:n], width[:n]
        for step in range(start, stop):
            if (step - start) % 256 == 0:
                columns = np.array([symbols[k][step : min(step + 256, stop)] for k in order[:n]], np.int64).T.copy()
            symbol = columns[(step - start) % 256]
            first, second, unit = model.predict()
            same = model.ids == symbol
            place = model.starts + symbol
            below = np.where(same[1], first, first + second + unit * (model.sums.take(place) - model.base))
            below *= ~same[0]
            share = np.where(same[0], first, np.where(same[1], second, unit * model.counted.take(place)))
            part = wide >> _HALF
            lo += part * below.view(np.uint64)
            np.multiply(part, share.view(np.uint64), out=wide)
            rows = np.flatnonzero(wide < _TOP)
            while len(rows):
                x, y = lo.take(rows), wide.take(rows)
                # an interval across a border of the first word gives up what lies beyond it
                y = np.where((x ^ (x + y)) < _TOP, y, (~x + _ONE) & _LOW) << _WORD
                lanes_out.append(rows)
                words_out.append((x >> _REST).astype("<u2"))
                lo[rows], wide[rows] = x << _WORD, y
                rows = rows[y < _TOP]
            model.learn(symbol, place, same)
            if _refreshes(step + 1):
                model.refresh()
    # one more word names a number inside the last interval; zeros follow
    lanes_out.append(np.arange(len(order)))
    words_out.append(((low + _LOW) >> _REST).astype("<u2"))
    lanes, words = np.concatenate(lanes_out), np.concatenate(words_out)
    words = words[np.argsort(lanes, kind="stable")]
    stops = np.cumsum(np.bincount(lanes, minlength=len(order)))
    out = [b""] * len(order)
    for k, s, e in zip(order.tolist(), [0, *stops.tolist()], stops.tolist()):
        out[k] = words[s:e].tobytes()
    return out


def _decode(codes: list[bytes], lengths: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    order, stretches = _lane_order(lengths)
    model = _Model(sizes[order])
    tail = b"\0" * 16
    padded = [codes[k] + tail for k in order]
    words = np.frombuffer(b"".join(padded), "<u2").astype(np.uint64)
    ends = np.cumsum([len(p) // 2 for p in padded])
    at, final = np.concatenate([[0], ends[:-1]]).astype(np.int64), ends - 1
    code = np.zeros(len(order), np.uint64)
    for _ in range(4):
        code = code << _WORD | words[at]
        at = at + 1
    low, width = np.zeros(len(order), np.uint64), np.full(len(order), (1 << 64) - 1, np.uint64)
    found = np.zeros((int(lengths.max()) if len(lengths) else 0, len(order)), np.int32)
    for start, stop, n in stretches:
        model.keep(n)
        lo, wide, num, pos, end = low[:n], width[:n], code[:n], at[:n], final[:n]
        for step in range(start, stop):
            first, second, unit = model.predict()
            part = wide >> _HALF
            value = np.minimum((num - lo) // part, _MOST).astype(np.int64)
            hit = value < first
            both = first + second
            symbol = np.where(hit, *model.ids)
            below, share = np.where(hit, 0, first), np.where(hit, first, second)
            rows = np.flatnonzero(value >= both)
            if len(rows):
                base = model.base[rows]
                inside = np.minimum((value[rows] - both[rows]) // unit[rows], model.total[rows] - 1)
                spot = np.searchsorted(model.sums, base + inside, side="right") - 1
                symbol[rows] = spot - model.starts[rows]
                below[rows] = both[rows] + unit[rows] * (model.sums.take(spot) - base)
                share[rows] = unit[rows] * model.counted.take(spot)
            found[step, :n] = symbol
            lo += part * below.view(np.uint64)
            np.multiply(part, share.view(np.uint64), out=wide)
            rows = np.flatnonzero(wide < _TOP)
            while len(rows):
                x, y = lo.take(rows), wide.take(rows)
                y = np.where((x ^ (x + y)) < _TOP, y, (~x + _ONE) & _LOW) << _WORD
                lo[rows], wide[rows] = x << _WORD, y
                next_word = pos.take(rows)
                num[rows] = num.take(rows) << _WORD | words.take(np.minimum(next_word, end.take(rows)))
                pos[rows] = next_word + 1
                rows = rows[y < _TOP]
            model.learn(symbol, model.starts + symbol, model.ids == symbol)
            if _refreshes(step + 1):
                model.refresh()
    out = [np.zeros(0, np.int64)] * len(order)
    for lane, k in enumerate(order.tolist()):
        out[k] = found[: lengths[k], lane].astype(np.int64)
    return out


@dataclass
class Block:
    """Ids from position ``first`` of a file on, and the documents they belong to: the ordinal of the first one in the file,
    each one's id (or None) and how many of the block's ids are its own."""

    first: int
    ids: np.ndarray
    ordinal: int
    doc_ids: list[int | None]
    lengths: list[int]


def _local(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in ascending order, and each id's place among them."""
    if len(ids) and ids.max() >= 1 << 17:
        return np.unique(ids, return_inverse=True)
    there = np.zeros(int(ids.max(initial=0)) + 1, bool)
    there[ids] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1).astype(np.int32)[ids]


def encode_blocks(blocks: Sequence[Block]) -> list[bytes]:
    """Each block as bytes; blocks without ids are not allowed."""
    local = [_local(b.ids) for b in blocks]
    codes = []
    for s in range(0, len(blocks), LANES):
        codes += _encode([x for _, x in local[s : s + LANES]], np.array([len(a) for a, _ in local[s : s + LANES]], np.int64))
    out = []
    for block, (known, _), code in zip(blocks, local, codes):
        listed = zlib.compress(np.diff(known, prepend=0).astype("<u4" if known.max(initial=0) >= 1 << 16 else "<u2").tobytes(), 6)
        ids = np.array([0 if d is None else d for d in block.doc_ids], "<i8")
        directory = zlib.compress(
            struct.pack("<QI", block.ordinal, len(ids)) + np.array(block.lengths, "<u4").tobytes() + np.diff(ids, prepend=np.int64(0)).astype("<i8").tobytes()
            + bytes([d is None for d in block.doc_ids]), 6)
        check = zlib.crc32(block.ids.astype("<u4").tobytes())
        body = HEAD.pack(MAGIC, len(block.ids), block.first, len(known), len(listed), len(directory), len(code), check) + listed + directory + code
        out.append(body + struct.pack("<I", zlib.crc32(body)))
    return out


def decode_blocks(payloads: Sequence[bytes]) -> list[Block]:
    """The blocks again; bytes that were changed are an error."""
    heads, parts = [], []
    for p in payloads:
        if len(p) < HEAD.size + 4 or p[:4] != MAGIC or zlib.crc32(p[:-4]) != struct.unpack("<I", p[-4:])[0]:
            raise ValueError("a block's bytes do not agree with their checksum")
        head = HEAD.unpack_from(p)
        _, _, _, n_known, n_listed, n_directory, n_code, _ = head
        at = HEAD.size
        listed, directory, code = p[at : at + n_listed], p[at + n_listed : at + n_listed + n_directory], p[at + n_listed + n_directory : -4]
        steps = zlib.decompress(listed)
        known = np.cumsum(np.frombuffer(steps, "<u4" if n_known and len(steps) // n_known == 4 else "<u2"), dtype=np.int64)
        heads.append(head)
        parts.append((known, zlib.decompress(directory), code))
    out = []
    for s in range(0, len(heads), LANES):
        some, lengths = parts[s : s + LANES], np.array([h[1] for h in heads[s : s + LANES]], np.int64)
        symbols = _decode([c for _, _, c in some], lengths, np.array([len(k) for k, _, _ in some], np.int64))
        for head, (known, directory, _), places in zip(heads[s : s + LANES], some, symbols):
            ids = known[places]
            if zlib.crc32(ids.astype("<u4").tobytes()) != head[7]:
                raise ValueError("a block's ids do not agree with their checksum")
            ordinal, n = struct.unpack_from("<QI", directory)
            doc_lengths = np.frombuffer(directory, "<u4", n, 12).tolist()
            doc_ids = np.cumsum(np.frombuffer(directory, "<i8", n, 12 + 4 * n), dtype=np.int64).tolist()
            nulls = directory[12 + 12 * n :]
            out.append(Block(head[2], ids, ordinal, [None if z else d for d, z in zip(doc_ids, nulls)], doc_lengths))
    return out
