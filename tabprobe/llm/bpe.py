"""BPE encoding by speculation and verification.

A word's tokens are first guessed by greedy longest match. A sequence of tokens is what merging by rank
would give if and only if merging the text of every two neighbours gives just these two: merges
only meet at the border of two tokens through the pieces on the left token's right edge and
on the right token's left edge, each of which exists for a known span of ranks. So numpy tests all
neighbours of all new words of a batch at once, and only words with a failing pair go through
merging step by step. Words repeat, so each task keeps the encoded ones (a bounded
table that starts anew when full).

Normalisation and splitting follow the tokenizer's file: NFC, white space to one space, lower case;
contractions, letters, single digits, other runs. Texts with characters outside the oldest Unicode blocks are
split by the library's own normaliser and splitter, so that its Unicode tables decide.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import packed, named, unpacked, whole_text

OWN = ["n_tokens", "ids", "tokens"]
#: Words whose encoding a task remembers.
REMEMBERED = 700_000
NEVER = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class _Lengths(dict):
    """By the next three letters, the lengths of the pieces that may match there, longest first."""

    def __init__(self, pieces: dict[str, int], known: dict[str, list[int]]):
        super().__init__(known)
        self.pieces = pieces

    def __missing__(self, start: str) -> list[int]:
        found = self[start] = [n for n in (2, 1) if n <= len(start) and start[:n] in self.pieces]
        return found


class Vocabulary:
    """Ids, merges and, for each token, its two parts and the rank that makes it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.letters = byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        n = max(self.names) + 1
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.made = np.full(n, -1, np.int64)
        self.rank: dict[int, int] = {}
        self.result: list[int] = []
        pairs = np.empty(len(merges), np.int64)
        #: Whether every token comes from one merge, after its parts: what the pair test rests on.
        self.orderly = True
        for r, (a, b) in enumerate(merges):
            i, j, k = self.ids[a], self.ids[b], self.ids[a + b]
            self.orderly &= self.made[k] < 0 and self.made[i] < r and self.made[j] < r
            self.left[k], self.right[k], self.made[k] = i, j, r
            self.rank[i * n + j] = r
            self.result.append(k)
            pairs[r] = i * n + j
        self.n, order = n, np.argsort(pairs)
        self.pairs, self.pair_rank = pairs[order], order.astype(np.int64)
        self.pieces = {t.removesuffix(self.end) + "\n" * t.endswith(self.end): i for t, i in self.ids.items()}
        #: Lengths of the pieces that begin with up to three given letters, longest first.
        starts: dict[str, set[int]] = {}
        for piece in self.pieces:
            starts.setdefault(piece[:3], set()).add(len(piece))
        for start in list(starts):
            for shorter in (start[:1], start[:2]):
                if len(shorter) < len(start) and shorter in self.pieces:
                    starts[start].add(len(shorter))
        self.lengths = _Lengths(self.pieces, {k: sorted(v, reverse=True) for k, v in starts.items()})
        self.sound = self._sound()

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For every pair, whether no merge across its border comes first (before rank ``until``, if given)."""
        good = np.ones(len(a), bool)
        end = np.full(len(a), NEVER) if until is None else until
        rows = np.arange(len(a))
        x, x_gone = a.copy(), end.copy()
        while len(rows):  # down the right edge of the left token
            y, y_gone, here = b[rows].copy(), end[rows].copy(), np.arange(len(rows))
            while len(here):  # down the left edge of the right token
                xs, r = x[here], self._rank_of(x[here], y)
                # equal ranks merge from the left: inside the left token first, inside the right one last
                across = (r < NEVER) & (r > self.made[xs]) & (r > self.made[y]) & (r < x_gone[here])
                across &= np.where(y_gone < end[rows[here]], r <= y_gone, r < y_gone)
                good[rows[here[across]]] = False
                more = self.left[y] >= 0
                here, y_gone, y = here[more], self.made[y[more]], self.left[y[more]]
            more = (self.right[x] >= 0) & good[rows]
            rows, x_gone, x = rows[more], self.made[x[more]], self.right[x[more]]
        return good

    def _sound(self) -> np.ndarray:
        """Tokens whose own text encodes to themselves, parts before wholes."""
        sound = self.made < 0
        merged = np.flatnonzero(self.made >= 0)
        fits = self.compatible(self.left[merged], self.right[merged], self.made[merged])
        for k, fit in sorted(zip(merged.tolist(), fits.tolist()), key=lambda x: self.made[x[0]]):
            sound[k] = fit and sound[self.left[k]] and sound[self.right[k]]
        return sound

    def greedy(self, word: str) -> list[int] | None:
        """Longest match from the left over letters and a closing line end, which the last piece must carry."""
        word += "\n"
        out, at, last, pieces, lengths = [], 0, len(word) - 1, self.pieces, self.lengths
        while at <= last:
            for n in lengths[word[at : at + 3]]:
                if at + n != last and (token := pieces.get(word[at : at + n])) is not None:
                    out.append(token)
                    at += n
                    break
            else:
                return None
        return out

    def merge(self, word: str) -> list[int]:
        """Merging by rank, leftmost first. A letter outside the vocabulary vanishes, as the library has it."""
        ids, rank, none, n = self.ids, self.rank, len(self.result), self.n
        parts = [ids[s] for s in word[:-1] if s in ids]
        if word[-1] + self.end in ids:
            parts.append(ids[word[-1] + self.end])
        ranks = [rank.get(a * n + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            lowest = min(ranks)
            if lowest == none:
                break
            i = ranks.index(lowest)
            token = self.result[lowest]
            parts[i] = token
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(token * n + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] * n + token, none)
        return parts

    def encode_words(self, words: list[str]) -> tuple[dict[str, list[int]], int]:
        """Tokens of each word (already in byte letters), and how many words had to be merged step by step."""
        guesses = [self.greedy(w) for w in words]
        lengths = np.array([len(g) if g else 0 for g in guesses], np.int64)
        flat = np.fromiter((t for g in guesses if g for t in g), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        bad = (lengths == 0) | (not self.orderly)
        np.logical_or.at(bad, owner, ~self.sound[flat])
        inside = owner[:-1] == owner[1:]
        a, b = flat[:-1][inside], flat[1:][inside]
        pairs, back = np.unique(a * self.n + b, return_inverse=True)
        fits = self.compatible(pairs // self.n, pairs % self.n)[back]
        np.logical_or.at(bad, owner[:-1][inside], ~fits)
        out = {w: self.merge(w) if wrong else g for w, g, wrong in zip(words, guesses, bad.tolist())}
        return out, int(bad.sum())


class Encoder:
    """Texts to ids, for one task."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        # the same splitting for the oldest blocks, in lower case, by the quicker standard module
        letters = "a-zªµºß-öø-ɏ"
        self.oldest = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9²³¹¼-¾]|[^\\s{letters}0-9²³¹¼-¾]+")
        self.plain = re.compile(r"[\t-\r\x20-~¡-ɏ‐-‧€]*")
        self.marks = re.compile("|".join(f"({re.escape(s)})" for s in self.vocabulary.special) or r"(?!)")
        self.known: dict[str, tuple[str, str]] = {}
        self.remembered = remembered
        self.merged = 0

    def words(self, text: str) -> list[str]:
        """Words of a stretch without special tokens; those split by the library are in byte letters, after a NUL.

        Texts with control characters go that way too, so no plain word starts with NUL or \\1.
        """
        if self.plain.fullmatch(text):
            return self.oldest.findall(text.lower())
        return ["\0" + w for w, _ in self.split(self.normalise(text))]

    def learn(self, words: set[str]) -> None:
        letters = self.vocabulary.letters
        spelt = {w: w if w.isascii() and w[0] != "\0" else w[1:] if w[0] == "\0" else "".join([letters[b] for b in w.encode()]) for w in words}
        encoded, merged = self.vocabulary.encode_words(list(dict.fromkeys(spelt.values())))
        self.merged += merged
        names = self.vocabulary.names
        for word, letters_of in spelt.items():
            ids = encoded[letters_of]
            self.known[word] = (" ".join(map(str, ids)), " ".join([names[i] for i in ids]))

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Per text: number of tokens, ids and decoded text, both joined by spaces."""
        pieces: list[list[str]] = []
        for text in texts:
            if "<|" not in text:
                pieces.append(self.words(text))
                continue
            parts, at = [], 0
            for m in self.marks.finditer(text):
                parts += [*self.words(text[at : m.start()]), "\1" + m[0]]
                at = m.end()
            pieces.append(parts + self.words(text[at:]))
        if len(self.known) > self.remembered:
            self.known = {}
        new = {w for p in pieces for w in p} - self.known.keys()
        marks = {w for w in new if w[0] == "\1" and w[1:] in self.vocabulary.special}
        self.learn(new - marks)
        for w in marks:
            self.known[w] = (str(self.vocabulary.special[w[1:]]), w[1:])
        for parts in pieces:
            found = [f for f in map(self.known.__getitem__, parts) if f[0]]
            ids = " ".join([f[0] for f in found])
            yield ids.count(" ") + bool(ids), ids, " ".join([f[1] for f in found])


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def worker_encoder(path: str, remembered: int) -> Encoder:
    """One encoder per Python worker, which serves several tasks."""
    if (path, remembered) not in _ENCODERS:
        _ENCODERS[(path, remembered)] = Encoder(path, remembered)
    return _ENCODERS[(path, remembered)]


def encode(
    df: DataFrame, vocabulary: str, text_col: str = "text", *, carry: list[str] | None = None, digests: bool = False,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """Encode and decode a text column with a vocabulary file that executors can read at ``vocabulary``.

    Adds ``n_tokens``, ``ids`` (array of int) and ``decoded`` (string), or with ``digests`` the SHA-256 of the
    ids' decimals joined by spaces and of the decoded text instead; these replace input columns of the same name. Null texts
    count as empty and have no tokens. Repeated rows give repeated rows. No shuffle.
    """
    carry = df.columns if carry is None else carry
    own = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    rows = df.select(packed(df, carry).alias("row"), whole_text(named(text_col)).alias("text"))
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = worker_encoder(vocabulary, remembered)
        for texts in series:
            out = []
            for start in range(0, len(texts), 500):
                for n, ids, decoded in coder.encode(texts.iloc[start : start + 500].tolist()):
                    if digests:
                        out.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                    else:
                        out.append((n, [int(i) for i in ids.split()], decoded))
            yield pd.DataFrame(out, columns=own)

    coded = F.pandas_udf(run, kinds)
    return rows.withColumn("coded", coded("text")).select(*unpacked("row", carry, own), *[F.col("coded")[c].alias(c) for c in own])
