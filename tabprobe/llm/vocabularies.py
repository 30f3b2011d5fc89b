"""Two public tokenizers behind one interface: texts in, one flat array of ids and the ids per text out.

Both split a text into parts that are encoded independently of each other, so a task encodes each different part once with the
library and remembers it in a table of bounded size. Texts that this module cannot split with certainty go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from itertools import chain

import numpy as np

from tabprobe.llm.bpe import byte_letters

#: Parts that a task remembers before it lets go of those that it has not used since it last did so.
REMEMBERED = 300_000


class _Parts:
    """Encoding by remembered parts. Subclasses say how a text is split and how the library encodes new parts."""

    def __init__(self, token_bytes: list[bytes], remembered: int):
        self.token_bytes = token_bytes
        self.lengths = np.array([len(b) for b in token_bytes], np.int64)
        self.kind = np.dtype("<u2" if len(token_bytes) <= 1 << 16 else "<u4")
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Parts whose tokens do not spell them: a few at most, if any.
        self.changed: set[str] = set()

    def split(self, text: str) -> list[str] | None:
        """The text's parts, or None where the library must see the whole text."""
        raise NotImplementedError

    def library(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def joinable(self, part: str) -> bool:
        """Whether the library would part it from a joinable one in front of it and a joinable one behind it."""
        raise NotImplementedError

    def one_by_one(self, parts: list[str]) -> list[list[int]]:
        return self.library(parts)

    def in_runs(self, parts: list[str]) -> list[bytes] | None:
        """Packed ids of joinable parts, encoded as one text and cut where their bytes end; None if that does not come out even."""
        text = "".join(parts)
        ids = np.array(self.library([self.unseen(text)])[0], self.kind)
        ends = np.cumsum(self.lengths[ids])
        stops = np.cumsum(list(map(len, parts)) if text.isascii() else [len(p.encode()) for p in parts])
        cuts = np.searchsorted(ends, stops)
        if len(ends) and ends[-1] == stops[-1] and (ends[cuts] == stops).all() and self.spells(text, ids.tolist()):
            data, bounds = ids.tobytes(), ((cuts + 1) * self.kind.itemsize).tolist()
            return [data[s:e] for s, e in zip([0, *bounds], bounds)]
        return None

    def learn(self, parts: list[str]) -> None:
        """Encode new parts, remember them, and note those whose ids do not spell them."""
        joined = [p for p in parts if self.joinable(p)]
        rest = [p for p in parts if not self.joinable(p)] if len(joined) < len(parts) else []
        for s in range(0, len(joined), 2000):
            run = joined[s : s + 2000]
            found = self.in_runs(run)
            if found is None:
                rest += run
            else:
                self.known.update(zip(run, found))
        for part, ids in zip(rest, self.one_by_one(rest) if rest else []):
            self.known[part] = np.array(ids, self.kind).tobytes()
            if not self.spells(part, ids):
                self.changed.add(part)

    def spelt(self, ids: Sequence[int]) -> bytes:
        return b"".join([self.token_bytes[i] for i in ids])

    def spells(self, part: str, ids: Sequence[int]) -> bool:
        return self.spelt(ids) == part.encode()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ids per text, and whether each text's tokens spell it byte by byte."""
        split = [self.split(t) for t in texts]
        if len(self.known) > self.remembered:
            # what is still in use moves over from the older half
            self.older, self.known = self.known, {}
        new = set(chain.from_iterable(p for p in split if p)) - self.known.keys()
        if self.older:
            used = new & self.older.keys()
            self.known.update(zip(used, map(self.older.__getitem__, used)))
            new -= used
        if new:
            self.learn(list(new))
        whole = [t for t, parts in zip(texts, split) if parts is None]
        whole_ids = iter(self.library(whole) if whole else [])
        out, exact = [], []
        for text, parts in zip(texts, split):
            if parts is None:
                ids = next(whole_ids)
                out.append(np.array(ids, self.kind).tobytes())
                exact.append(self.spells(self.seen(text), ids))
            else:
                out.append(b"".join(map(self.known.__getitem__, parts)))
                exact.append(not self.changed or self.changed.isdisjoint(parts))
        counts = np.array([len(o) for o in out], np.int64) // self.kind.itemsize
        return np.frombuffer(b"".join(out), self.kind), counts, np.array(exact, bool)

    def seen(self, text: str) -> str:
        """What the tokens of a whole text should spell."""
        return text

    def unseen(self, text: str) -> str:
        """What the library is given for tokens that spell this."""
        return text


class ByteLevel(_Parts):
    """Byte-level BPE from a tokenizer file. With ``plain_specials``, special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str, plain_specials: bool = False, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        to_byte = {letter: b for b, letter in enumerate(byte_letters())}
        names = {i: bytes(to_byte[x] for x in t) for t, i in spec["model"]["vocab"].items()}
        added = {t["id"]: t["content"] for t in spec["added_tokens"]}
        names |= {i: t.encode() for i, t in added.items()}
        super().__init__([names.get(i, b"") for i in range(max(names) + 1)], remembered)
        self.marks = [] if plain_specials else list(added.values())
        # Splitting as the file has it, for the oldest Unicode blocks, where all versions agree on letters and numbers.
        letters, numbers = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^\\s{letters}{numbers}]+|\\s+(?!\\S)|\\s+")
        self.plain = re.compile(r"[\t-\r\x20-~¡-ɏ‐-‧€]*")
        self.word = re.compile(f" [{letters}]+")

    def joinable(self, part: str) -> bool:
        return self.word.fullmatch(part) is not None

    def split(self, text: str) -> list[str] | None:
        if self.plain.fullmatch(text) and not any(m in text for m in self.marks):
            return self.words.findall(text)
        return None

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces(_Parts):
    """A piece model that adds a space in front and whose pieces hold spaces only at their start; its tokens spell space + text."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        spelt = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        super().__init__(spelt, remembered)
        self.space = pieces.index("▁")
        #: Whether words can be encoded one by one: no piece has a space behind another character.
        self.by_words = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.encode("a b") == [*self.model.encode("a"), *self.model.encode("b")]
        self.words = re.compile(" +[^ ]*")

    def seen(self, text: str) -> str:
        return " " + text

    def split(self, text: str) -> list[str] | None:
        # The space's own sign in a text reads as a space; NUL ends strings in some versions of the library.
        if self.by_words and "▁" not in text and "\0" not in text:
            return self.words.findall(" " + text) if text else []
        return None

    def unseen(self, text: str) -> str:
        return text[1:]

    def joinable(self, part: str) -> bool:
        return True

    def one_by_one(self, parts: list[str]) -> list[list[int]]:
        # The library adds the first space itself, but nothing to an empty text.
        return [ids or [self.space] for ids in self.library([p[1:] for p in parts])]

    def library(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)
