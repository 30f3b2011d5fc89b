import math
import re
import zlib

import pytest
from pyspark.sql.types import StructType

#: Nulls, empty, tiny, very long and repeated texts, ties, and columns named like operators' own.
SCHEMA = StructType()
for _name, _kind in {
    "doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long", "keep_id": "string", "size": "string", "score": "string", "row": "string",
    "kept": "string", "name": "string", "key": "string",
}.items():
    SCHEMA = SCHEMA.add(_name, _kind)

LONG = "the quick brown fox jumps over the lazy dog number " + " ".join(f"word{i}" for i in range(3000))
TEXTS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu.", "en", "b"),
    (2, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa lambda mu.", "en", "a"),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda nu.", "de", None),
    (4, None, None, None),
    (5, "", "en", "a"),
    (6, "   \t\n", "", "b"),
    (7, LONG, "en", "a"),
    (8, LONG + " end", "fr", "c"),
    (9, "x", "en", "a"),
    (9, "x", "en", "a"),
    (None, "no id here at all, but some words", "es", "é"),
    (None, None, None, None),
    (10, "Ünïcode – 日本語 <|endoftext|> é́ ½ 😀 a b", "xx", "\U0001F600"),
    (11, "!!! ??? ...", "en", "a"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, lang, source, None if t is None else len(t), "k", "s", "sc", "r", "kept", "n", "key") for i, t, lang, source in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, None, 1), (2, 0, None), (None, 1, 1), (7, 1, 0), (7, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")


def plain_toxicity(model, text):
    """Score and offending pieces (start, end, score), word by word from the fitted numbers."""

    def chance(words):
        z = model.bias
        for w in set(words):
            for part in ["=" + w, *["^" + w[:n] for n in (4, 5, 6) if len(w) >= n]]:
                z += float(model.weights[zlib.crc32(part.encode()) % (1 << 17)])
        return 1 / (1 + math.exp(-z))

    clean, offending, pieces = 1.0, [], []
    for m in re.finditer(r"[^.!?\n]+", text):
        words = [(w.start(), w.end(), w[0].lower()) for w in re.finditer(r"\w+", m[0])]
        if 0 < len(words) <= 40:
            pieces.append((m.start(), m.end(), [w for *_, w in words]))
        for at in range(0, len(words) if len(words) > 40 else 0, 40):
            some = words[at : at + 40]
            pieces.append((m.start() + some[0][0], m.start() + some[-1][1], [w for *_, w in some]))
    for a, b, words in pieces or [(0, len(text), [])]:
        p = chance(words)
        clean *= 1 - p
        offending += [(a, b, p)] if p >= 0.5 else []
    return 1 - clean, offending
