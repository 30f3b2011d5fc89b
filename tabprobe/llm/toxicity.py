"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in the sum of its words'
weights; the document's is their noisy-or, one minus the product of the
sentences' complements. Only documents carry labels, so the gradient reaches each
sentence through the noisy-or, which lets the fit find by itself which sentences offend. Words are
hashed whole and by their first four, five and six letters.

The fit reads a bounded sample of labelled rows (``per_label`` of each label, chosen by hash, of at most ``max_chars``
characters each) and weighs it back to the labels' true shares; everything else covers all rows and whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, expm1, log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import named, packed, small, training_fold, unpacked, whole_text

OWN = ["score", "predicted", "offending"]
BITS = 17
#: A stretch without sentence ends is read in pieces of so many words.
PIECE_WORDS = 40
SENTENCE, WORD = re.compile(r"[^.!?\n]+"), re.compile(r"\w+")


def features(word: str) -> list[int]:
    mask = (1 << BITS) - 1
    parts = ["=" + word, *("^" + word[:n] for n in (4, 5, 6) if len(word) >= n)]
    return [zlib.crc32(p.encode()) & mask for p in parts]


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of every piece; a text without words is one piece without words."""
    found = False
    for m in SENTENCE.finditer(text):
        words = WORD.findall(m[0].lower())
        if 0 < len(words) <= PIECE_WORDS:
            found = True
            yield m.start(), m.end(), words
        elif words:
            found = True
            spans = list(WORD.finditer(m[0]))
            for i in range(0, len(spans), PIECE_WORDS):
                part = spans[i : i + PIECE_WORDS]
                yield m.start() + part[0].start(), m.start() + part[-1].end(), [w[0].lower() for w in part]
    if not found:
        yield 0, len(text), []


class WordWeights(dict):
    """A word's weight, the sum over its features; remembers words, and starts anew when it holds very many."""

    def __init__(self, weights: np.ndarray, most: int = 500_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float:
        if len(self) > self.most:
            self.clear()
        value = self[word] = float(self.weights[features(word)].sum())
        return value


@dataclass
class NoisyOr:
    bias: float
    weights: np.ndarray

    def __post_init__(self):
        self.words = WordWeights(self.weights)

    def judge(self, text: str, least: float) -> tuple[float, list[tuple[int, int, float]]]:
        """Probability of the text and the pieces of at least the given probability."""
        clean, pieces, value, bias, bound = 0.0, [], self.words.__getitem__, self.bias, log(least / (1 - least))
        for start, end, words in sentences(text):
            z = bias + sum(map(value, set(words)))
            clean -= z + log1p(exp(-z)) if z > 0 else log1p(exp(z))
            if z >= bound:
                pieces.append((start, end, 1 / (1 + exp(-z))))
        return -expm1(clean), pieces


def association(words, bags, feature, holder, positive, size, n_words) -> np.ndarray:
    """Likelihood ratio statistic of every feature with the label, over documents."""
    if not len(words):
        return np.zeros(size)
    seen = np.unique(bags * n_words + words)
    bag, word = seen // n_words, seen % n_words
    counts = np.bincount(holder, minlength=n_words)
    starts = np.cumsum(counts) - counts
    many = counts[word]
    at = np.repeat(starts[word], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    pairs = np.unique(np.repeat(bag, many) * size + feature[at])
    bag, hit = pairs // size, pairs % size
    a = np.bincount(hit, positive[bag], size)
    b = np.bincount(hit, ~positive[bag], size)
    yes, no = positive.sum(), (~positive).sum()
    total = np.zeros(size)
    for seen_in, of in ((a, yes), (b, no)):
        for n, margin in ((seen_in, a + b), (of - seen_in, yes + no - a - b)):
            expected = margin * of / (yes + no)
            total += 2 * n * np.log(np.maximum(n, 1e-9) / np.maximum(expected, 1e-9))
    return total


def fit_bags(texts: list[str], labels: np.ndarray, weights: np.ndarray, rounds: int = 80, evidence: float = 20.0) -> NoisyOr:
    """Adam on the weighted log loss of the noisy-or.

    A feature whose documents differ by label less than ``evidence`` (likelihood ratio statistic) stays at zero.
    """
    ids: dict[str, int] = {}
    words, piece_ends, bag_ends = [], [], []
    for text in texts:
        for _, _, found in sentences(text):
            words.extend(ids.setdefault(w, len(ids)) for w in sorted(set(found)))
            piece_ends.append(len(words))
        bag_ends.append(len(piece_ends))
    words = np.array(words, np.int64)
    pieces_of = np.repeat(np.arange(len(piece_ends)), np.diff([0, *piece_ends]))
    bags_of = np.repeat(np.arange(len(bag_ends)), np.diff([0, *bag_ends]))
    made = [features(w) for w in ids]
    feature, holder = np.array([f for m in made for f in m], np.int64), np.repeat(np.arange(len(made)), [len(m) for m in made])
    size, n_words = 1 << BITS, max(1, len(ids))
    positive = labels > 0
    common = association(words, bags_of[pieces_of], feature, holder, positive, size, n_words) >= evidence
    w, b = np.zeros(size), -5.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    weights = weights / weights.sum()
    for step in range(1, rounds + 1):
        value = np.bincount(holder, w[feature], n_words)
        z = b + np.bincount(pieces_of, value[words], len(piece_ends))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(bags_of, -np.logaddexp(0.0, z), len(bag_ends))
        toxic = np.maximum(-np.expm1(clean), 1e-6)
        pull = np.where(positive, -np.exp(clean) / toxic, 1.0) * weights
        gz = pull[bags_of] * p
        gw = np.bincount(feature, np.bincount(words, gz[pieces_of], n_words)[holder], size) * common + 2e-6 * w
        gb = gz.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= 0.1 * fix * m / (np.sqrt(v) + 1e-9)
        b -= 0.1 * fix * mb / (np.sqrt(vb) + 1e-9)
    return NoisyOr(float(b), w.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, *, fold: Column | None = None, per_label: int = 2500, max_chars: int = 60_000) -> NoisyOr:
    """Fit on documents (doc_id, text) with labels (doc_id, toxic).

    Only labels for which ``fold`` holds are used. A document labelled more than once counts as toxic if any label
    says so; null labels and null ids teach nothing. Without labels of both kinds the model is constant, at the share seen.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    marks = (marks if fold is None else marks.where(fold)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        share = 0.5 if not shares else 0.01 if False in shares else 0.99
        return NoisyOr(float(np.log(share / (1 - share))), np.zeros(1 << BITS, np.float32))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    taken = marks.where("toxic").orderBy(*order).limit(per_label).unionByName(marks.where("NOT toxic").orderBy(*order).limit(per_label))
    sample = (
        docs.select("doc_id", whole_text(F.col("text")).alias("text"))
        .where(F.length("text") <= max_chars)
        .join(small(taken, 2 * per_label), "doc_id")
    )

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = list(batches)
        rows = pd.concat(found, ignore_index=True).drop_duplicates() if found else None
        if rows is None or rows["toxic"].nunique() < 2:
            # the labels' documents are missing: the labels' own share
            model = NoisyOr(float(np.log(shares[True] / shares[False])), np.zeros(1 << BITS, np.float32))
        else:
            rows = rows.sort_values(["doc_id", "text"])
            labels_of = rows["toxic"].to_numpy(bool)
            weigh = np.where(labels_of, shares[True] / labels_of.sum(), shares[False] / (~labels_of).sum())
            model = fit_bags(rows["text"].tolist(), labels_of, weigh)
        yield pd.DataFrame({"bias": [model.bias], "weights": [model.weights.tobytes()]})

    # one task, over a sample of bounded rows and characters
    row = sample.repartition(1).mapInPandas(train, "bias double, weights binary").collect()
    if not row:
        return NoisyOr(-5.0, np.zeros(1 << BITS, np.float32))
    return NoisyOr(row[0]["bias"], np.frombuffer(row[0]["weights"], np.float32))


def score(
    df: DataFrame, model: NoisyOr, text_col: str = "text", *, carry: list[str] | None = None, threshold: float = 0.7, offending: float = 0.5,
) -> DataFrame:
    """Add ``score``, ``predicted`` (1 from the threshold on) and ``offending``: (start, end, score) of each offending sentence,
    in characters. They replace input columns of the same name. A null or empty text has the score of an empty sentence, repeated rows stay and have equal
    scores, a score equal to the threshold is over it, and an empty table stays empty. Sentences of more than ``PIECE_WORDS`` words are read in pieces. No shuffle.
    """
    carry = df.columns if carry is None else carry
    bias, weights = model.bias, model.weights

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = NoisyOr(bias, weights)
        for texts in series:
            found = [judge.judge(t, offending) for t in texts]
            yield pd.DataFrame({
                "score": [f[0] for f in found],
                "offending": [[{"start": a, "end": b, "score": p} for a, b, p in f[1]] for f in found],
            })

    judged = F.pandas_udf(run, "score double, offending array<struct<start:int,end:int,score:double>>")
    return (
        df.select(packed(df, carry).alias("row"), whole_text(named(text_col)).alias("text"))
        .withColumn("judged", judged("text"))
        .select(
            *unpacked("row", carry, OWN), F.col("judged.score").alias("score"),
            (F.col("judged.score") >= threshold).cast("int").alias("predicted"), F.col("judged.offending").alias("offending"),
        )
    )


def held_out(doc_id: Column) -> Column:
    return training_fold(doc_id, 3) == 1


def keep_clean(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that the fitted model does not reject, with the columns they came with."""
    model = fit(docs, labels, fold=~held_out(F.col("doc_id")), **how)
    rows = docs.select(packed(docs).alias("kept_row"), F.col("text").alias("text"))
    return score(rows, model, carry=["kept_row"]).where("predicted = 0").select(*unpacked("kept_row", docs.columns, []))
