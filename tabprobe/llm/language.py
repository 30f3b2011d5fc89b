"""Language identification by error-correcting output codes.

Every language has a codeword. For each of its bits, a logistic classifier over hashed character n-grams says whether the text's
language carries a one there. A text gets the language whose codeword costs least: the logistic losses of its bits,
weighted by how well each bit's classifier knew that language in training. Texts whose two best languages cost nearly
the same are flagged.

The fit reads a bounded sample: ``per_language`` documents of each language, chosen by hash, of at most ``max_chars`` characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.llm.common import named, packed, training_fold, unpacked, whole_text
from tabprobe.llm.ngram_jaccard import mix64

OWN = ["lang_pred", "score", "ambiguous"]
UNKNOWN = "und"
BITS = 12
#: Characters whose n-grams are counted in one go.
CHUNK = 1 << 20
#: Up to so many languages, every split of them into two is a bit.
EXHAUSTIVE = 6
#: Ranges into which the hashes of ids are counted.
RANGE_BITS = 12
RANGES = 1 << RANGE_BITS


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of +1 and -1: all splits for few languages, else the best of random codes by least distance."""
    if k <= EXHAUSTIVE:
        splits = [m for m in range(1, 1 << k) if m & 1 and m != (1 << k) - 1]
        return np.array([[1 if m >> c & 1 else -1 for m in splits] for c in range(k)], np.int8).reshape(k, len(splits))
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    def distance(code: np.ndarray) -> int:
        apart = (length - code.astype(int) @ code.T.astype(int)) // 2
        return int((apart + length * np.eye(k, dtype=int)).min())

    return max((rng.choice(np.array([-1, 1], np.int8), (k, length)) for _ in range(200)), key=distance)


def features(texts: list[str]) -> np.ndarray:
    """One row of damped, unit-length counts of hashed one-, two- and three-character grams per text."""
    size = 1 << BITS
    out = np.zeros((len(texts), size), np.float32)
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and end - at < 500 and (end == at or held + len(texts[end]) <= CHUNK):
            held += len(texts[end])
            end += 1
        # a blank on both sides keeps texts apart, and marks where words begin and end
        codes = np.frombuffer("".join(f" {t.lower()} " for t in texts[at:end]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(end - at), [len(t.lower()) + 2 for t in texts[at:end]])
        total = np.zeros((end - at) * size, np.float64)
        gram = codes
        for n in (1, 2, 3):
            if n > 1:
                gram = gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
            place = (mix64(gram + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
            good = owner[: len(gram)] == owner[n - 1 :]
            total += np.bincount((owner[: len(gram)] * size + place)[good], minlength=len(total))
        rows = np.log1p(total.reshape(end - at, size))
        out[at:end] = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        at = end
    return out


@dataclass
class CodeModel:
    languages: list[str]
    weights: np.ndarray  # features + 1, bits
    trust: np.ndarray  # languages, bits

    def losses(self, texts: list[str]) -> np.ndarray:
        x = features(texts)
        f = x @ self.weights[:-1] + self.weights[-1]
        code = codewords(len(self.languages)).astype(float)
        return (np.logaddexp(0.0, -code[None, :, :] * f[:, None, :]) * self.trust[None, :, :]).sum(axis=2)

    def decide(self, texts: list[str], margin: float) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is ambiguous. Texts without letters are unknown, with score 0."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        loss = self.losses(texts)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        score = share[np.arange(len(texts)), best]
        second = np.sort(share, axis=1)[:, -2] if len(self.languages) > 1 else np.zeros(len(texts))
        lettered = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        return names, np.where(lettered, score, 0.0), ~lettered | (score - second < margin)


def fit_codes(texts: list[str], langs: list[str], rounds: int = 150) -> CodeModel:
    """All bits at once by Adam on the mean logistic loss, languages weighing the same."""
    names = sorted(set(langs))
    code = codewords(len(names))
    if len(names) == 1:
        return CodeModel(names, np.zeros(((1 << BITS) + 1, 0), np.float32), np.ones((1, 0)))
    label = np.array([names.index(x) for x in langs])
    x = np.hstack([features(texts), np.ones((len(texts), 1), np.float32)])
    y = code[label].astype(np.float32)
    weigh = (1 / np.bincount(label)[label] / len(names)).astype(np.float32)[:, None]
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        f = x @ w
        g = x.T @ (-y * weigh / (1 + np.exp(np.clip(y * f, -30, 30)))) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    right = (y * (x @ w) > 0).astype(float)
    trust = np.array([right[label == c].mean(axis=0) for c in range(len(names))])
    trust /= np.maximum(trust.sum(axis=1, keepdims=True), 1e-9)
    return CodeModel(names, w, trust * code.shape[1])


def held_out(doc_id: Column) -> Column:
    return training_fold(doc_id, 4) == 2


def smallest_hashes(rows: DataFrame, n: int) -> DataFrame:
    """Of each language, the n rows (doc_id, text, lang) whose ids have the smallest hashes; ties go by doc_id and the text's hash.

    Counts per language and range of hashes say how far the n rows reach, so that no task gets a language: only rows up to there are ranked, without
    their texts, and the texts of the n that stay are fetched last. Counts, ranges and keys are small: ``RANGES`` rows, one, and n per language.
    """
    mark = F.xxhash64("doc_id")
    keys = rows.select("lang", "doc_id", mark.alias("mark"), F.shiftright(mark, 64 - RANGE_BITS).alias("range"), F.xxhash64("text").alias("content"))
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = keys.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("n"))
    reach = counts.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("begin") < n)
    reach = reach.groupBy("lang").agg(F.max("range").alias("last"))
    order = ["mark", "doc_id", "content"]
    near = keys.join(F.broadcast(reach), "lang").where(F.col("range") <= F.col("last"))
    first = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= n)
    chosen = first.select(F.col("lang").alias("c_lang"), F.col("doc_id").alias("c_doc_id"), F.col("content").alias("c_content")).distinct()
    same = (F.col("lang") == F.col("c_lang")) & (F.xxhash64("text") == F.col("c_content")) & F.col("doc_id").eqNullSafe(F.col("c_doc_id"))
    fetched = rows.join(F.broadcast(chosen), same, "left_semi")
    # rows repeated beyond n count once each, as they would in one sort of all
    place = F.row_number().over(Window.partitionBy("lang").orderBy(mark, "doc_id", F.xxhash64("text")))
    return fetched.withColumn("place", place).where(F.col("place") <= n).drop("place")


def fit(docs: DataFrame, *, fold: Column | None = None, per_language: int = 600, max_chars: int = 40_000) -> CodeModel:
    """Fit on documents (doc_id, text, lang) for which ``fold`` holds. Null languages and texts without a letter teach nothing.

    Repeated rows teach repeatedly; without any row there is a model without languages.
    """
    rows = docs.select("doc_id", whole_text(F.col("text")).alias("text"), "lang").where(F.col("lang").isNotNull())
    rows = (rows if fold is None else rows.where(fold)).where((F.length("text") <= max_chars) & F.col("text").rlike(r"\p{L}"))
    sample = smallest_hashes(rows, per_language)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if frames:
            found = pd.concat(frames, ignore_index=True).sort_values(["lang", "doc_id", "text"])
            model = fit_codes(found["text"].tolist(), found["lang"].tolist())
            yield pd.DataFrame({"languages": [model.languages], "weights": [model.weights.tobytes()], "trust": [model.trust.tobytes()]})

    row = sample.repartition(1).mapInPandas(train, "languages array<string>, weights binary, trust binary").collect()
    if not row:
        return CodeModel([], np.zeros(((1 << BITS) + 1, 0), np.float32), np.zeros((0, 0)))
    names = list(row[0]["languages"])
    bits = codewords(len(names)).shape[1]
    return CodeModel(names, np.frombuffer(row[0]["weights"], np.float32).reshape((1 << BITS) + 1, bits), np.frombuffer(row[0]["trust"], np.float64).reshape(len(names), bits))


def identify(df: DataFrame, model: CodeModel, text_col: str = "text", *, carry: list[str] | None = None, margin: float = 0.6) -> DataFrame:
    """Add ``lang_pred``, ``score`` (share of the best language, 0 to 1) and ``ambiguous``; they replace input columns of the same name.

    Null texts and texts without letters are ``und``, with score 0. Without languages to learn, all are. Repeated rows stay, an empty
    table stays empty, and of languages that cost the same the first by name is told. No shuffle.
    """
    carry = df.columns if carry is None else carry

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            parts = [model.decide(texts.iloc[at : at + 2000].tolist(), margin) for at in range(0, len(texts), 2000)]
            yield pd.DataFrame({
                "lang_pred": [x for p in parts for x in p[0]], "score": np.concatenate([p[1] for p in parts] or [np.zeros(0)]),
                "ambiguous": np.concatenate([p[2] for p in parts] or [np.zeros(0, bool)]),
            })

    told = F.pandas_udf(run, "lang_pred string, score double, ambiguous boolean")
    rows = df.select(packed(df, carry).alias("row"), whole_text(named(text_col)).alias("text")).withColumn("told", told("text"))
    return rows.select(*unpacked("row", carry, OWN), *[F.col("told")[c].alias(c) for c in OWN])
