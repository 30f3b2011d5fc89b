"""Toxicity, mixing, BPE, languages, fingerprints, scores and pages: brute force, round trips and held-out accuracy."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprobe.llm import bpe, context_mixing, html_extraction, language, mixing, spotsigs, toxicity
from tabprobe.llm.html_blocks import blocks
from tabprobe.llm.ngram_jaccard import mix64
from tabprobe.llm.queries import QUERIES, vocabulary_path
from tests.llm.conftest import TEXTS, plain_toxicity

rng = random.Random(11)
SF_DIR = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


# toxicity

def test_toxicity_finds_the_sentence():
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(400)]

    def text(bad):
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(rng.randint(2, 30))]
        if bad:
            at = rng.randrange(len(sentences))
            sentences[at] += " zorgblatt"
        return ". ".join(sentences) + "."

    labels = [n % 5 == 0 for n in range(400)]
    model = toxicity.fit_bags([text(b) for b in labels], np.array(labels), np.ones(400))
    for bad in (True, False):
        t = text(bad)
        score, pieces = model.judge(t, 0.5)
        assert (score >= 0.7) == bad
        assert all("zorgblatt" in t[a:b] for a, b, _ in pieces) and bool(pieces) == bad


def test_toxicity_on_odd_rows(spark, odd_docs, no_docs, odd_labels, no_labels):
    for labels in (odd_labels, no_labels):
        model = toxicity.fit(odd_docs, labels)
        found = toxicity.score(odd_docs, model).collect()
        assert len(found) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
        assert "row" in found[0].asDict() and not isinstance(found[0].score, str)
        by_text = {r.text or "": r.score for r in found}
        assert all(by_text[r.text or ""] == r.score for r in found)
    assert toxicity.keep_clean(no_docs, odd_labels).count() == 0
    assert toxicity.keep_clean(odd_docs, odd_labels).columns == odd_docs.columns


def test_toxicity_against_brute_force(spark, odd_docs, odd_labels):
    """Scores and offending sentences from the fitted numbers, piece by piece and word by word."""
    fitted = toxicity.fit(odd_docs, odd_labels)
    # large weights, so that pieces are on both sides
    own = np.random.default_rng(3).normal(0, 1.5, 1 << toxicity.BITS).astype(np.float32)
    for model in (fitted, toxicity.NoisyOr(-3.0, own)):
        for r in toxicity.score(odd_docs, model).collect():
            score, offending = plain_toxicity(model, r.text or "")
            assert r.score == pytest.approx(score, abs=1e-5) and r.predicted == (r.score >= 0.7)
            assert [(s["start"], s["end"]) for s in r.offending] == [o[:2] for o in offending]
            assert [s["score"] for s in r.offending] == pytest.approx([o[2] for o in offending], abs=2e-5)


def test_long_stretches_are_read_in_pieces():
    text = " ".join(["word"] * 1000)
    spans = list(toxicity.sentences(text))
    assert sum(len(w) for _, _, w in spans) == 1000 and text[spans[3][0] : spans[3][1]].split() == spans[3][2]


@tables
def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    found = QUERIES["op8_toxicity"](spark, SF_DIR)
    seen = found.where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    wrong = [r for r in seen if r.predicted and not r.toxic]
    assert len(wrong) <= 0.02 * len(seen) and sum(r.predicted for r in seen if r.toxic) >= 0.6 * sum(r.toxic for r in seen)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found.collect())


# mixing

def brute_targets(sizes, share=1.5, cycle=(3, 1, 2), most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: cycle[i % 3] for i, s in enumerate(names)}
    total, target, fixed = share * sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(most * sizes[s] for s in fixed)
        target = {s: most * sizes[s] if s in fixed else left * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        fixed |= over


def test_mixing_meets_targets(spark, odd_docs, no_docs):
    rows = [(i, " ".join(["w"] * rng.randrange(60)), rng.choice(["a", "a", "a", "b", "c", None, "é", "z"]), rng.choice([None, 0.5, 2.0])) for i in range(600)]
    rows += [(1000 + i, "w w w", f"s{i}", None) for i in range(5)] + [(2000, None, "empty", None), (2001, "", "empty", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double")
    found = mixing.mix(frame, quality_col="quality").collect()
    assert sorted(found, key=repr) == sorted(mixing.mix(frame.repartition(7), quality_col="quality").collect(), key=repr)
    sizes, taken = Counter(), Counter()
    for r in found:
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    target = brute_targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    # documents are taken in the order of their keys: those taken in part or less come after those taken in full
    keys = {r.doc_id: r.key for r in frame.select("doc_id", mixing.exponential_key(F.col("doc_id"), F.col("quality"), 42).alias("key")).collect()}
    for s in sizes:
        mine = sorted((r for r in found if r.source == s and r.size), key=lambda r: keys[r.doc_id])
        shares = [r.taken / r.size for r in mine]
        assert shares == sorted(shares, reverse=True)
    # better documents are taken more often
    some = [r for r in found if r.source == "a" and r.size and r.quality]
    mean = {q: np.mean([r.taken / r.size for r in some if r.quality == q]) for q in (0.5, 2.0)}
    assert mean[2.0] >= mean[0.5]
    assert mixing.mix(no_docs).count() == 0
    odd = mixing.mix(odd_docs).collect()
    assert len(odd) == len(TEXTS) and all(isinstance(r.size, int) and r.taken <= 2 * r.size for r in odd)


def test_small_buckets_change_nothing(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * (i % 17)), "ab"[i % 3 == 0], None) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, quality double")
    whole = sorted(mixing.mix(frame).collect())
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 7)
    assert sorted(mixing.mix(frame).collect()) == whole


def test_mixed_rows(spark, odd_docs, no_docs, odd_labels):
    marked = {(r.doc_id, r.text): r.copies for r in mixing.mix(odd_docs.drop("size")).collect()}
    out = mixing.mixed(odd_docs, odd_labels)
    assert out.columns == odd_docs.columns and out.count() > 0 and mixing.mixed(no_docs, odd_labels).count() == 0
    assert {(r.doc_id, r.text) for r in out.collect()} <= set(marked)


# byte-pair encoding

def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_bpe_equals_the_library(spark, odd_docs, no_docs):
    lib = library()
    found = bpe.encode(odd_docs, vocabulary_path()).collect()
    assert len(found) == len(TEXTS)
    for r in found:
        want = lib.encode(r.text or "", add_special_tokens=False)
        assert (r.n_tokens, r.ids, r.decoded) == (len(want.ids), want.ids, lib.decode(want.ids, skip_special_tokens=False))
    assert bpe.encode(no_docs, vocabulary_path()).count() == 0
    digests = bpe.encode(odd_docs, vocabulary_path(), digests=True).collect()
    assert {r.ids_sha256 for r in digests} == {hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in found}


def test_bpe_on_random_strings():
    lib, coder = library(), bpe.Encoder(vocabulary_path(), remembered=500)
    assert coder.vocabulary.orderly
    kinds = ["abcdefghijklmnop", "aaab", "äöüßéèñ ", "0123 abc'", "!?.,-'st ", "\t\n\x0b\x85\xa0  x\x00\x01", "日本語한국עב", "<|endoftext|>s", "ΑΣσς İıſﬁ"]
    texts = ["".join(rng.choice(k) for _ in range(rng.randrange(60))) for k in kinds for _ in range(120)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x2FF), rng.randrange(0x300, 0x3000), rng.randrange(0x1F300, 0x1F6FF)])) for _ in range(40)) for _ in range(300)]
    for at in range(0, len(texts), 50):
        for t, (n, ids, decoded) in zip(texts[at : at + 50], coder.encode(texts[at : at + 50])):
            want = lib.encode(t, add_special_tokens=False).ids
            assert ids == " ".join(map(str, want)), t
            assert n == len(want) and decoded == lib.decode(want, skip_special_tokens=False)


def test_pairs_tell_what_merging_tells():
    v = bpe.Vocabulary(vocabulary_path())
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    encoded, merged = v.encode_words(words)
    assert 0 < merged < len(words)
    assert all(encoded[w] == v.merge(w) for w in words)


# languages

def test_codewords_are_apart():
    for k in (2, 3, 4, 6, 9, 30):
        code = language.codewords(k).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2
        assert len(code) == k and min(apart[i, j] for i in range(k) for j in range(i)) >= (code.shape[1] // 4 if k > 3 else 1)


def test_language_on_odd_rows(odd_docs, no_docs):
    for train in (odd_docs, no_docs, odd_docs.where("lang = 'en'")):
        model = language.fit(train)
        found = language.identify(odd_docs, model).collect()
        assert len(found) == len(TEXTS)
        for r in found:
            unknown = not any(c.isalpha() for c in r.text or "") or not model.languages
            assert (r.lang_pred == "und") == unknown and 0 <= r.score <= 1 and (r.ambiguous or not unknown)
        assert language.identify(no_docs, model).count() == 0


def test_language_against_brute_force(odd_docs):
    """Features, losses of the bits, decoding and flags from the fitted numbers, a gram at a time."""
    mask = (1 << 64) - 1

    def mixed(x):
        return int(mix64(np.array([x & mask], np.uint64))[0])

    model = language.fit(odd_docs)
    k = len(model.languages)
    assert k == 5 and model.languages == sorted(model.languages)
    # all splits of five languages in two, the first on one side
    code = [[1 if split >> c & 1 else -1 for split in range(1, 1 << k, 2) if split != (1 << k) - 1] for c in range(k)]
    for r in language.identify(odd_docs, model, margin=0.3).collect():
        text = f" {(r.text or '').lower()} "
        counts = Counter()
        for n in (1, 2, 3):
            for at in range(len(text) - n + 1):
                gram = 0
                for c in text[at : at + n]:
                    gram = gram * 0x9E3779B97F4A7C15 + ord(c)
                counts[mixed(gram + n) >> 52] += 1
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
        f = [sum(math.log1p(c) / norm * float(model.weights[g, b]) for g, c in counts.items()) + float(model.weights[-1, b]) for b in range(len(code[0]))]
        loss = [sum(float(t) * math.log1p(math.exp(-c * v)) for t, c, v in zip(model.trust[i], code[i], f)) for i in range(k)]
        share = [math.exp(min(loss) - x) for x in loss]
        share = [s / sum(share) for s in share]
        best, second = sorted(share, reverse=True)[:2]
        lettered = any(c.isalpha() for c in r.text or "")
        assert r.score == pytest.approx(best if lettered else 0.0, abs=1e-4)
        assert r.lang_pred == (model.languages[share.index(best)] if lettered else "und")
        assert abs(best - second - 0.3) < 1e-3 or r.ambiguous == (not lettered or best - second < 0.3)


@pytest.mark.parametrize("n", [1, 7, 600])
def test_language_sample(spark, n):
    """Against one sort of all rows, with a hot language, ids and whole rows repeated, and null ids."""
    from pyspark.sql import Window

    rows = [(rng.choice([None, *range(150)]), rng.choice("abc"), rng.choice(["en"] * 9 + ["de", "fr"])) for _ in range(900)] + [(5, "x", "en")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5).checkpoint()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    wanted = docs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")
    key = lambda r: (r.lang, -1 if r.doc_id is None else r.doc_id, r.text)
    assert sorted(map(key, language.smallest_hashes(docs, n).collect())) == sorted(map(key, wanted.collect()))


@tables
def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang").collect()}
    found = [r for r in QUERIES["op5_language_id"](spark, SF_DIR).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in found]) > 0.97


# fingerprints

def brute_signatures(text):
    import regex

    words = regex.findall(r"[\p{L}\p{M}\p{N}]+", text.lower())
    common = set(spotsigs.ANCHORS)
    found = []
    for i, w in enumerate(words[:-1]):
        if w in common and words[i + 1] not in common:
            rest = [x for x in words[i + 1 :] if x not in common][:2]
            if len(rest) == 2:
                found.append(" ".join([w, *rest]))
    plain = [w for w in words if w not in common] or words
    room = 4 * (64 - len(set(found)))
    found += [w for w in plain if int(hashlib.md5(w.encode()).hexdigest()[:2], 16) < room]
    if not words and text:
        found = [text]
    return sorted({hashlib.md5(s.encode()).hexdigest()[:16] for s in found})


def test_fingerprints(spark, odd_docs, no_docs):
    words = spotsigs.ANCHORS[:12] + ["alpha", "beta", "ümlaut", "gamma", "delta9", "theta"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", ".", "  "]) for _ in range(rng.randrange(40)))) for i in range(300)]
    rows += [(i, t) for i, t, *_ in TEXTS]
    found = spotsigs.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.signatures == brute_signatures(r.text) for r in found)
    assert spotsigs.edit_likeness(no_docs).count() == 0
    odd = spotsigs.edit_likeness(odd_docs).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in odd)


def test_few_chains_do_not_hide_an_edit(spark):
    """Texts of no, one, or some chains that gain or lose a few by the edit still resemble it; other texts do not."""
    menu = "zebra lion tiger panther 1 2 3 4 5 6 7 8 9 10 11 12 13 14"
    short = "the house stands lonely " + " ".join(f"word{i}" for i in range(30))
    some = " ".join(f"the big{i} dog{i} and one{i} two{i}" for i in range(7)) + " " + " ".join(f"more{i}" for i in range(20))
    rows = [(4, menu), (3, "the cat dog meets a bird house with old trees"), (2, short), (1, some), (0, "of gold silver " * 20)]
    found = {r.id: r for r in spotsigs.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i].near_edited > 0.35 and found[i].near_next < 0.05 for i in (4, 2, 1))


@pytest.mark.parametrize("stretch", [1, 3, 4096])
def test_next_documents(spark, monkeypatch, stretch):
    monkeypatch.setattr(spotsigs, "STRETCH", stretch)
    for n in (1, 2, 40):
        ids = rng.sample([-5, 0, 1, 2, 3, 4, 5, 6, 1 << 40, (1 << 40) + 1, *range(100, 200)], n)
        texts = {i: "".join(rng.choice("abc") for _ in range(rng.randrange(12))) for i in ids}
        order = sorted(ids, reverse=True)
        found = {r.id: r for r in spotsigs.edit_likeness(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
        assert set(found) == set(ids)
        for i, nxt in zip(order, order[1:] + order[:1]):
            t, k = texts[i], len(texts[i]) // 3
            assert found[i].edited == t[: len(t) - k] + texts[nxt][:k] and found[i].n_chars == len(t)
            assert (found[i].near_next == 1.0) == (brute_signatures(t) == brute_signatures(texts[nxt]))


def test_similar_pairs(spark):
    sets = [sorted({f"{rng.randrange(30):02d}" for _ in range(rng.randint(1, 25))}) for _ in range(150)]
    sets += [s[:-1] for s in sets[:40] if len(s) > 1] + sets[:10]
    found = {(r.a, r.b) for r in spotsigs.similar_pairs(spark.createDataFrame(list(enumerate(sets)), "id long, signatures array<string>"), 0.7).collect()}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    want = set()
    for a, i in first.items():
        for b, j in first.items():
            if (len(a), i) < (len(b), j) and len(set(a) & set(b)) >= 0.7 * len(set(a) | set(b)) - 1e-12:
                want.add((i, j))
    assert found == want


def test_near_counts(spark):
    """Copies, repeated ids, null ids, empty fingerprints and signatures that nearly all have."""
    sets = [sorted({f"{rng.randrange(40):02d}" for _ in range(rng.randint(2, 20))} | {"zz"}) for _ in range(80)]
    sets += [s[:-2] + s[-1:] for s in sets[:40]] + sets[:10] * 3 + [[], []]
    rows = [(rng.choice([None, *range(60)]) if n % 7 == 0 else n, s) for n, s in enumerate(sets)]
    found = spotsigs.near_counts(spark.createDataFrame(rows, "id long, signatures array<string>"), 0.75).collect()
    known = [(i, tuple(s)) for i, s in rows if i is not None and s]

    def expected(i, s):
        if i is None or not s:
            return (i, None, 0, 0)
        near = [t for _, t in known if t != s and len(set(s) & set(t)) >= 0.75 * len(set(s) | set(t)) - 1e-12]
        return (i, min(j for j, t in known if t == s), sum(t == s for _, t in known), len(near))

    want = [expected(i, tuple(s)) for i, s in rows]
    assert Counter(map(tuple, found)) == Counter(want) and sum(w[3] for w in want) > 50
    none = spark.createDataFrame([], "id long, signatures array<string>")
    assert spotsigs.near_counts(none).count() == 0 and spotsigs.similar_pairs(none).count() == 0


# language-model scores

def test_baseline_against_brute_force(spark, odd_docs, no_docs):
    found = context_mixing.scores(odd_docs, ~context_mixing.held_out(F.col("doc_id"))).collect()
    assert len(found) == len(TEXTS)

    def tokens(t):
        return [*(t or "").encode().lower().split(), None]

    counts = Counter()
    for i, t, *_ in TEXTS:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 4)) for i, t, *_ in TEXTS)
    assert Counter((r.id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in found) == want
    assert all(r.train_tokens == n and r.score < 0 for r in found)
    assert context_mixing.scores(no_docs, F.lit(True)).count() == 0


def test_bits_are_probabilities():
    texts = [b"the cat sat on the mat", b"the dog sat on the log", b""] * 20
    keys, times = np.unique(context_mixing.strings(texts)[0], return_counts=True)
    mixer = context_mixing.Mixer.fresh(context_mixing.Contexts(keys, times, *context_mixing.summed(context_mixing.tail(keys, 3), times)))
    mixer.learn(keys, times, 0.1)
    # the 256 bytes that may follow a context have probabilities that sum to one
    after = (np.uint64(keys[7]) >> np.uint64(8) << np.uint64(8)) + np.arange(256, dtype=np.uint64)
    assert (2.0 ** -mixer.bits(after)).sum() == pytest.approx(1.0)

    def bits(text):
        return mixer.bits(context_mixing.strings([text])[0]).sum()

    assert bits(b"the cat sat on the mat") < bits(b"xqz jkw vvp qq zzz kkk") / 3


def test_counts_of_contexts_are_exact_and_wide():
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(400)).encode() for _ in range(50)]
    every = context_mixing.strings(texts)[0]
    keys, times = np.unique(every, return_counts=True)
    times = times * (1 << 31)  # sums beyond 31 bits
    counts = context_mixing.Contexts(keys, times, *context_mixing.summed(context_mixing.tail(keys, 3), times))
    for bit in (7, 3, 0):
        some = keys[:: len(keys) // 40]
        for order, found in enumerate(counts.counts(some, bit)):
            for k, (zeros, ones) in zip(some.tolist(), found.tolist()):
                mask = (1 << 8 * (order + 1)) - 1
                fits = [(int(e) & mask) >> bit & 1 for e in every if (int(e) & mask) >> (bit + 1) == (k & mask) >> (bit + 1)]
                assert (zeros, ones) == ((len(fits) - sum(fits)) << 31, sum(fits) << 31)


def test_model_against_brute_force(spark, monkeypatch, odd_docs):
    """Whole texts bit by bit, from counts in dictionaries, the fitted weights and the refinement."""
    fitted, fit = [], context_mixing.fit
    monkeypatch.setattr(context_mixing, "fit", lambda *given: fitted.append(fit(*given)) or fitted[-1])
    found = context_mixing.scores(odd_docs, ~context_mixing.held_out(F.col("doc_id"))).collect()
    (weights, refine), front = fitted[0], bytes([0xFF] * 5)
    lower = {(i, t): front + (t or "").encode().lower() + b"\xff" for i, t, *_ in TEXTS}
    # bits that followed the last 0 to 5 bytes and the bits of the byte so far
    seen = Counter()
    for i, t, *_ in TEXTS:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            text = lower[i, t]
            for at in range(5, len(text)):
                for order in range(6):
                    for bit in range(7, -1, -1):
                        seen[text[at - order : at], bit, text[at] >> (bit + 1), text[at] >> bit & 1] += 1

    def bits(text):
        total = 0.0
        for at in range(5, len(text)):
            for bit in range(7, -1, -1):
                x, longest, true = [], 0, text[at] >> bit & 1
                for order in range(6):
                    zeros, ones = (seen[text[at - order : at], bit, text[at] >> (bit + 1), b] for b in (0, 1))
                    share = (ones + 0.05) / (zeros + ones + 0.1)
                    x.append(math.log(share / (1 - share)) if zeros + ones else 0.0)
                    longest = order + 1 if zeros + ones else longest
                mixed = sum(a * b for a, b in zip(x, weights[bit * 7 + longest]))
                step = min(max(mixed * 2 + 16, 0), 31.999)
                row, low = refine[text[at - 1]], int(step)
                p = 0.5 / (1 + math.exp(-min(max(mixed, -25), 25))) + 0.5 * (row[low] + (step - low) * (row[low + 1] - row[low]))
                p = min(max(p, 1e-5), 1 - 1e-5)
                total -= math.log2(p if true else 1 - p)
        return total

    want = Counter((i, round(-bits(lower[i, t]) * math.log10(2), 1)) for i, t, *_ in TEXTS)
    for r in found:
        near = [k for k in want if k[0] == r.id and abs(k[1] - r.score) < 0.06 + 1e-5 * abs(r.score) and want[k]]
        assert near, (r.id, r.score)
        want[near[0]] -= 1
    assert len(found) == len(TEXTS) and len({r.score for r in found}) > 8


def test_weights_learn_from_all_occurrences(spark):
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 48, 30_000).astype(np.uint64))
    times = np.full(len(keys), 1000)
    one_part = (1, context_mixing.packed_keys(keys), context_mixing.deflated(times))
    counts = spark.createDataFrame([one_part], "part int, part_keys binary, part_times binary")
    passes = []
    mixer = context_mixing.Mixer.fresh(context_mixing.Contexts(keys, times, *context_mixing.summed(context_mixing.tail(keys, 3), times)))
    order = np.random.default_rng(1).permutation(len(keys))
    for rate in context_mixing.RATES:
        passes.append(mixer.learn(keys[order], times[order], rate).sum())
    assert passes == [8 * times.sum()] * 3
    weights, _ = context_mixing.fit(counts, context_mixing.summed(context_mixing.tail(keys, 3), times))
    assert np.allclose(weights, mixer.weights)


def test_scores_do_not_depend_on_partitions(spark):
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(60)], "doc_id long, text string")
    rows = [{r.id: r for r in context_mixing.scores(d, F.col("doc_id") < 50).collect()} for d in (docs, docs.repartition(5))]
    assert set(rows[0]) == set(range(60)) and all(rows[0][i].score == pytest.approx(rows[1][i].score, rel=1e-6) for i in range(60))
    assert sum(r.score for i, r in rows[0].items() if i >= 50) > -60 * 40 * 10 * math.log10(9) / 6


# web pages

def test_blocks_of_broken_pages():
    page = blocks(
        "<html><head><title>No</title><script>var a='</p>';</script></head><body><nav><a href=x>menu</a></nav><p class='A bC'>One &amp; <b>two<br>three<p>four"
        "<!-- gone --><div>five</div>six<ul><li>a<li>b</ul><textarea>no</textarea> &lt;p&gt; <"
    )
    assert [b.text for b in page] == ["menu", "One & two three", "four", "five", "six", "a", "b", "<p> <"]
    assert page[1].path == ("html", "body", "p", ".a", ".b", ".c") and page[0].linked == 4
    assert blocks("") == [] and blocks("plain") [0].text == "plain" and blocks("<p") == []


@pytest.mark.parametrize("icon, inside", [
    ("<svg class='i'/>", ""), ("<math/>", ""), ("<svg viewBox='0 0 1 1'><path d='M0'/><title/></svg>", ""), ("<svg><svg><text>x</text></svg><text>y</text></svg>", ""), ("<svg><text>x", ""),
    ("<div><noscript>x</div>", "x"), ("<template>x", "x"), ("<object>x", "x"), ("<select><option>x", "x"), ("<template><template><p>x</template><p>y</template>", ""),
    ("<svg><foreignObject><div>x</div></foreignObject><text>y</text></svg>", ""), ("<noscript><p>x</p></noscript>", ""), ("<iframe src=x></iframe>", ""),
])
def test_article_after_an_embedded_element(icon, inside):
    page = blocks(f"<body>{icon}<p>first</p><article><p>second <svg><text>no</text></svg> half</p></article></body>")
    assert [b.text for b in page] == [*inside.split(), "first", "second half"]
    assert blocks("<p>a<script>var s = '<p>no'")[0].text == "a" and len(blocks("<p>a<style/>b<p>c")) == 1


def test_all_words_and_blocks_count(monkeypatch):
    one, other = (html_extraction.page_vectors(blocks("<p>" + " ".join(["w"] * 200 + [x] + ["w"] * 100))) for x in ("w", "zebra"))
    assert (one != other)[0, html_extraction.PATH : html_extraction.PATH + html_extraction.WORDS].any()
    seen = []
    monkeypatch.setattr(html_extraction, "page_vectors", lambda page, *_: seen.append(len(page)) or np.zeros((len(page), html_extraction.SIZE), np.float32))
    html_extraction.fit_pages(["<p>word" * 500], rounds=0)
    assert seen[0] == 500
    lengths = [3, 20_000, 700, *[10] * 100]
    cuts = list(html_extraction.case_batches(lengths))
    assert [i for a, b in cuts for i in range(a, b)] == list(range(len(lengths)))
    assert all(b - a == 1 or (b - a) * max(lengths[a:b]) <= html_extraction.BATCH_STEPS for a, b in cuts)


def test_gradients():
    r = np.random.default_rng(0)
    model = html_extraction.Labeller.fresh()
    model.out[:] = r.standard_normal(model.out.shape) / 4
    pages = [r.standard_normal((n, html_extraction.SIZE)).astype(np.float32) for n in (3, 5)]
    x, lengths = html_extraction.padded(pages)
    y = (r.random(x.shape[:2]) < 0.5).astype(np.float32)

    def loss():
        p = model.probabilities(pages)
        return -sum(np.log(np.where(y[i, : len(q)] > 0, q, 1 - q)).sum() for i, q in enumerate(p)) / lengths.sum()

    for a, g in zip(model.arrays(), model.gradients(x, lengths, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        a[at] += 0.01
        up = loss()
        a[at] -= 0.02
        down = loss()
        a[at] += 0.01
        assert (up - down) / 0.02 == pytest.approx(g[at], rel=0.05, abs=1e-3)


@tables
def test_extraction_against_brute_force(spark):
    """Vectors of blocks, states of both directions, a step at a time, and chosen blocks, from the fitted weights."""
    model = html_extraction.fit(spark.read.parquet(f"{SF_DIR}/pages.parquet"), sample_pages=12)
    path, words, hidden = 64, 24, 20

    def vector(page, i):
        b, x = page[i], [0.0] * (path + words)
        for name in b.path:
            x[zlib.crc32(name.encode()) % path] = 1.0
        every = b.text.lower().split()
        for w in every:
            x[path + zlib.crc32(w.encode()) % words] += 1.0
        norm = max(1.0, math.sqrt(sum(v * v for v in x[path:])))
        x[path:] = [v / norm for v in x[path:]]
        n, marks = len(b.text), sum(b.text.count(m) for m in ".,!?")
        x += [math.log1p(n) / 5, math.log1p(len(every)) / 4, b.linked / n, min(1.0, 10 * marks / n), float(b.text[-1] in ".!?\"”:;"), float(b.text[0].isupper())]
        return x + [i / len(page), 1 - i / len(page), math.log1p(len(b.path)) / 3, n / max(1, len(every)) / 10]

    def states(one, xs):
        h, c, out = np.zeros(hidden), np.zeros(hidden), []
        for x in xs:
            g = np.array(x) @ one.wx.astype(float) + h @ one.wh.astype(float) + one.b
            i, f, o = (1 / (1 + np.exp(-np.clip(g[k * hidden : (k + 1) * hidden], -30, 30))) for k in range(3))
            c = f * c + i * np.tanh(g[3 * hidden :])
            h = o * np.tanh(c)
            out.append(h)
        return out

    rows = spark.read.parquet(f"{SF_DIR}/pages.parquet").orderBy("page_id").limit(25)
    seen = 0
    for r in html_extraction.extract(rows, model).collect():
        page = blocks(r.html or "")
        xs = [vector(page, i) for i in range(len(page))]
        both = zip(states(model.ahead, xs), states(model.back, xs[::-1])[::-1])
        p = [1 / (1 + math.exp(-float(np.concatenate(hs) @ model.out[:-1] + model.out[-1]))) for hs in both]
        if all(abs(x - 0.4) > 1e-3 for x in p):
            seen += 1
            assert r.text == " ".join(b.text for b, x in zip(page, p) if x >= 0.4)
            assert (r.n_blocks.chosen, r.n_blocks.all) == (sum(x >= 0.4 for x in p), len(page))
    assert seen >= 20


@tables
def test_extraction(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    model = html_extraction.fit(pages, sample_pages=80)
    found = html_extraction.extract(pages, model).collect()
    right = 0
    for r in found:
        page = blocks(r.html)
        want = " ".join(b.text for b, y in zip(page, html_extraction.by_names(page)) if y)
        right += want == r.text
        assert r.n_chars == len(r.text)
    assert right >= 0.95 * len(found)
    # layouts that the model has not seen
    made, wrong, total = random.Random(77), 0, 0
    articles = [[b.text for b, y in zip(blocks(r.html), html_extraction.by_names(blocks(r.html))) if y] for r in found[:80]]
    for a in articles:
        page = blocks(html_extraction.made_page(a[:20], [t for x in articles for t in x], made))
        p = model.probabilities([html_extraction.page_vectors(page)])[0]
        wrong += sum((x >= 0.4) != b.marked for x, b in zip(p, page))
        total += len(page)
    assert wrong < 0.08 * total
    odd = spark.createDataFrame([(1, None, "u"), (2, "", None), (None, "<p>x", "u"), (3, "<p>" * 3000 + "deep", "u"), (3, "<<<>>>&&&", "u")], "page_id long, html string, text string")
    out = html_extraction.extract(odd, model).collect()
    assert len(out) == 5 and all(r.text is not None and r.n_chars == len(r.text) for r in out)
    assert html_extraction.extract(odd.limit(0), model).count() == 0
    assert len(html_extraction.fit(odd.limit(0)).arrays()) == 7

