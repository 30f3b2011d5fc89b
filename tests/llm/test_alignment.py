"""Two tokenizers aligned: brute force over characters' bytes, the library's own ids, the perfect hash, sums over several slices."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabprobe.llm import alignment
from tabprobe.llm.bpe import byte_letters
from tabprobe.llm.perfect_hash import PerfectHash
from tabprobe.llm.vocabularies import ByteLevel, Pieces
from tests.llm.conftest import TEXTS

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MORE = ["a  b", " lead", "trail ", "  ", "\n\n x", "▁", "a ▁ b", "<s> </s>", "<0x41>", "tab\tx", "don't 'S 123 ½", "é ﬁ", "日本 語", " ", "x" * 5000, "the cat " * 400]


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def brute(library, texts):
    a, b = library
    back = {c: i for i, c in enumerate(byte_letters())}
    docs, counts = [], Counter()
    for text in texts:
        text = text or ""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelt_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        spelt_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        if not text or b"".join(spelt_a) != (" " + text).encode() or b"".join(spelt_b) != (" " + text).encode():
            docs.append(([], [], [], []))
            continue

        def ranges(spelt):
            at, out = 0, []
            for s in spelt:
                out.append((at, at + len(s)))
                at += len(s)
            return out

        ra, rb = ranges(spelt_a), ranges(spelt_b)
        owner = [j for j, (s, e) in enumerate(rb) for _ in range(s, e)]
        links = [(ids_a[i], ids_b[j]) for i, (s, e) in enumerate(ra) for j in sorted(set(owner[s:e]))]
        both = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, last = [], 0
        for e in both:
            groups.append((",".join(str(i) for i, r in zip(ids_a, ra) if last < r[1] <= e), ",".join(str(i) for i, r in zip(ids_b, rb) if last < r[1] <= e)))
            last = e
        docs.append((ids_a, ids_b, links, groups))
        counts.update(set(links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for ids_a, ids_b, links, groups in docs:
        text = ";".join("|".join(g) for g in groups)
        out.append((len(ids_a), len(ids_b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if ids_a else ""))
    return out


@pytest.mark.parametrize("slice_pairs", [10**7, 40])
def test_alignment_against_brute_force(spark, library, odd_docs, slice_pairs):
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(MORE)], "doc_id long, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True).withColumn("n_a", odd_docs["doc_id"]).repartition(5)
    found = alignment.align(docs, A_PATH, B_PATH, shards=4 if slice_pairs == 40 else alignment.SHARDS, slice_pairs=slice_pairs, groups=True).collect()
    expected = brute(library, [t for _, t, *_ in TEXTS] + MORE)
    texts = [t for _, t, *_ in TEXTS] + MORE
    got = Counter(tuple([r.text] + [r[c] for c in alignment.OWN]) for r in found)
    assert got == Counter((t, *e) for t, e in zip(texts, expected))
    assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") == r.groups_sha256 for r in found)
    assert found[0].asDict()["kept"] is not None and "lang" in found[0].asDict()


def test_alignment_of_nothing(spark, no_docs):
    assert alignment.align(no_docs, A_PATH, B_PATH).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r[c] for c in alignment.OWN) for r in alignment.align(nulls, A_PATH, B_PATH).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_texts_are_encoded_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(doc_id):
        read.add(1)
        return f"the cat {doc_id} sat"

    docs = spark.range(30).select(F.col("id").alias("doc_id"), text.asNondeterministic()("id").alias("text"))
    assert alignment.align(docs, A_PATH, B_PATH, carry=["doc_id"], shards=4, slice_pairs=5).count() == 30
    assert read.value == 30


def test_tree_of_several_levels(spark):
    texts = spark.createDataFrame([(f"the cat number {i} sat",) for i in range(60)], "text string").repartition(30)
    wide = alignment.pair_counts(texts, A_PATH, B_PATH, shards=2, fan=3).collect()
    flat = alignment.pair_counts(texts, A_PATH, B_PATH, shards=2, fan=64).collect()

    def pairs(rows):
        return {(k, c) for r in rows for k, c in zip(np.frombuffer(r.keys, "<i8").tolist(), np.frombuffer(r.counts, "<i8").tolist())}

    assert pairs(wide) == pairs(flat) and max(c for _, c in pairs(flat)) == 60


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sabcXY09.,!é▁ß½  <|>"), st.characters(codec="utf-8", exclude_characters="\0")), max_size=40), max_size=6))
def test_ids_are_the_library_s(library, texts):
    a, b = library
    for coder, direct in ((CODERS[0], lambda t: a.encode(t, add_special_tokens=False).ids), (CODERS[1], b.encode)):
        ids, counts, _ = coder.encode(texts)
        assert ids.tolist() == [i for t in texts for i in direct(t)] and counts.tolist() == [len(direct(t)) for t in texts]


CODERS = ByteLevel(A_PATH, plain_specials=True, remembered=50), Pieces(B_PATH, remembered=50)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**40), max_size=400))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.int64)
    found = PerfectHash.build(keys)
    assert sorted(found.lookup(keys).tolist()) == list(range(len(keys))) and found.n == len(keys)
    again = PerfectHash(found.sizes, np.frombuffer(found.words.tobytes(), np.uint64))
    assert (again.lookup(keys) == found.lookup(keys)).all()
