"""Spelling variants: near pairs against all pairs, crowded keys, whole rows against a plain count."""

import random
import re
import zlib
from collections import Counter

import pytest

from tabprobe.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 199 == 0 else low] += 1
    n = {w: k for w, k in n.items() if k >= 5 and len(w) >= 6}
    form, rows = {}, []
    for w in n:
        around = [x for x in n if near(w, x)]
        best = min(around, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        rows.append([w, form[w], None, n[w], len(around), n[form[w]] if form[w] else None])
    for row in rows:
        at = row[0]
        while form[at]:
            at = form[at]
        row[2] = at
    return sorted(tuple(r) for r in rows)


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


rng = random.Random(4)


@pytest.mark.parametrize("crowd", [1, 6, 40])
def test_near_pairs_are_all_pairs(spark, crowd):
    some = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(300)} | {"", "commons" * 40, "commons" * 40 + "x", "x" + "commons" * 40}
    found = spelling.near_pairs(spark.createDataFrame([(w,) for w in some], "word string"), crowd=crowd).collect()
    assert len(found) == len(set(found))
    assert {frozenset(p) for p in found} == {frozenset((a, b)) for a in some for b in some if near(a, b)}


def test_crowded_prefix_is_cut_again(spark):
    """Thousands of words behind one prefix: joined rows stay near the number of words."""
    some = sorted({"interconnect" + "".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(3000)})
    some += [w[:-1] + "z" for w in some[::10]] + [w[:14] + w[15:] for w in some[::10]]
    found = spelling.near_pairs(spark.createDataFrame([(w,) for w in some], "word string")).collect()
    assert {frozenset(p) for p in found} >= {frozenset((w, w[:-1] + "z")) for w in some[:3000:10]} | {frozenset((w, w[:14] + w[15:])) for w in some[:3000:10]}


def test_rows_against_a_plain_count(spark):
    base = ["".join(rng.choice("etaoinéß") for _ in range(rng.randint(5, 9))) for _ in range(60)]

    def typo(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("etaoinß") + w[i:], w[:i] + "x" + w[i + 1 :]])

    pool = base * 30 + [typo(w) for w in base for _ in range(2)] * 6
    rng.shuffle(pool)
    docs = [(i, ", ".join(w.upper() if rng.random() < 0.1 else w for w in pool[i * 40 : i * 40 + 40])) for i in range(len(pool) // 40)]
    chains = [(1000, "abcdefg " * 200 + "abcdefgh " * 30 + "abcdefghi " * 5), (1001, "1aaaaaa×÷ " * 5), (None, "nobody " * 9), (1002, None), (1003, "")]
    rows = docs + chains + [docs[0]]
    found = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), noise=199)
    assert tuples(found) == brute(rows)
    by_word = {r.word: r for r in found.collect()}
    assert by_word["abcdefghi"].root == "abcdefg" and by_word["abcdefghi"].form == "abcdefgh"


def test_odd_rows(spark, odd_docs, no_docs):
    assert tuples(spelling.variants(odd_docs, min_count=1)) == sorted(tuples(spelling.variants(odd_docs.select("doc_id", "text").repartition(3), min_count=1)))
    assert spelling.variants(no_docs).collect() == []
