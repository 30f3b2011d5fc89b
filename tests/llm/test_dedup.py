"""Exact duplicates, near copies and repeated passages against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprobe.llm import exact_dedup, graph, ngram_jaccard, suffix_dedup
from tests.llm.conftest import TEXTS

rng = random.Random(3)
VOCABULARY = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(300)]


def lower(text):
    return (text or "").encode().lower().decode()


def test_owners_on_odd_rows(odd_docs, no_docs):
    found = exact_dedup.exact_dedup(odd_docs).collect()
    assert len(found) == len(TEXTS) and set(found[0].asDict()) >= {"key", "name", "row", "keep_id", "kept", "text_sha256"}
    groups = defaultdict(list)
    for i, t, *_ in TEXTS:
        groups[lower(t)].append(i)
    for r in found:
        ids = groups[lower(r.text)]
        best = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (best, len(ids))
        assert r.text_sha256 == hashlib.sha256(lower(r.text).encode()).hexdigest()
    assert sum(r.kept for r in found) == len(groups)
    kept = exact_dedup.keep_owners(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(no_docs).count() == 0 and exact_dedup.keep_owners(no_docs).count() == 0


@pytest.mark.parametrize("budget", [1, 2000, 1 << 20])
def test_trie_spills_by_subtree(spark, budget):
    texts = ["", "a", "ab", "abc", "b" * 500] + ["".join(rng.choice("ab") for _ in range(rng.randrange(30))) for _ in range(400)]
    rows = [(i, hashlib.sha256(t.encode()).hexdigest(), t) for i, t in enumerate(texts * 2)]
    found = exact_dedup.text_owners(spark.createDataFrame(rows, "id long, name string, text string"), trie_bytes=budget).collect()
    want = defaultdict(list)
    for i, n, _ in rows:
        want[n].append(i)
    assert {(r.name, r.keep_id, r.group_size, r.n_top) for r in found} == {(n, max(i), len(i), 1) for n, i in want.items()} and len(found) == len(want)


def test_two_texts_under_one_digest_stop_the_job(spark):
    rows = spark.createDataFrame([(1, "same", "xx"), (2, "same", "yy")], "id long, name string, text string")
    with pytest.raises(Exception, match="share the digest"):
        exact_dedup.text_owners(rows).collect()


def brute_components(rows):
    sets, parent = {}, {}
    for n, (_, t) in enumerate(rows):
        w = lower(t).encode().split()
        sets[n] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        parent[n] = n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    groups = defaultdict(list)
    for n in sets:
        groups[find(n)].append(n)
    out = []
    for n, (i, _) in enumerate(rows):
        out.append((i, len(sets[n]), min((rows[m][0] for m in groups[find(n)] if rows[m][0] is not None), default=None)))
    return sorted(out, key=repr), len(groups)


def near_copies():
    rows = []
    for size in (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 18, 20, 25, 40, 80, 200):
        for _ in range(3):
            base = [rng.choice(VOCABULARY) for _ in range(size)]
            for _ in range(5):
                copy = list(base)
                for _ in range(rng.randrange(1 + size // 25 + (size > 8))):
                    copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY)
                if rng.random() < 0.4:
                    copy = copy[: len(copy) - rng.randrange(1 + size // 8)] or copy
                if rng.random() < 0.3:
                    copy = copy + [rng.choice(VOCABULARY) for _ in range(rng.randrange(1 + size // 8))]
                rows.append((len(rows), " ".join(copy)))
    passage = " ".join(rng.choice(VOCABULARY) for _ in range(60))
    rows += [(len(rows) + k, passage + " " + " ".join(rng.choice(VOCABULARY) for _ in range(4 + k % 14))) for k in range(60)]
    rng.shuffle(rows)
    return rows


def test_jaccard_components(spark, odd_docs, no_docs):
    for rows in (near_copies(), [(i, t) for i, t, *_ in TEXTS]):
        found = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), buckets=4).collect()
        want, groups = brute_components(rows)
        assert sorted(((r.id, r.n_shingles, r.component_id) for r in found), key=repr) == want
        assert sum(r.stays for r in found) == groups
    assert ngram_jaccard.jaccard_components(no_docs, buckets=2).count() == 0
    kept = ngram_jaccard.keep_representatives(odd_docs, buckets=2)
    assert kept.columns == odd_docs.columns and kept.count() == groups
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gram_sets_")]


@pytest.mark.parametrize("limit", [0, 5, 9, 12])
def test_any_boundary_gives_all_links(spark, monkeypatch, limit):
    monkeypatch.setattr(ngram_jaccard, "boundary_of", lambda *a: limit)
    monkeypatch.setattr(ngram_jaccard, "MIN_HASHES", 1)
    rows = near_copies()
    found = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), buckets=4).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in found), key=repr) == brute_components(rows)[0]


def test_boundary_by_cost():
    assert ngram_jaccard.best_boundary({}, {}) == 0
    assert ngram_jaccard.best_boundary({5: 1000}, {5: 1e6}) >= 5
    assert ngram_jaccard.best_boundary({14: 1000}, {14: 0.0}) < 14


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


def brute_repeats(rows, length):
    first = {}
    big = float("inf")
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, big), big if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (big if i is None else i):
                gone[k : k + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def passages():
    shared = ["".join(rng.choice("ab é") for _ in range(n)) for n in (30, 49, 50, 51, 64, 200, 900)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            parts.append(rng.choice([rng.choice(shared), "".join(rng.choice("abcdefgh ü") for _ in range(rng.randrange(120)))]))
        rows.append((i, "".join(parts)))
    rows += [(100, "ab" * 400), (101, "ab" * 300), (102, "a" * 500), (103, "a" * 49), (104, "a" * 50), (105, "a" * 50), (90, rows[3][1]), (91, rows[3][1]), (None, shared[-1]), (None, None), (7, shared[-1])]
    return rows


@pytest.mark.parametrize("length,gram", [(50, 24), (20, 8)])
def test_repeats_are_removed(spark, no_docs, length, gram):
    rows = passages() + [(i, t) for i, t, *_ in TEXTS]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = suffix_dedup.remove_repeats(frame, length=length, gram=gram).collect()
    assert sorted(((r.id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in found), key=repr) == brute_repeats(rows, length)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_suffix_sort_and_collisions(monkeypatch):
    data = np.frombuffer(("abracadabra" * 30 + "".join(rng.choice("ab") for _ in range(400))).encode(), np.uint8)
    starts = np.arange(0, len(data) - 20)
    groups = starts % 3
    prefix = suffix_dedup.PrefixHash(data)
    order = suffix_dedup.suffix_sort(data, prefix, starts, groups, 20)
    keys = [(groups[i], data[starts[i] : starts[i] + 20].tobytes()) for i in order]
    assert keys == sorted(keys)
    owners = starts % 7
    right = suffix_dedup.repeats(data, starts, groups, owners, 20)
    # a hash that always agrees must be caught by comparing bytes
    monkeypatch.setattr(suffix_dedup.PrefixHash, "of", lambda self, s, n: np.zeros(np.broadcast(s, n).shape, np.uint64))
    assert (suffix_dedup.repeats(data, starts, groups, owners, 20) == right).all()
    assert right.any() and not right.all()


def test_gram_sets_of_few_words():
    for texts in ([b""], [b"one"], [b"one two", b"", b"three"], [b"a b c d"], [b"a b c d e"], [b" a  b c d e f\n", b"x"]):
        found = ngram_jaccard.gram_sets(texts, 5)
        assert [len(s) for s in found] == [max(min(1, len(t.split())), len(t.split()) - 4) for t in texts]
    a, b = ngram_jaccard.gram_sets([b"one two", b"x one two"], 5)
    assert (a == ngram_jaccard.gram_sets([b"one  two"], 5)[0]).all() and (a != b).all()


def test_copies_and_common_passages_are_handled_once(spark):
    text = "".join(rng.choice("abcdefgh ") for _ in range(600))
    hashed = [F.xxhash64("text").alias("th"), F.sha2("text", 256).alias("name"), "text"]
    docs = spark.createDataFrame([(text,)] * 80 + [(text[:500] + "x" * 60,)] * 3, "text string").repartition(2).select(*hashed)
    found = suffix_dedup.repeated_anchors(docs, 50, 24).collect()
    per_text = Counter(r.th for r in found for _ in suffix_dedup.unpack(r.places, np.int32))
    assert len(per_text) == 2 and max(per_text.values()) <= 2 * 600 / 8
    lead, owner = np.array([3, 3, 4, 3, 3]), np.array([7, 2, 9, 2, 5])
    assert suffix_dedup.repeated_here([b"one", b"one", b"one", b"one", b"two"], lead, owner).tolist() == [True, False, False, False, False]
    # copies without ids, repeated rows, and a passage in most texts
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = [(i, "".join(rng.choice("ijklmnop") for _ in range(40)) + passage + "".join(rng.choice("ijklmnop") for _ in range(40))) for i in range(40)]
    rows += [(None, text)] * 5 + [(50, text[:300])] * 2
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    windows = defaultdict(list)
    for i, t in rows:
        for k in range(len(t) - 49):
            windows[t[k : k + 50]].append(2**63 - 1 if i is None else i)
    for r in out:
        t = dict(rows)[r.id]
        gone = {k + j for k in range(len(t) - 49) if min(windows[t[k : k + 50]]) < (2**63 - 1 if r.id is None else r.id) for j in range(50)}
        assert r.n_removed == len(gone) and bytes(r.kept) == "".join(c for k, c in enumerate(t) if k not in gone).encode()


def test_group_of_near_copies_is_not_paired_in_full(spark, monkeypatch):
    """Copies of one text with up to three words changed, many pairs of them just below the threshold: few pairs are verified."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(words))]
    for i in range(1, 250):
        mine = list(words)
        for k in rng.sample(range(4, 146), rng.randint(1, 3)):
            mine[k] = f"n{i}x{k}"
        rows.append((i, " ".join(mine)))
    tried = []
    verified = ngram_jaccard.verified

    def counting(pairs, table):
        tried.append(pairs.count())
        return verified(pairs, table)

    monkeypatch.setattr(ngram_jaccard, "verified", counting)
    monkeypatch.setattr(ngram_jaccard, "MIN_HASHES", 1)
    found = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), buckets=4).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in found), key=repr) == brute_components(rows)[0]
    assert sum(tried) < 8 * len(rows)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 600, 20_000])
def test_stored_sets_are_whole_and_smaller(n):
    for grams in (np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, np.uint64, endpoint=False) if n > 1 else np.array([1 << 63], np.uint64)),
                  np.arange(n, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(n, dtype=np.uint64)[::-1]):
        data = ngram_jaccard.stored(grams)
        assert (ngram_jaccard.restored(data) == grams).all() and len(ngram_jaccard.restored(data)) == len(grams)
        assert n < 600 or len(data) < 0.92 * grams.nbytes
