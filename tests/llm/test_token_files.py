"""Coded token files: round trips, the library's ids by brute force, damage, pieces of long documents, odd rows."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabprobe.llm import token_files
from tabprobe.llm.range_coder import Block, decode_blocks, encode_blocks
from tests.llm.conftest import TEXTS

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    """doc_id, start, n_tokens, ids_crc32 in the documents' order; ties in any order."""
    library = Tokenizer.from_file(PATH)
    coded = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    return [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0))]


@pytest.mark.parametrize("block_ids, file_chars", [(4096, 20_000_000), (7, 9000), (100, 4000)])
def test_files_against_the_library(spark, odd_docs, tmp_path, block_ids, file_chars):
    path = f"{tmp_path}/ids"
    token_files.write_ids(odd_docs.repartition(3), PATH, path, block_ids=block_ids, file_chars=file_chars)
    found = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r.start)
    wanted = expected([(i, t) for i, t, *_ in TEXTS])
    assert [r.doc_id for r in found] == [i for i, *_ in wanted]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted((str(i), n, c) for i, n, c in wanted)
    assert [r.start for r in found] == np.concatenate([[0], np.cumsum([r.n_tokens for r in found])[:-1]]).tolist()
    stream = [i for r in sorted(token_files.read_ids(spark, path).collect(), key=lambda r: (r.part, r.block)) for i in r.ids]
    for r in found:
        assert zlib.crc32(np.array(stream[r.start : r.start + r.n_tokens], "<u4").tobytes()) == r.ids_crc32


def test_no_documents(spark, no_docs, tmp_path):
    token_files.write_ids(no_docs, PATH, f"{tmp_path}/ids")
    assert token_files.read_documents(spark, f"{tmp_path}/ids").collect() == []


ids = st.one_of(st.lists(st.integers(0, 5), min_size=1, max_size=80), st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=30), st.just([7] * 200))


@settings(max_examples=40, deadline=None)
@given(st.lists(ids, max_size=8), st.booleans())
def test_round_trip(lists, repeated):
    blocks = [Block(k, np.array(x * (1 + 3 * repeated), np.int64), k * 10, [None, -5, 2**62], [1, 2, 3]) for k, x in enumerate(lists)]
    coded = encode_blocks(blocks)
    for b, again, alone in zip(blocks, decode_blocks(coded), (decode_blocks([c])[0] for c in coded)):
        for c in (again, alone):
            assert (c.ids == b.ids).all() and (c.first, c.ordinal, c.doc_ids, c.lengths) == (b.first, b.ordinal, b.doc_ids, b.lengths)


def test_intervals_across_borders():
    rng = np.random.default_rng(5)
    blocks = [Block(0, np.minimum(rng.zipf(a, 5000), 60000), 0, [1], [5000]) for a in np.linspace(1.05, 4, 40)]
    assert all((a.ids == b.ids).all() for a, b in zip(blocks, decode_blocks(encode_blocks(blocks))))


def test_text_gets_smaller():
    rng = np.random.default_rng(3)
    phrases = [rng.integers(0, 50000, 6) for _ in range(300)]
    stream = np.concatenate([phrases[int(k) % 300] for k in rng.zipf(1.3, 3000)])
    block = Block(0, stream, 0, [1], [len(stream)])
    assert len(encode_blocks([block])[0]) < 2 * len(stream) / 4


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 255))
def test_damage_is_an_error(place, change):
    payload = bytearray(DAMAGED)
    payload[place % len(payload)] ^= change
    with pytest.raises(ValueError):
        decode_blocks([bytes(payload)])


DAMAGED = encode_blocks([Block(0, np.arange(500) % 37, 0, [1], [500])])[0]


@given(st.lists(st.tuples(st.binary(max_size=50), st.binary(max_size=50)), max_size=8))
def test_joined_checksums(pairs):
    firsts, seconds, whole = (np.array([zlib.crc32(f(a, b)) for a, b in pairs], np.uint64) for f in (lambda a, b: a, lambda a, b: b, lambda a, b: a + b))
    assert (token_files.joined_crcs(firsts, seconds, np.array([len(b) for _, b in pairs], np.int64)) == whole).all()
