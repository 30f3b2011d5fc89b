"""Queries against their SQL at the smallest scale, and the pipeline, stage by stage, against plain Python."""

import hashlib
import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabprobe.llm import mixing, toxicity
from tabprobe.llm.queries import ORACLE, QUERIES, vocabulary_path
from tests.compare import connect, differences
from tests.llm.conftest import plain_toxicity
from tests.llm.test_dedup import brute_components, lower
from tests.llm.test_text import brute_targets

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, name):
    found = QUERIES[name](spark, SF_DIR).toPandas()
    assert differences(found, connect(SF_DIR).execute(ORACLE[name]).df()) is None


def test_pipeline_keeps_columns_and_decides(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "bpe"]


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs, tmp_path, odd_labels):
    odd_labels.write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (odd_docs, no_docs):
        docs = frame
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            docs = spark.createDataFrame(rows, out.schema)
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (docs.count() > 0) == (frame is odd_docs)


def plain_copies(docs, keys):
    """How often the mix takes each document whole: keys in order per source, budgets down to the word."""
    words = {d.doc_id: len((d.text or "").encode().split()) for d in docs}
    sizes = Counter()
    for d in docs:
        sizes[d.source] += words[d.doc_id]
    targets, out = brute_targets(sizes), {}
    for source, target in targets.items():
        mine = sorted((keys[d.doc_id], d.doc_id) for d in docs if d.source == source)
        size = sizes[source]
        epochs = math.floor(target / size) if size else 0
        rest, start, open_ = round(target - epochs * size), 0, True
        for _, i in mine:
            n = words[i]
            whole = int(open_ and rest > 0 and not start + n > rest)
            extra = n if whole else max(0, rest - start) if open_ and n else 0
            open_ = open_ and bool(whole)
            start += n
            out[i] = math.floor((epochs * n + extra) / n + 0.5) if n else epochs + whole
    return out


def test_pipeline_against_brute_force(spark):
    """What each stage keeps of what it is given, against plain Python; documents have distinct ids here."""
    from tokenizers import Tokenizer

    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    first = given.orderBy("doc_id").limit(12).collect()
    more = [{**r.asDict(), "doc_id": 10**6 + n, "text": (r.text or "").upper() if n % 2 else (r.text or "") + " x"} for n, r in enumerate(first)]
    more += [{**first[0].asDict(), "doc_id": 2 * 10**6 + n, "text": t, "source": x} for n, (t, x) in enumerate([(None, None), ("", "a"), (" ", "a"), ("one two", None)])]
    docs = given.unionByName(spark.createDataFrame([tuple(m[c] for c in given.columns) for m in more], given.schema))
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = toxicity.fit(docs, labels, fold=~toxicity.held_out(F.col("doc_id")))
    now, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        now = stage(spark, now, SF_DIR)
        after = now.collect()
        now = spark.createDataFrame(after, now.schema)
        rows = {r.doc_id: r for r in before}
        assert len(rows) == len(before) or name == "bpe"
        if name == "toxicity":
            want = Counter(r for r in before if plain_toxicity(model, r.text or "")[0] < 0.7)
        elif name == "exact_dedup":
            want = Counter(rows[i] for i in {lower(r.text): r.doc_id for r in sorted(before)}.values())
        elif name == "ngram_jaccard":
            found, groups = brute_components([(r.doc_id, r.text) for r in before])
            want = Counter(rows[i] for i, _, least in found if least == i)
            assert sum(want.values()) == groups
        elif name == "mixing":
            marked = mixing.sized(spark.createDataFrame(before, docs.schema), labels)
            keys = {r.doc_id: r.key for r in marked.select("doc_id", mixing.exponential_key(F.col("doc_id"), F.col("quality"), 42).alias("key")).collect()}
            want = Counter({rows[i]: n for i, n in plain_copies(before, keys).items() if n})
        else:
            library = Tokenizer.from_file(vocabulary_path())
            library.no_truncation()
            library.no_padding()
            want = Counter()
            for r in before:
                ids = library.encode(r.text or "", add_special_tokens=False).ids
                digests = (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
                want[(r.doc_id, len(ids), *(hashlib.sha256(d.encode()).hexdigest() for d in digests))] += 1
            after = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after]
        assert Counter(after) == want, name
        sizes.append(len(after))
    assert sizes[0] > sizes[1] > sizes[2] and len(set(sizes)) > 3
