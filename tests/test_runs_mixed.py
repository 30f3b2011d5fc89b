"""Runs of several layouts, id lists in byte ranges, evaluation once per text, samples of any size."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tabprobe.functions.markup import counted_tokens
from tabprobe.operators.distinct import evaluate_distinct
from tabprobe.operators.sampling import sample_tables
from tabprobe.plans.jobs import run_judge
from tabprobe.sources import corpus, idlists, results, runs, versions

HEAD = "table_id,task,fmt,question"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_layouts_and_malformed_records(spark, tmp_path):
    plain = write(tmp_path / "plain.csv", f'{HEAD},raw,n_rows\na,t,f,"q ""x"", y",one\\ntwo,3.0\nb,t,f,q\nc,t,f,q,x,many\nd,t,f,q,"",\\N\nj,t,f,q,,1\n,t,f,q,x,1\n')
    turned = write(tmp_path / "turned.csv", 'n_rows,note,question,fmt,task,table_id\n7,"NA",q,f,t,e\n1,2,3,4,5,6,7\n')
    again = write(tmp_path / "more" / "again.csv", f"{HEAD},raw,n_rows\ng,t,f,q,x,2\n")
    columns = "table_id string, task string, fmt string, question string, raw string, extra double"
    for batch in ([("h", "t", "a+b %/c", "q", "as\\n is", 1.5)], [("i", "t", None, "q", None, None)]):
        results.append_predictions(spark.createDataFrame(batch, columns), str(tmp_path / "all"), "stored")
    good, bad = runs.read_runs(spark, [plain, turned, again, str(tmp_path / "all" / "run_id=stored")])
    rows = {r.table_id: r for r in good.collect()}
    assert {k: r.run_id for k, r in rows.items()} == {"a": "plain", "d": "plain", "j": "plain", "e": "turned", "g": "again", "h": "stored", "i": "stored"}
    assert (rows["a"].question, rows["a"].raw, rows["a"].n_rows) == ('q "x", y', "one\ntwo", 3)
    assert (rows["d"].raw, rows["d"].n_rows, rows["e"].note, rows["e"].raw, rows["e"].n_rows) == ("", None, "NA", None, 7)
    assert (rows["h"].fmt, rows["h"].raw, rows["i"].fmt, rows["g"].n_rows, rows["j"].raw) == ("a+b %/c", "as\\n is", None, 2, None)
    assert sorted(r.run_id for r in bad.collect()) == ["plain", "plain", "plain", "turned"]
    assert bad.count() == 4 and good.count() == 7 and all(r.record and r.file.endswith(f"{r.run_id}.csv") for r in bad.collect())
    scans = good._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans == 3, "one read per layout: two of CSV, one of Parquet"


def test_what_is_no_run(spark, tmp_path):
    one = write(tmp_path / "a" / "p.csv", f"{HEAD}\na,t,f,q\n")
    two = write(tmp_path / "b" / "p.csv", f"{HEAD}\n")
    lacking = write(tmp_path / "c.csv", "table_id,task\na,t\n")
    rows, bad = runs.read_runs(spark, [one, two])
    assert [(r.run_id, r.table_id) for r in rows.collect()] == [("a/p", "a")] and bad.count() == 0
    for paths, names in (([one, one], None), ([one, str(tmp_path / "a")], None), ([lacking], None), ([], None), ([one, two], ["x", "x"]), ([one, two], ["x"])):
        with pytest.raises(ValueError):
            runs.read_runs(spark, paths, names)
    with pytest.raises(FileNotFoundError, match="nowhere"):
        results.read_predictions(spark, [one, str(tmp_path / "nowhere")])


def test_judging_sets_malformed_records_aside(spark, tmp_path):
    path = write(tmp_path / "p.csv", f"{HEAD},gold,raw\na,t,f,q,g,x\nb,t\n")
    out = str(tmp_path / "out")

    def make():
        return lambda batch: ['{"content_correct": true}'] * len(batch)

    for _ in range(2):
        assert [(r.run_id, r.table_id, r.content_correct) for r in run_judge(spark, [path], make, out).collect()] == [("p", "a", True)]
        assert [(r.run_id, r.record) for r in versions.load(spark, f"{out}_malformed").collect()] == [("p", "b,t")]


IDS = ["a", "b,c", 'say "x", \\', ",", "", " ]} ", "line\nend", "é ", '"table_ids": [', None, "7"] + [f"id-{i}" for i in range(3000)]


@pytest.mark.parametrize("shape", ["object", "indented", "bare", "parts"])
def test_id_lists_in_byte_ranges(spark, tmp_path, shape):
    """Ranges of 64 bytes end inside texts, escapes and brackets."""
    record = {"model": "m, [x]", "formats": ["tsv", "a\"]"], "n": 3, "table_ids": IDS, "after": ["z"]}
    path = tmp_path / "ids.json"
    if shape == "parts":
        rows = [(i, v) for i, v in enumerate(IDS)]
        ids = spark.createDataFrame(rows, "pos long, table_id string").repartition(4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            idlists.write_ids(ids, str(path), {"model": "m, ["}, "n")
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        parts = sorted(path.glob("part-*"))
        whole = json.loads("".join(p.read_text() for p in parts))
        assert len(parts) > 1 and whole == {"model": "m, [", "n": len(IDS), "table_ids": IDS}
    else:
        path.write_text({"object": json.dumps(record), "indented": json.dumps(record, indent=2, ensure_ascii=False), "bare": json.dumps(IDS)}[shape])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = [(r.ord, r.table_id) for r in corpus.read_selection(spark, str(path)).orderBy("ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == list(enumerate(IDS))


@pytest.mark.parametrize("text", ["[]", ' {"table_ids" : [ ] , "x": ["a"]}', '{"x": ["a"]}', ""])
def test_no_ids(spark, tmp_path, text):
    assert corpus.read_selection(spark, write(tmp_path / "ids.json", text)).collect() == []


def test_empty_id_list_written(spark, tmp_path):
    idlists.write_ids(spark.createDataFrame([], "pos long, table_id string"), str(tmp_path / "out"), {}, "n")
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))) == {"n": 0, "table_ids": []}


def test_each_text_is_evaluated_once(spark):
    texts = ["hot one"] * 500 + [f"w {i % 40} x" for i in range(200)] + [None] * 30 + [""] * 3
    random.Random(1).shuffle(texts)
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id int, text string, _count int").repartition(6).checkpoint()
    seen = spark.sparkContext.accumulator(0)

    def make_counter():
        def count(batch):
            seen.add(len(batch))
            return [len(t.split()) for t in batch]

        return count

    found = evaluate_distinct(rows, "text", lambda text: counted_tokens(text, make_counter), "n", "copies", hot_rows=100, spread=4).collect()
    assert seen.value == 42
    assert {r.id: (r.text, r.n, r.copies) for r in found} == {
        i: (t, None if t is None else len(t.split()), 0 if t is None else texts.count(t)) for i, t in enumerate(texts)
    }
    assert len(found) == len(texts) and found[0].__fields__ == ["id", "text", "_count", "n", "copies"]
    assert evaluate_distinct(rows.limit(0), "text", F.length, "n").collect() == []


@pytest.mark.parametrize("n", [1, 150, 299, 300, 5000])
def test_samples_of_any_size(spark, n):
    ids = [f"t{i}" for i in range(300)]
    tables = spark.createDataFrame([(i,) for i in ids], "table_id string").repartition(5)
    found = sample_tables(tables, n, seed=3).orderBy("draw").collect()
    wanted = sorted(ids, key=lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest())[:n]
    assert [(r.draw, r.table_id) for r in found] == list(enumerate(wanted))
