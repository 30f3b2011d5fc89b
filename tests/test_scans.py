"""Source order, early stop, sweep of intervals, control grid, versions, incremental summaries."""

import random

import pytest
from pyspark.sql import functions as F

from tabprobe.functions.markup import counted_tokens
from tabprobe.operators import markup, prompts, resume, selection, summary
from tabprobe.operators.numbering import number_source_rows, source_order
from tabprobe.operators.serialise import generate_instances
from tabprobe.sources import corpus, results, versions
from tabprobe.streaming.incremental import arriving, incremental_summaries, summaries_now


def jobs_run(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup())


def test_rows_keep_the_order_of_their_files(spark, tmp_path):
    for part, (low, high) in {"a": (0, 50), "b": (50, 51), "c": (51, 400)}.items():
        (tmp_path / f"{part}.json").write_text("".join(f'{{"v": {v}, "k": {v % 3}}}\n' for v in range(low, high)))
    raw = spark.read.schema("v long, k long").json(str(tmp_path))
    before = jobs_run(spark)
    kept = number_source_rows(source_order(raw).filter("v % 7 != 0"))
    keyed = number_source_rows(source_order(raw), key=["k"], name="seq")
    assert jobs_run(spark) == before
    wanted = [v for v in range(400) if v % 7]
    assert sorted((r.pos, r.v) for r in kept.collect()) == list(enumerate(wanted))
    assert all(r.seq == r.v // 3 for r in keyed.collect())
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and kept.columns == ["v", "k", "pos"]


def test_unknown_tables_go_before_tasks_are_sorted(spark, tmp_path):
    rows = [(f"t{i % 7}" if i % 11 else None, "cell_lookup", f"q{i}", "g", 1, 2) for i in range(600)]
    tasks = spark.createDataFrame(rows, "table_id string, task string, question string, gold string, n_rows int, n_cols int")
    tasks.coalesce(1).write.option("maxRecordsPerFile", 90).json(str(tmp_path / "tasks"))
    ids = spark.createDataFrame([("t1",), ("t1",), ("t5",), (None,), ("t9",)], "table_id string")
    known = corpus.read_tasks(spark, str(tmp_path / "tasks"), ids)
    everything = corpus.read_tasks(spark, str(tmp_path / "tasks"))
    assert sorted(map(tuple, known.collect())) == sorted(tuple(r) for r in everything.collect() if r.table_id in ("t1", "t5"))
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window [row_number") < plan.index("LeftSemi")


def test_empty_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    raw = spark.read.schema("v long").json(str(tmp_path))
    assert number_source_rows(source_order(raw)).collect() == []


@pytest.mark.parametrize("n", [1, 8, 500])
def test_scan_stops_early(spark, n):
    """Tables of growing size; every third is too long. What was built shows in an accumulator."""
    tables = spark.range(400).select(
        F.col("id").cast("string").alias("table_id"), (F.col("id") * 3).alias("pos"), F.array(F.lit("h"), F.lit("i")).alias("header"),
        F.transform(F.sequence(F.lit(1), F.when(F.col("id") % 3 == 0, 60).otherwise(2).cast("int")), lambda i: F.array(i.cast("string"), F.lit("x"))).alias("rows"),
    ).checkpoint()
    built = spark.sparkContext.accumulator(0)

    def make_counter():
        def count(texts):
            built.add(len(texts))
            return [len(t.split()) for t in texts]

        return count

    def measure(some):
        instances = generate_instances(some, ["tsv"], measure=False, kinds=["size_detection"])
        return prompts.build_prompts(instances, count_tokens=lambda text: counted_tokens(text, make_counter))

    report, sized = selection.scan_until(tables, measure, 150, n)
    seen = selection.scanned_until(report, n).collect()
    complete = [i for i in range(400) if i % 3]
    last = complete[n - 1] if n <= len(complete) else 399
    assert sorted(int(r.table_id) for r in seen) == list(range(last + 1))
    assert sorted(int(r.table_id) for r in selection.first_complete(report, n).collect()) == complete[:n]
    assert built.value == report.count() <= max(2 * (last + 1), n)
    found = selection.diagnostics(selection.scanned_until(report, n), sized, 150).collect()
    assert built.value == report.count() and all(len(r.failing_instances) == r.n_failing_instances for r in found)


@pytest.mark.parametrize("stretch", [5, 64, 1 << 16])
def test_sweep_against_all_pairs(spark, stretch):
    rng = random.Random(stretch)
    rows, wanted = [], set()
    for k in range(60):
        n = rng.randint(1, 150)
        cuts = sorted(rng.sample(range(n + 1), min(n + 1, rng.randint(2, 30))))
        tokens = [(a, b) for a, b in zip(cuts, cuts[1:]) if rng.random() < 0.8] + [(n, n)]
        edges = sorted(rng.sample(range(n + 1), min(n + 1, rng.randint(2, 20))))
        spans = list(zip(edges[::2], edges[1::2])) + [(n, n)]
        rows.append((k, tokens, spans))
        wanted |= {(k, i, a, b) for i, (a, b) in enumerate(tokens) if b > a and any(a < e and b > s for s, e in spans if e > s)}
    rows += [(100, [], [(0, 3)]), (101, [(0, 3)], []), (102, None, None)]
    kind = "array<struct<start:int,end:int>>"
    found = [tuple(r) for r in markup.swept_tokens(spark.createDataFrame(rows, f"k int, tokens {kind}, spans {kind}"), ["k"], stretch=stretch).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted


def test_sweep_needs_no_further_exchange(spark):
    rows = spark.range(100).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list(F.struct(F.col("id").cast("int").alias("start"), (F.col("id") + 1).cast("int").alias("end"))).alias("tokens"))
    swept = markup.swept_tokens(rows.withColumn("spans", F.col("tokens")), ["k"]).groupBy("k").count()
    assert swept._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_sweep_sorts_no_stream(spark):
    kind = "array<struct<start:int,end:int>>"
    rows = spark.createDataFrame([(1, [(0, 2), (2, 4), (5, 6), (8, 9)], [(0, 1), (0, 6), (2, 3)]), (2, [(3, 4), (0, 1)], [(3, 9), (3, 4)])], f"k int, tokens {kind}, spans {kind}")
    swept = markup.swept_tokens(rows, ["k"])
    assert sorted(tuple(r) for r in swept.collect()) == [(1, 0, 0, 2), (1, 1, 2, 4), (1, 2, 5, 6), (2, 0, 3, 4)]
    plan = swept._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Window", "Sort ", "Exchange"))


@pytest.mark.parametrize("masks", [20, 150])
def test_control_grid(spark, masks):
    key = ["table_id", "task", "fmt", "question"]
    instances = spark.createDataFrame([(str(i), "t", "f", None if i == 3 else f"q{i}", i) for i in range(6)], "table_id string, task string, fmt string, question string, n int")
    jobs = markup.control_jobs(instances, masks=masks)
    rng = random.Random(1)
    done = [(*[r[c] for c in key], r.patch_group, r.random_seed, None if rng.random() < 0.8 else "failed") for r in jobs.collect() if rng.random() < 0.6 and r.n != 5]
    done += [("9", "t", "f", "q9", "format_late", None, None), ("0", "t", "f", "q0", "random10pct", 7, None)]
    kind = "table_id string, task string, fmt string, question string, patch_group string, random_seed int, error string"
    finished = spark.createDataFrame(done + done[:10], kind)
    left = markup.pending_controls(instances, finished, masks=masks)
    wanted = resume.pending(jobs, finished.filter("error IS NULL"), [*key, "patch_group", "random_seed"])
    assert left.columns == jobs.columns
    assert sorted(map(str, left.collect())) == sorted(map(str, wanted.collect()))
    assert markup.control_marks(finished, key).count() <= 8


def test_control_grid_of_nulls_and_repeated_instances(spark):
    key = ["table_id", "task", "fmt", "question"]
    rows = [(None, "t", "f", "q", 1), (None, "t", "f", "q", 2), (None, None, None, None, 3), ("a", "t", "f", "q", 4), ("a", "t", "f", "q", 4), ("a", None, "f", "q", 5), ("b", "t", "f", None, 6)]
    instances = spark.createDataFrame(rows, "table_id string, task string, fmt string, question string, n int")
    jobs = markup.control_jobs(instances, masks=70)
    done = jobs.filter("n <> 6 AND coalesce(random_seed, 0) % 3 = n % 3").select(*key, "patch_group", "random_seed")
    left = markup.pending_controls(instances, done.unionByName(done.limit(5)), masks=70)
    wanted = resume.pending(jobs, done, [*key, "patch_group", "random_seed"])
    assert left.schema == jobs.schema
    assert sorted(map(str, left.collect())) == sorted(map(str, wanted.collect()))


def test_control_grid_stays_where_tables_are_dealt(spark):
    dealt = spark.range(60).groupBy((F.col("id") % 7).cast("string").alias("table_id")).agg(F.collect_list("id").alias("_ids"))
    instances = dealt.select("table_id", F.lit("t").alias("task"), F.lit("f").alias("fmt"), F.explode(F.col("_ids").cast("array<string>")).alias("question"))
    done = markup.control_jobs(instances).filter("random_seed % 2 = 0")
    left = markup.pending_controls(instances, done).groupBy("table_id", "question").count()
    # the deal of the tables, once for either side
    assert left._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert {r["count"] for r in left.collect()} == {11}


def test_replacement_survives_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "set")
    assert versions.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        versions.load(spark, path)
    versions.replace(spark.range(3), path)
    reader = versions.load(spark, path)
    with monkeypatch.context() as m:
        m.setattr(versions, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            versions.replace(spark.range(50), path)
    assert versions.load(spark, path).count() == 3
    versions.replace(versions.load(spark, path).filter("id > 0"), path)
    assert versions.load(spark, path).count() == 2 and reader.count() == 3
    versions.replace(spark.range(9), path)
    assert len([p for p in (tmp_path / "set").iterdir() if p.name.startswith("v-")]) == 2


def test_external_results_are_replaced(spark, tmp_path):
    kind, path = "id STRING, prediction_list ARRAY<STRING>", str(tmp_path / "merged")
    results.write_external(spark.createDataFrame([("10", ["a"]), ("9", ["b"])], kind), path)
    new = spark.createDataFrame([("10", ["c"])], kind)
    results.write_external(results.merge_external(results.read_external_results(spark, path, kind), new), path)
    assert [(r.id, r.prediction_list) for r in results.read_external_results(spark, path, kind).collect()] == [("9", ["b"]), ("10", ["c"])]


def test_summaries_over_batches(spark, tmp_path):
    kind = "k int, task string, fmt string, content_correct boolean, content_partial boolean, format_correct boolean, overinclusive boolean, instruction_following_error boolean, v int"
    rng = random.Random(8)
    values = [True, False, None]
    latest, folder = {}, str(tmp_path)
    for batch in range(4):
        rows = [(rng.randint(0, 12), rng.choice("ab"), rng.choice(["x", None]), *[rng.choice(values) for _ in range(5)], i) for i in range(8)]
        for r in rows:
            latest[r[0]] = r
        frame = spark.createDataFrame(rows, kind)
        frame.write.mode("append").parquet(f"{folder}/in")
        incremental_summaries(arriving(spark, f"{folder}/in", frame.schema), f"{folder}/out", f"{folder}/log", ["k"], ["v"]).awaitTermination()
    wanted = summary.summarise_all(spark.createDataFrame(list(latest.values()), kind))
    assert sorted(map(str, summaries_now(spark, f"{folder}/out").collect())) == sorted(map(str, wanted.collect()))
    # a batch that is repeated after a failure: the stream has forgotten that it finished
    for name in ("3", ".3.crc"):
        (tmp_path / "log" / "commits" / name).unlink()
    incremental_summaries(arriving(spark, f"{folder}/in", frame.schema), f"{folder}/out", f"{folder}/log", ["k"], ["v"]).awaitTermination()
    assert sorted(map(str, summaries_now(spark, f"{folder}/out").collect())) == sorted(map(str, wanted.collect()))


def test_format_named_null(spark):
    rows = [("t", None, True), ("t", "null", False), ("u", "null", True)]
    flags = [c for c in ("content_partial", "format_correct", "overinclusive", "instruction_following_error")]
    verdicts = spark.createDataFrame(rows, "task string, fmt string, content_correct boolean").withColumns({c: F.lit(True) for c in flags})
    found = {r.task: r.asDict() for r in summary.summarise_pivot(verdicts).collect()}
    assert found["t"]["null_n"] == 1 and found["t"]["null(missing)_n"] == 1 and found["u"]["null(missing)_n"] is None
    assert found["t"]["null_relaxed_accuracy"] == 0.0 and found["t"]["null(missing)_relaxed_accuracy"] == 1.0
