from collections import Counter

from pyspark.sql import functions as F

from tabprobe.fixed_values import TASKS_PER_TABLE
from tabprobe.operators.ingest import cells
from tabprobe.functions.picks import indexes, pick, ranked
from tabprobe.operators.serialise import build_instances, generate_instances, plan_instances
from tabprobe.operators.tasks import _with_cells, generate_tasks, tasks_by_table, unique_values, value_positions
from tabprobe.plans import catalogue
from tabprobe.sources import corpus

SCHEMA = "table_id string, pos long, header array<string>, rows array<array<string>>"

# A public question-answering table with the tasks drawn for it at seed 42.
CLUBS = (
    ["Team", "County", "Wins", "Years won"],
    [
        ["Greystones", "Wicklow", "1", "2011"],
        ["Ballymore Eustace", "Kildare", "1", "2010"],
        ["Maynooth", "Kildare", "1", "2009"],
        ["Ballyroan Abbey", "Laois", "1", "2008"],
        ["Fingal Ravens", "Dublin", "1", "2007"],
        ["Confey", "Kildare", "1", "2006"],
        ["Crettyard", "Laois", "1", "2005"],
        ["Wolfe Tones", "Meath", "1", "2004"],
        ["Dundalk Gaels", "Louth", "1", "2003"],
    ],
)


def frame(spark, **tables):
    rows = [(name, i, *table) for i, (name, table) in enumerate(tables.items())]
    return spark.createDataFrame(rows, SCHEMA)


def test_known_draws(spark):
    tasks = generate_tasks(frame(spark, **{"nt-2": CLUBS}), sampler="mt19937").collect()
    picked = [(t.question, t.gold) for t in sorted(tasks, key=lambda t: t.task_seq)]
    assert picked[0][1] == "9 rows, 4 columns"
    assert picked[1] == ("What value is in row 2, column 'Years won'?", "2010")
    assert picked[2] == ("What value is in row 1, column 'County'?", "Wicklow")
    assert picked[3] == ("What value is in row 5, column 'County'?", "Dublin")
    assert [g for _, g in picked[4:6]] == ["row 3, column 'Team'", "row 2, column 'Team'"]
    assert "'Maynooth'" in picked[4][0] and "'Ballymore Eustace'" in picked[5][0]
    assert "'Louth'" in picked[6][0] and len(picked) == 11


def test_golds_are_true(spark):
    header, rows = CLUBS
    for sampler in ("hash", "mt19937"):
        tasks = generate_tasks(frame(spark, a=CLUBS, b=CLUBS), sampler=sampler).collect()
        assert Counter(t.task for t in tasks) == {k: 2 * n for k, n in TASKS_PER_TABLE.items()}
        values = Counter(v for row in rows for v in row)
        for t in tasks:
            if t.task == "reverse_lookup":
                value = t.question.split("'")[1]
                row, column = t.gold[4:].split(", column ")
                assert values[value] == 1
                assert rows[int(row) - 1][header.index(column.strip("'"))] == value
            if t.task == "col_retrieval":
                c = header.index(t.question.split("'")[1])
                assert t.gold == "\n".join(row[c] for row in rows)
            if t.task == "row_retrieval":
                assert t.gold == "\n".join(rows[int(t.question.split()[5].rstrip(",")) - 1])


def test_hash_draws_differ_between_tables(spark):
    tasks = generate_tasks(frame(spark, a=CLUBS, b=CLUBS), kinds=["cell_lookup"]).collect()
    by_table = {name: {t.question for t in tasks if t.table_id == name} for name in "ab"}
    assert len(by_table["a"]) == 3 and by_table["a"] != by_table["b"]


def test_positions_of_nested_tables_and_cells(spark):
    tables = frame(
        spark, t=(["a", "b"], [["x", "y"], ["y", "x", "z", "x"], ["z"], []]), u=(["a"], []), v=(["a"], [[""], ["é"], [""], [None], [None]]), w=([], [])
    )
    for function in (value_positions, unique_values):
        assert sorted(map(tuple, function(tables).collect()), key=repr) == sorted(map(tuple, function(cells(tables)).collect()), key=repr)
        assert function(tables).schema.simpleString() == function(cells(tables)).schema.simpleString()
    found = {(r.table_id, r.value): (r.row_idx, r.col_idx, r.n_pos) for r in value_positions(tables).collect()}
    assert found["t", "x"] == (0, 0, 3) and found["t", "z"] == (1, 2, 2) and found["v", None] == (3, 0, 2) and found["v", ""] == (0, 0, 2)
    assert "Exchange" not in value_positions(tables)._jdf.queryExecution().executedPlan().toString()


def test_too_few_unique_values(spark):
    small = (["x", "y"], [["1", "1"], ["1", "2"]])
    for sampler in ("hash", "mt19937"):
        tasks = generate_tasks(frame(spark, t=small), sampler=sampler).collect()
        lookups = [t for t in tasks if t.task == "reverse_lookup"]
        assert [t.gold for t in lookups] == ["row 2, column 'y'"]
        assert [t.task_seq for t in sorted(tasks, key=lambda t: t.task_seq)] == list(range(len(tasks)))


def test_ragged_and_tiny_tables(spark):
    ragged = (["a", "b"], [["1"], ["2", "3", "4"]])
    tiny = (["a"], [["v"]])
    tasks = generate_tasks(frame(spark, r=ragged, t=tiny)).collect()
    assert sorted(t.gold for t in tasks if t.table_id == "r" and t.task == "cell_lookup") == ["1", "2", "3"]
    assert Counter(t.task for t in tasks if t.table_id == "t") == dict.fromkeys(TASKS_PER_TABLE, 1)
    only = generate_tasks(frame(spark, e=(["a"], [[]])), kinds=["cell_lookup"]).collect()
    assert only == []


def test_positions(spark):
    found = {
        r.value: (r.row_idx, r.col_idx, r.n_pos)
        for r in value_positions(cells(frame(spark, t=(["a", "b"], [["x", "y"], ["y", "x"], ["z", "y"]])))).collect()
    }
    assert found == {"x": (0, 0, 2), "y": (0, 1, 3), "z": (2, 0, 1)}
    single = unique_values(cells(frame(spark, t=(["a"], [["x"], ["x"], ["z"]])))).collect()
    assert [(r.value, r.row_idx) for r in single] == [("z", 2)]


def test_joined_and_direct_instances_agree(spark):
    tables = frame(spark, a=CLUBS, b=(["a"], [["v"], ["w"]]))
    tasks = generate_tasks(tables)
    columns = ["table_id", "task_seq", "fmt", "question", "table_text", "text_tokens"]
    joined = build_instances(tasks, tables, ["tsv", "json"]).select(columns)
    direct = generate_instances(tables, ["tsv", "json"]).select(columns)
    assert sorted(joined.collect()) == sorted(direct.collect())
    planned = plan_instances(tasks, ["tsv", "json"]).filter("not (fmt = 'json' and task_seq > 2)")
    some = build_instances(planned, tables, ["tsv", "json"]).select(columns)
    assert sorted(some.collect()) == sorted(
        r for r in direct.collect() if not (r.fmt == "json" and r.task_seq > 2)
    )
    stray = build_instances(tasks, tables.filter("table_id = 'a'"), ["tsv"])
    assert stray.filter("table_id <> 'a'").count() == 0


def test_grouped_tasks_keep_their_order(spark):
    grouped = tasks_by_table(generate_tasks(frame(spark, a=CLUBS))).first()
    assert [t.task_seq for t in grouped.tasks] == list(range(11))


def test_many_tasks_of_one_table(spark):
    tables = frame(spark, a=CLUBS, b=CLUBS)
    tasks = spark.range(0, 20000, 1, 4).select(
        F.when(F.col("id") < 19000, "a").otherwise("b").alias("table_id"), F.col("id").cast("int").alias("task_seq"),
        F.concat(F.lit("q"), "id").alias("question"),
    )
    built = build_instances(tasks, tables, ["tsv"])
    assert built.count() == 20000 and built.select("table_text").distinct().count() == 1
    copies = tasks.withColumn("task_seq", F.lit(1))
    assert build_instances(copies, tables, ["tsv"], measure=False).count() == 20000


def test_slots_and_runs_of_ragged_tables(spark):
    """Slots in order without a sort, also of short and long rows; first and only occurrences; picks like a full ranking."""
    grid = [["b", "a", "x"], ["a"], [], ["c", "b"]]
    found = _with_cells(frame(spark, t=(["h", "k"], grid), u=([], [["a"]]), v=(["h"], [])), [])
    rows = {r.table_id: (r._slots, r._firsts, r._uniques) for r in found.collect()}
    assert rows == {"t": ([0, 1, 2, 6, 7], [0, 1, 6], [6]), "u": ([], [], []), "v": ([], [], [])}
    assert "sort_array" not in found.select("_slots")._jdf.queryExecution().optimizedPlan().toString()
    items = spark.range(50).select(F.col("id").cast("string").alias("table_id"), indexes(F.col("id").cast("int")).alias("items"))
    both = items.select(
        pick(7, F.col("table_id"), "cell", F.col("items"), 4).alias("few"),
        F.slice(ranked(7, F.col("table_id"), "cell", F.col("items")), 1, 4).alias("ranked"),
    )
    assert both.filter("few != ranked").count() == 0
    assert both.filter("size(few) = 4").count() == 46


def test_tasks_written_in_both_forms(spark, tmp_path):
    tasks = generate_tasks(frame(spark, a=CLUBS, b=(["x"], [["1"], ["2"]]))).withColumn("note", F.col("task_seq") % 2)
    corpus.write_tasks(tasks, str(tmp_path), 42, "here", compression="gzip")
    stored = spark.read.parquet(f"{tmp_path}/tasks")
    assert stored.columns == tasks.columns and sorted(map(str, stored.collect())) == sorted(map(str, tasks.collect()))
    wanted = tasks_by_table(tasks)
    objects = spark.read.schema(wanted.schema).json(f"{tmp_path}/tasks_by_table")
    assert sorted(map(str, objects.collect())) == sorted(map(str, wanted.collect()))
    assert spark.read.json(f"{tmp_path}/manifest").first().n_task_rows == tasks.count()
    files = [p.name for p in (tmp_path / "tasks_by_table").iterdir() if p.name.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files) and not (tmp_path / "_packs").exists()


def test_checked_draws_search_a_question_once(spark, tmp_path):
    line = spark.range(40).select(
        (F.col("id") % 5).alias("l_orderkey"), F.col("id").cast("int").alias("l_linenumber"), (F.col("id") % 3).alias("l_partkey"), (F.col("id") % 2).alias("l_suppkey"),
        *[F.col("id").cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
        F.lit("N").alias("l_returnflag"), F.lit("it's").alias("l_linestatus"), F.lit("2020-01-02").cast("date").alias("l_shipdate"),
    )
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    checked = catalogue.tasks_mt19937_checked(spark, str(tmp_path))
    # a value that each cell is compared with is found outside of the comparison
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("the value '(.*)' appear") == 1
    rows = checked.collect()
    assert len(rows) == 5 and all((r.n_size_detection, r.n_cell_lookup, r.n_reverse_lookup, r.n_row_retrieval, r.n_col_retrieval, r.n_right, r.n_different) == (1, 3, 3, 2, 2, 11, 11) for r in rows)
