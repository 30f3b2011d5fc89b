"""Prediction runs of different layouts, as Parquet or CSV, in one read per layout.

A run is a path. Which run a row belongs to follows from the file it was read from, so that runs with equal columns share one scan, however many they are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprobe import fixed_values as fixed
from tabprobe import schemas
from tabprobe.functions.text import unescape_newlines

#: Empty strings are written quoted; NULL has its own mark, as in database dumps.
CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\\N"}
MALFORMED = "run_id STRING, file STRING, record STRING"
_SCHEME = r"^([^:/]+):/+"
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _root(spark: SparkSession, path: str) -> tuple[str, str]:
    """(the path as files below it name it, the first data file below it, relative to the path)."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(context._jsc.hadoopConfiguration())

    def name(of) -> str:
        return re.sub(_SCHEME, r"\1:/", fs.makeQualified(of).toUri().toString())

    root = name(place).rstrip("/")
    files = fs.listFiles(place, True)
    while files.hasNext():
        relative = name(files.next().getPath()).removeprefix(root).lstrip("/")
        if not any(part.startswith(("_", ".")) for part in relative.split("/")):
            return root, relative
    raise FileNotFoundError(f"No data below {path}")


def run_names(paths: Sequence[str]) -> list[str]:
    """The last element of each path, without ``run_id=`` or ``.csv``; where that repeats, the last two."""
    for length in (1, 2):
        names = ["/".join(p.rstrip("/").split("/")[-length:]).removeprefix("run_id=").removesuffix(".csv") for p in paths]
        if len(set(names)) == len(names):
            return names
    raise ValueError("Some runs have the same name: pass run_ids")


def _run_of(file: Column, roots: dict[str, str]) -> Column:
    return F.coalesce(*[F.when((file == root) | file.startswith(root + "/"), F.lit(run)) for root, run in roots.items()])


def _decoded(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _folder_value(file: Column, field: T.StructField) -> Column:
    """A partition column's value: escaped in the folder's name, which is escaped again in the file's."""
    value = _decoded(_decoded(F.regexp_extract(file, f"/{re.escape(field.name)}=([^/]*)/", 1)))
    return F.when(value != "__HIVE_DEFAULT_PARTITION__", value).cast(field.dataType)


def _converted(name: str, kind: T.DataType) -> Column:
    """A CSV text as ``kind``, NULL if it is none; whole numbers may be written with a fraction of zero."""
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(name, kind)
    if isinstance(kind, _WHOLE):
        number = F.col(name).try_cast("double")
        return F.coalesce(F.col(name).try_cast(kind), F.when(number == F.floor(number), number.cast("string").try_cast("decimal(38,0)").try_cast(kind)))
    return F.col(name).try_cast(kind)


def _parquet(spark: SparkSession, paths: Sequence[str], fields: Sequence[T.StructField], folders: Sequence[str], roots: dict[str, str]) -> DataFrame:
    stored = T.StructType([f for f in fields if f.name not in folders])
    rows = spark.read.schema(stored).option("recursiveFileLookup", True).parquet(*paths)
    file = F.regexp_replace(F.col("_metadata.file_path"), _SCHEME, "$1:/")
    inner = [_folder_value(file, f).alias(f.name) if f.name in folders else F.col(f.name) for f in fields if f.name != "run_id"]
    return rows.select(*inner, _run_of(file, roots).alias("run_id"))


def _csv(
    spark: SparkSession, paths: Sequence[str], names: Sequence[str], kinds: dict[str, T.DataType], roots: dict[str, str]
) -> tuple[DataFrame, DataFrame]:
    texts = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_malformed"]])
    # a file whose header differs from its run's is an error, not a shift of columns
    reader = spark.read.options(**CSV, columnNameOfCorruptRecord="_malformed", enforceSchema="false", recursiveFileLookup="true")
    file = F.regexp_replace(F.col("_metadata.file_path"), _SCHEME, "$1:/")
    rows = reader.schema(texts).csv(list(paths)).select("*", file.alias("_file"))
    typed = {n: _converted(n, kinds[n]) for n in names if not isinstance(kinds.get(n, T.StringType()), T.StringType)}
    broken = F.col("_malformed").isNotNull() | F.col("table_id").isNull()
    for name, value in typed.items():
        broken = broken | (F.col(name).isNotNull() & value.isNull())
    if "raw" in names:
        typed["raw"] = unescape_newlines(F.col("raw"))
    run = _run_of(F.col("_file"), roots).alias("run_id")
    good = rows.filter(~broken).select(*[typed.get(n, F.col(n)).alias(n) for n in names if n != "run_id"], run)
    record = F.coalesce("_malformed", F.to_json(F.struct(*names)))
    return good, rows.filter(broken).select(run, F.col("_file").alias("file"), record.alias("record"))


def read_runs(spark: SparkSession, paths: Sequence[str], run_ids: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed): all runs in one frame with ``run_id``, and the CSV records that are none, with run, file and text.

    A path is a file or a folder, CSV or Parquet; its first data file tells which. Runs of equal columns are one scan; columns that a run lacks
    are NULL there, and CSV texts take the types that the runs in Parquet, or else ``schemas.PREDICTIONS``, give them; other columns are texts.
    A record is malformed if it has too few or too many fields, a text where a number belongs, or no ``table_id``; an empty field
    without quotes is NULL. Missing paths, paths named
    twice or inside each other, names that repeat, and runs without the columns of the key are errors. An empty file or table has no rows.
    """
    if not paths:
        raise ValueError("No runs")
    if run_ids is not None and len(run_ids) != len(paths):
        raise ValueError("run_ids must have the same length as paths")
    names = list(run_ids) if run_ids is not None else run_names(paths)
    if len(set(names)) != len(names):
        raise ValueError("Some runs have the same name")
    roots: dict[str, str] = {}
    layouts: dict[tuple, list[tuple[str, str]]] = defaultdict(list)
    for path, name in zip(paths, names):
        root, first = _root(spark, path)
        if any(f"{root}/".startswith(f"{other}/") or f"{other}/".startswith(f"{root}/") for other in roots):
            raise ValueError(f"{path} is named twice, or inside another run")
        roots[root] = name
        if ".csv" in (first or root).rsplit("/", 1)[-1]:
            fields: tuple = tuple(spark.read.options(**CSV, recursiveFileLookup="true").csv(path).columns)
            layout = ("csv", fields, ())
        else:
            folders = tuple(p.split("=")[0] for p in first.split("/")[:-1] if "=" in p)
            schema = spark.read.parquet(path).schema
            fields, layout = tuple(schema.names), ("parquet", tuple(schema.fields), folders)
        lacking = [c for c in fixed.INSTANCE_KEY if c not in fields]
        if lacking:
            raise ValueError(f"{path} lacks {', '.join(lacking)}")
        layouts[layout].append((path, root))
    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(schemas.PREDICTIONS).fields}
    for kind, fields, _ in layouts:
        if kind == "parquet":
            kinds.update({f.name: f.dataType for f in fields})
    frames, broken = [], [spark.createDataFrame([], MALFORMED)]
    for (kind, fields, folders), members in layouts.items():
        where, own = [path for path, _ in members], {root: roots[root] for _, root in members}
        if kind == "parquet":
            frames.append(_parquet(spark, where, fields, folders, own))
        else:
            good, bad = _csv(spark, where, fields, kinds, own)
            frames.append(good)
            broken.append(bad)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), reduce(DataFrame.unionByName, broken)
