"""JSON Lines sources and sinks.

Input order is semantic for these tables (first or last row wins, first N rows), so
scans carry the file name and line number. A file is read in splits. An index counts
each split's lines, and the sums of the counts before give the lines ahead of each place at which a split
begins; the scan numbers the lines of a split as it reads them, and adds those ahead of it. That needs nothing of a plan but that
lines of a split come in order: where the two scans are cut at different places, a place that is in the index has the right number,
and one that isn't is an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tracemill.functions import pytext

from . import statefile


#: So many files at most have their blocks' first line numbers broadcast.
BROADCAST_FILES = 20_000


def _split_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def split_index(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, block, before): the lines of a file before each of its splits."""
    counts = _split_texts(spark, list(paths)).groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("path", "block", F.coalesce(ahead, F.lit(0)).alias("before"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds place, each line's number in its split, from 1: a task reads a split from its begin to its end."""
    last, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        path = batch.column("path").dictionary_encode()
        codes = path.indices.to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (codes[1:] != codes[:-1])]))
        place = np.arange(1, batch.num_rows + 1) - np.repeat(starts, np.diff(np.append(starts, batch.num_rows)))
        if (path[0].as_py(), block[0]) == last:
            place[: starts[1] if len(starts) > 1 else batch.num_rows] += n
        last, n = (path[batch.num_rows - 1].as_py(), block[-1]), int(place[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "place"])


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, file, line_no, value) of all lines, blank ones too; files in order of their names."""
    raw = _split_texts(spark, list(paths))
    numbered = raw.mapInArrow(_numbered, "value string, path string, file string, block bigint, place bigint")
    index = split_index(spark, *paths)
    # a row a split of a file: 128 MB of input each, so a broadcast holds for the splits of terabytes; beyond, a shuffle
    index = F.broadcast(index) if len(raw.inputFiles()) <= BROADCAST_FILES else index
    before = F.coalesce("before", F.raise_error(F.concat("path", F.lit(": no lines counted before byte "), "block")).cast("bigint"))
    return numbered.join(index, ["path", "block"], "left").select("path", "file", (before + F.col("place")).alias("line_no"), "value")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path).schema  # noqa: B018
        return True
    except AnalysisException:
        return False


def read(spark: SparkSession, paths: str | list[str], schema: str, *, mode: str = "strict", missing_ok: bool = False, max_rows: int | None = None) -> DataFrame:
    """Rows of the schema, with file and line_no; blank lines are skipped.

    mode: strict (a malformed line is an error that names its place), quarantine (such lines
    come with their text in column corrupt) or skip. max_rows keeps the first rows by place.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if missing_ok:
        paths = [p for p in paths if _exists(spark, p)]
        if not paths:
            return spark.createDataFrame([], f"{schema}, path string, file string, line_no bigint, corrupt string")
    kept = lines(spark, *paths).withColumn("value", pytext.strip(F.col("value"))).where("value <> ''")
    parsed = kept.select("path", "file", "line_no", "value", F.from_json("value", f"{schema}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("row"))
    bad = F.col("row.corrupt").isNotNull() | ~F.col("value").startswith("{")
    if mode == "strict":
        parsed = parsed.withColumn("row", F.when(bad, F.raise_error(F.concat(F.col("file"), F.lit(":"), F.col("line_no"), F.lit(": invalid JSON line"))).cast(parsed.schema["row"].dataType)).otherwise(F.col("row")))
    elif mode == "skip":
        parsed = parsed.where(~bad)
    else:
        parsed = parsed.withColumn("row", F.when(bad, F.col("row").withField("corrupt", F.col("value"))).otherwise(F.col("row")))
    if max_rows is not None:
        parsed = parsed.orderBy("path", "line_no").limit(max_rows)
    names = [f.name for f in parsed.schema["row"].dataType if f.name != "corrupt"]
    return parsed.select(*(F.col(f"row.{n}").alias(n) for n in names), "path", "file", "line_no", F.col("row.corrupt").alias("corrupt"))


def ids(spark: SparkSession, path: str, field: str = "task_id") -> DataFrame:
    """Distinct ids of a file that may be missing; malformed lines and lines without the field don't count."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{field} string")
    return spark.read.text(path).select(F.get_json_object("value", f"$.{field}").alias(field)).where(F.col(field).isNotNull()).distinct()


def excluded_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(num_id) of a file of tasks; a malformed line or an id without a number is an error that names its place."""
    found = read(spark, path, "task_id string")
    number = pytext.numeric_id(F.col("task_id"))
    return found.select(F.coalesce(number, F.raise_error(F.concat("file", F.lit(":"), "line_no", F.lit(": invalid task_id"))).cast("bigint")).alias("num_id")).distinct()


def entries(spark: SparkSession, folder: str) -> dict[str, str]:
    """Name to path of a folder's entries, in any store that Spark reads; none if there is no folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName(): s.getPath().toString() for s in fs.listStatus(place)} if fs.exists(place) else {}


def audit_dir(spark: SparkSession, root: str) -> str | None:
    """The first of root and its parent that has a reward_audit folder with a rank file."""
    for base in (root.rstrip("/"), root.rstrip("/").rpartition("/")[0]):
        if any(re.fullmatch(r"reward_rank.*\.jsonl", name) for name in entries(spark, f"{base}/reward_audit")):
            return f"{base}/reward_audit"
    return None


def union_splits(splits: dict[str, DataFrame], preferred: tuple[str, ...] = ("train", "test", "validation", "prompt")) -> DataFrame:
    """All preferred splits in the given order, with (split_ord, split); other splits are left out."""
    found = [splits[s].withColumns({"split_ord": F.lit(k), "split": F.lit(s)}) for k, s in enumerate(preferred) if s in splits]
    if not found:
        raise ValueError(f"none of the splits {preferred}")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def first_split(splits: dict[str, DataFrame], preferred: tuple[str, ...]) -> DataFrame:
    """The first preferred split that is there, else the first of all."""
    return next((splits[s] for s in preferred if s in splits), next(iter(splits.values())))


def profile(df: DataFrame, sample: int = 5) -> DataFrame:
    """One row: n, empty, sources (sorted), synthetic_rows, sample_task_ids (the first by order)."""
    head = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "task_id"))), lambda r: r["task_id"]), 1, sample)
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.nullif("source", F.lit("")))).alias("sources"), F.count_if("synthetic").alias("synthetic_rows"))
    return counts.withColumn("empty", F.col("n") == 0).crossJoin(df.orderBy("ord").limit(sample).agg(head.alias("sample_task_ids")))


def inspect(spark: SparkSession, path: str, sample: int = 5) -> DataFrame:
    """profile() of a task file with whether it exists; a missing one has no rows."""
    schema = "task_id string, source string, synthetic boolean"
    rows = read(spark, path, schema, missing_ok=True).withColumn("ord", F.struct("path", "line_no"))
    return profile(rows, sample).withColumn("exists", F.lit(_exists(spark, path)))


def write(df: DataFrame, path: str, *, order: list[str] | None = None, mode: str = "overwrite", one_file: bool = False) -> None:
    """One JSON object a line. With order the files follow it; one_file is for parity with single-file readers."""
    drop = [c for c in ("path", "file", "line_no", "corrupt") if c in df.columns]
    names = [c for c in df.columns if c not in drop]
    out = df.orderBy(*order) if order else df
    out = out.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))
    (out.coalesce(1) if one_file else out).write.mode(mode).text(path)


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Moves a folder to the place of another, in any store that Spark reads."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fs_path(target), True)
    if not fs.rename(fs_path(source), fs_path(target)):
        raise OSError(f"{source} can't be moved to {target}")


def append_new(df: DataFrame, path: str, key: str = "task_id") -> None:
    """Appends the rows whose key isn't in the output yet, so a rerun adds nothing twice."""
    write(df.join(ids(df.sparkSession, path, key), key, "left_anti"), path, mode="append")


def write_ranked(df: DataFrame, path: str) -> None:
    """Appends rows to one folder for each rank."""
    df.write.mode("append").partitionBy("rank").json(path)


def write_document(doc: dict, path: str, spark: SparkSession | None = None) -> None:
    """A whole document or the one before; with a session in any store that Spark reads."""
    statefile.replace(json.dumps(doc, indent=2, ensure_ascii=False), path, spark)


def read_document(path: str, spark: SparkSession | None = None) -> dict:
    return statefile.read(path, spark)[0] or {}
