"""Preparation of task tables from raw benchmark rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import cases, pytext
from tracemill.schemas import CASE

from .relational import first_per_key


def _pick(df: DataFrame, *names: str):
    there = [F.col(n) for n in names if n in df.columns]
    return pytext.filled(*there) if there else F.lit("")


def _arrays(df: DataFrame, *names: str):
    there = [F.col(n) if df.schema[n].dataType.simpleString() != "string" else F.when(F.coalesce(F.col(n), F.lit("")) != "", F.array(n)) for n in names if n in df.columns]
    return pytext.first_items(*there) if there else F.array().cast("array<string>")


def train_tasks(rows: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Train tasks of raw rows (task_id, split_ord, ord and text fields): excluded numbers (num_id) go, the first row of a number stays.

    An id without a number is an error.
    """
    number = pytext.numeric_id(F.col("task_id").cast("string"))
    keyed = rows.withColumn("num_id", F.coalesce(number, F.raise_error(F.concat(F.lit("task_id without a number: "), F.coalesce(F.col("task_id").cast("string"), F.lit("null")))).cast("bigint")))
    kept = keyed if excluded is None else keyed.join(excluded, "num_id", "left_anti")
    first = first_per_key(kept, ["num_id"], [c for c in ("split_ord", "ord") if c in rows.columns])
    return first.select(
        F.concat(F.lit("mbpp_"), "num_id").alias("task_id"), _pick(rows, "text", "prompt", "description").alias("prompt"), _arrays(rows, "test_list", "test_cases").alias("test_cases"),
        _pick(rows, "code", "code_solution").alias("code_solution"), F.lit("mbpp_full").alias("source"), F.lit("mbpp_train").alias("benchmark"), F.lit(False).alias("synthetic"), *(c for c in ("split_ord", "ord") if c in rows.columns),
    )


def assert_lines(block):
    """The stripped lines that start with 'assert '."""
    return F.filter(F.transform(pytext.splitlines(F.coalesce(block, F.lit(""))), pytext.strip), lambda s: s.startswith("assert "))


def eval_tasks(problems: DataFrame, extra=None) -> DataFrame:
    """Primary evaluation tasks: the assert lines of assertion, then extra (array of asserts); none at all is an error."""
    base = assert_lines(F.col("assertion"))
    more = F.coalesce(extra, F.array().cast("array<string>")) if extra is not None else F.array().cast("array<string>")
    tests = F.concat(base, more)
    checked = F.when(F.size(tests) > 0, tests).otherwise(F.raise_error(F.concat(F.lit("no tests for "), "task_id")).cast("array<string>"))
    return problems.select(
        F.col("task_id").cast("string").alias("task_id"), F.coalesce("prompt", F.lit("")).alias("prompt"), F.coalesce("entry_point", F.lit("")).alias("entry_point"), checked.alias("test_cases"),
        F.size(base).cast("bigint").alias("n_base_tests"), F.size(more).cast("bigint").alias("n_plus_tests"), F.coalesce("canonical_solution", F.lit("")).alias("code_solution"),
        F.lit("evalplus_mbpp_plus").alias("source"), F.lit("mbpp_plus").alias("benchmark"), F.lit(False).alias("synthetic"),
    )


def case_tasks(rows: DataFrame, dataset: str) -> DataFrame:
    """Secondary evaluation tasks: easy rows (or without a difficulty) with a prompt and readable cases; rows without an id are named by ord."""
    level = F.lower(F.coalesce(*(F.col(c) for c in ("difficulty", "level") if c in rows.columns), F.lit("")))
    raw = _pick(rows, "public_test_cases", "input_output", "test_cases", "tests")
    found = cases.public_cases(raw)
    named = cases.with_function(found, cases.metadata_function(F.col("metadata"))) if "metadata" in rows.columns else found
    given = [F.col(c).cast("string") for c in ("question_id", "task_id") if c in rows.columns]
    fallback = F.col("ord").cast("string") if "ord" in rows.columns else F.lit("0")
    built = rows.where(level.isin("", "easy", "e")).select(
        F.concat(F.lit("lcb_"), F.coalesce(*given, fallback)).alias("task_id"), _pick(rows, "question_content", "prompt", "problem", "question").alias("prompt"), F.lit("lcb").alias("harness"),
        named.cast(f"array<{CASE}>").alias("lcb_tests"), F.array().cast("array<string>").alias("test_cases"), F.lit("easy").alias("difficulty"), F.lit("livecodebench_easy").alias("source"),
        F.lit("lcb_easy").alias("benchmark"), F.lit(dataset).alias("dataset"), F.lit(False).alias("synthetic"),
    )
    return built.where((F.col("prompt") != "") & (F.size("lcb_tests") > 0))


def training_rows(tasks: DataFrame, max_tasks: int | None = None) -> DataFrame:
    """(ord, messages, test_cases, task_id, raw_prompt) for a policy trainer, the first max_tasks by ord."""
    from tracemill.functions import messages

    prompt, tests = _pick(tasks, "prompt", "text"), _arrays(tasks, "test_cases", "test_list")
    out = tasks.select("ord", messages.coding(prompt, F.slice(tests, 1, 1)).alias("messages"), tests.alias("test_cases"), F.coalesce(F.col("task_id"), F.concat(F.lit("task_"), "ord")).alias("task_id"), prompt.alias("raw_prompt"))
    return out if max_tasks is None else out.orderBy("ord").limit(max_tasks)


def checked(tasks: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """The prepared tasks of a known dataset; an error if there are none, or (strict) fewer than the dataset must have."""
    from .gates import REGISTRY, require_rows

    require_rows(tasks, REGISTRY[key]["min_rows"], strict)
    return tasks


def write_checked(tasks: DataFrame, key: str, folder: str, *, strict: bool = True) -> DataFrame:
    """Writes the prepared tasks of a known dataset as JSON Lines, in one job with its gates, and gives the violations of what was written.

    Strict: the rows come to folder only if there is no violation; else they stay in folder's neighbour ``_refused``, and it is an error.
    """
    from tracemill.sources import jsonl

    from .gates import require, written

    spark, refused = tasks.sparkSession, f"{folder.rstrip('/')}_refused"
    found = written(tasks, key, lambda df: jsonl.write(df, refused), path=folder, allow_synthetic=not strict)
    if strict:
        require(found)
    jsonl.replace(spark, refused, folder)
    return found


def legacy_eval_tasks(*_args, **_kwargs):
    """The old evaluation source is refused: its rows were mislabelled."""
    raise RuntimeError("this evaluation source is disabled; use eval_tasks()")
