"""Evaluation of a model by mode: which tasks are generated for, once for each task, and which metrics are made of the outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import layers
from tracemill.schemas import SCORE_KEYS

from . import execution, gates, metrics

#: The modes, and whether they need the benchmarks and the readability scores.
MODES = {"full": (True, True), "hypothesis_check": (True, True), "benchmark": (True, False), "readability": (False, True)}
BENCHMARK_TASKS, READABILITY_TASKS = 200, 50


def work(primary: DataFrame, secondary: DataFrame | None, mode: str, num_benchmark: int = BENCHMARK_TASKS, num_readability: int = READABILITY_TASKS) -> DataFrame:
    """(bench, ord, ...) of the tasks to generate for, with the flags scored and read: one row, so one generation, for each task.

    The benchmarks take the first num_benchmark tasks of either, readability the first num_readability of the
    primary one; a task that both take is there once.
    """
    need_bench, need_read = MODES[mode]
    first = max(num_benchmark if need_bench else 0, num_readability if need_read else 0)
    rows = primary.orderBy("ord").limit(first).withColumn("bench", F.lit("primary"))
    if secondary is not None and need_bench:
        rows = rows.unionByName(secondary.orderBy("ord").limit(num_benchmark).withColumn("bench", F.lit("secondary")), allowMissingColumns=True)
    # places by a window over the few rows that a mode takes
    from pyspark.sql import Window

    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("bench").orderBy("ord")))
    return placed.withColumns({"scored": F.lit(need_bench) & (F.col("place") <= num_benchmark), "read": F.lit(need_read) & (F.col("bench") == "primary") & (F.col("place") <= num_readability)})


def evaluate(tasks: DataFrame, outputs: DataFrame, scores: Callable[[Column, Column], Column], timeout: int = execution.TIMEOUT) -> DataFrame:
    """One row of metrics of the tasks that work gives (test_cases, lcb_tests, harness) and their outputs (bench, ord, output).

    scores(prompt, collaboration) gives a judge's scores. Metrics that the mode doesn't need are null.
    """
    both = tasks.join(outputs, ["bench", "ord"]).withColumn("l", layers.split_layers(F.col("output"))).withColumn("code", layers.extract_code(F.col("output")))
    passed = execution.passed_tasks(both.where("scored").select(F.struct("bench", "ord").alias("id"), "code", "test_cases", F.col("lcb_tests").alias("cases"), "harness"), "id", timeout)
    scored = both.join(passed.select("id.bench", "id.ord", "passed"), ["bench", "ord"], "left")
    primary, secondary = F.col("scored") & (F.col("bench") == "primary"), F.col("scored") & (F.col("bench") == "secondary")
    of = lambda where, value: F.avg(F.when(where, value))
    marks = scored.withColumn("s", F.when(F.col("read"), scores(F.col("prompt"), F.col("l.collaboration"))))
    return marks.agg(
        F.count(F.lit(1)).alias("generated"),
        of(primary, F.col("passed").cast("double")).alias("mbpp_plus_pass1"), of(primary, F.length("code").cast("double")).alias("avg_code_length"), of(primary, (~metrics.parses(F.col("code"))).cast("double")).alias("syntax_error_rate"),
        of(secondary, F.col("passed").cast("double")).alias("lcb_easy_pass1"), of(secondary, (F.coalesce(F.size("lcb_tests"), F.lit(0)) > 0).cast("double")).alias("lcb_ready_frac"),
        *(F.avg(F.col(f"s.{k}")).alias(f"readability_{k}") for k in SCORE_KEYS),
        of(F.col("read"), metrics.whitespace_length(F.col("l.collaboration")).cast("double")).alias("avg_collab_length"), of(F.col("read"), metrics.leak_rate(F.col("l.thinking"), F.col("l.collaboration"))).alias("think_leak_rate"),
    )


def run(primary: DataFrame, secondary: DataFrame | None, generate: Callable[[DataFrame], DataFrame], scores: Callable[[Column, Column], Column], *, mode: str, dry_run: bool = False, **counts) -> DataFrame:
    """evaluate() of what generate makes of the tasks; secondary tasks without structured cases, or missing outputs, are errors."""
    tasks = work(primary, secondary, mode, **counts)
    if secondary is not None and MODES[mode][0] and not dry_run:
        ready = gates.structured_readiness(tasks.where("bench = 'secondary'")).first()
        if ready.n and not ready.passed:
            raise gates.GateError(f"{ready.ready} of {ready.n} secondary tasks have structured cases")
    outputs = generate(tasks)
    gates.require_equal_counts(tasks, outputs)
    return evaluate(tasks, outputs, scores)
