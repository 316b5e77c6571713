"""Evaluation aggregates."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tracemill.functions import pytext, tokens
from tracemill.schemas import SCORE_KEYS

LEAK_N = 3


def mean(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def share(condition: Column) -> Column:
    return mean(condition.cast("double"))


@F.pandas_udf(BooleanType())
def parses(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether a text is a syntactically right program; an empty one is."""

    def good(code: str | None) -> bool:
        try:
            ast.parse(code or "")
        except SyntaxError:
            return False
        except (ValueError, RecursionError, MemoryError):
            return True  # only syntax errors count
        return True

    for codes in batches:
        yield codes.map(good).astype(bool)


def whitespace_length(c: Column) -> Column:
    return F.size(pytext.ws_tokens(F.coalesce(c, F.lit(""))))


def readability_means(scores: DataFrame, column: str = "scores") -> DataFrame:
    return scores.agg(*(mean(F.coalesce(F.col(f"{column}.{k}"), F.lit(0.0))).alias(k) for k in SCORE_KEYS))


def leak_rates(df: DataFrame, keys: list[str], thinking: str = "thinking", collaboration: str = "collaboration", n: int = LEAK_N) -> DataFrame:
    """(keys, leaked, grams, leak_rate): the share of a row's thinking n-grams, repeats counted, that its collaboration holds.

    n-grams are hashed rows joined on the row's keys, so long texts are not compared pair by pair.
    """
    grams = lambda c: tokens.ngrams(pytext.word_tokens(F.coalesce(F.col(c), F.lit(""))), n)
    every = df.select(*keys, grams(thinking).alias("t_"), F.array_distinct(grams(collaboration)).alias("c_"))
    think = every.select(*keys, F.explode("t_").alias("gram_")).groupBy(*keys, "gram_").agg(F.count(F.lit(1)).alias("n_"))
    seen = every.select(*keys, F.explode("c_").alias("gram_"), F.lit(1).alias("in_"))
    both = think.join(seen, [*keys, "gram_"], "left").groupBy(*keys).agg(F.sum(F.when(F.col("in_") == 1, F.col("n_")).otherwise(0)).alias("leaked"), F.sum("n_").alias("grams"))
    zero = F.lit(0).cast("bigint")
    return df.select(*keys).join(both, keys, "left").select(*keys, F.coalesce("leaked", zero).alias("leaked"), F.coalesce("grams", zero).alias("grams"), F.coalesce(F.try_divide("leaked", "grams"), F.lit(0.0)).alias("leak_rate"))


def mean_leak_rate(rates: DataFrame) -> DataFrame:
    """One row (n, mean_leak_rate) of what leak_rates gives."""
    return rates.agg(F.count(F.lit(1)).alias("n"), mean(F.col("leak_rate")).alias("mean_leak_rate"))


def gains(cycles: DataFrame, value: str, least: float = 0.01) -> DataFrame:
    """Rows (cycle, value) with gain, the difference to the cycle before, and stop: two gains in a row under least. The table has a row a cycle."""
    over = Window.orderBy("cycle")
    gained = cycles.withColumn("gain", F.col(value) - F.lag(value).over(over))
    return gained.withColumn("stop", F.coalesce((F.col("gain") < least) & (F.lag("gain").over(over) < least), F.lit(False)))


def leak_rate(thinking: Column, collaboration: Column, n: int = LEAK_N) -> Column:
    """The same as an expression, for short texts."""
    grams = lambda c: tokens.ngrams(pytext.word_tokens(F.coalesce(c, F.lit(""))), n)
    both = F.struct(grams(thinking).alias("own"), F.array_distinct(grams(collaboration)).alias("other"))
    share_ = lambda b: F.when(F.size(b["own"]) > 0, F.size(F.filter(b["own"], lambda g: F.array_contains(b["other"], g))) / F.size(b["own"])).otherwise(0.0)
    return pytext.let(both, share_)


def executable(tests: Column) -> Column:
    """Not empty, and every case starts with assert."""
    return F.coalesce((F.size(tests) > 0) & F.forall(tests, lambda t: pytext.strip(t).startswith("assert")), F.lit(False))


def benchmark_metrics(rows: DataFrame) -> DataFrame:
    """One row over (passed, code, test_cases, n_cases)."""
    return rows.agg(
        share(F.col("passed")).alias("pass_at_1"), mean(F.length("code").cast("double")).alias("avg_code_length"), share(~parses(F.col("code"))).alias("syntax_error_rate"), F.count(F.lit(1)).alias("n"),
        share(executable(F.col("test_cases"))).alias("executable_assert_task_frac"), share(F.col("n_cases") > 0).alias("lcb_ready_frac"),
    )


def audit_summary(audit: DataFrame, top: int = 8) -> DataFrame:
    """One row: counts, mean reward, flags, distinct tasks, first and last call, and the most frequent rounded rewards (ties: first seen)."""
    from .harvest import call_number, reward_value

    rows = audit.withColumn("r_", F.coalesce(reward_value(F.col("reward")), F.lit(0.0)))
    one = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("r_") > 0).alias("reward_gt0"), mean(F.col("r_")).alias("reward_mean"), F.count_if("has_think_end").alias("has_think_end"), F.count_if("has_python_fence").alias("has_python_fence"),
        F.countDistinct(F.coalesce("task_id", F.lit("\0null"))).alias("task_ids"), F.min(call_number(F.col("call"))).alias("call_min"), F.max(call_number(F.col("call"))).alias("call_max"),
    ).withColumn("reward_gt0_frac", F.coalesce(F.try_divide("reward_gt0", "rows"), F.lit(0.0)))
    return one.crossJoin(histogram(audit, top).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "reward", "n"))), lambda x: F.struct(x["reward"].alias("reward"), x["n"].alias("n"))).alias("reward_hist")))


def histogram(audit: DataFrame, top: int = 8) -> DataFrame:
    """(place, reward, n): the most frequent rewards, rounded to two decimals; ties by first appearance."""
    from .harvest import reward_value

    rounded = F.bround(F.coalesce(reward_value(F.col("reward")), F.lit(0.0)), 2)
    counted = audit.groupBy(rounded.alias("reward")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_"))
    kept = counted.orderBy(F.desc("n"), "first_").limit(top)
    return kept.select(F.row_number().over(Window.orderBy(F.desc("n"), "first_")).alias("place"), "reward", "n")


def by_tag(metrics: DataFrame, names: list[str], tags: tuple[str, ...] = ("base", "rl", "final")) -> DataFrame:
    """One row with <tag>_<name> columns from (model_tag, names)."""
    return metrics.agg(*(F.max(F.when(F.col("model_tag") == t, F.col(n))).alias(f"{t}_{n}") for t in tags for n in names))


def report(metrics: DataFrame, names: list[str], cycle: int = 0) -> DataFrame:
    """One row: cycle, models (map of tag to map of metrics) and the hypotheses, as JSON-ready columns."""
    from tracemill.functions.scores import hypotheses

    wide = by_tag(metrics, names)
    tags = ("base", "rl", "final")
    as_map = F.create_map(*(x for t in tags for x in (F.lit(t), F.create_map(*(y for n in names for y in (F.lit(n), F.col(f"{t}_{n}")))))))
    checks = hypotheses({t: F.col(f"{t}_coding") for t in tags}, {t: F.col(f"{t}_readability") for t in tags})
    return wide.select(F.lit(cycle).alias("cycle"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), as_map.alias("models"), checks.alias("hypothesis_results"))
