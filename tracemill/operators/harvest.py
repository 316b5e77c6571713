"""Harvest: reward logs to training traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import scratch
from tracemill.functions import layers, pytext

from .relational import at_places

MIN_REWARD, LATER_FRAC, MIN_LATER = 0.0, 1.0 / 3.0, 32
SOURCE = "grpo_reward_audit"


def reward_value(reward: Column) -> Column:
    """A logged reward as a number: null and '' are 0, booleans 1 and 0, other text null."""
    text = F.lower(F.coalesce(reward.cast("string"), F.lit("0")))
    return F.when(text == "", 0.0).when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))


def call_number(call: Column) -> Column:
    return F.coalesce(call.try_cast("bigint"), F.lit(0).cast("bigint"))


def positive(audit: DataFrame, min_reward: float = MIN_REWARD) -> DataFrame:
    """Rows whose reward is above min_reward (not-a-number isn't)."""
    r = reward_value(F.col("reward"))
    return audit.where(r.isNotNull() & ~F.isnan(r) & (r > min_reward)).withColumn("reward", r)


def prompts_by_task(tasks: DataFrame) -> DataFrame:
    """(task_id, task_prompt): prompt, else task_prompt, of the last row of each task."""
    names = [F.col(c) for c in ("prompt", "task_prompt") if c in tasks.columns]
    return tasks.where("task_id is not null").withColumn("p_", pytext.filled(*names)).groupBy("task_id").agg(F.max_by("p_", "ord").alias("task_prompt"))


def window_start(audit: DataFrame, later_frac: float = LATER_FRAC) -> DataFrame:
    """One row (max_call, later_cut) over all logged rows."""
    if not 0.0 < later_frac <= 1.0:
        raise ValueError(f"later_frac must be in (0, 1], got {later_frac}")
    return audit.agg(F.max(call_number(F.col("call"))).alias("max_call")).withColumn("later_cut", _cut(later_frac))


def _cut(later_frac: float) -> Column:
    return (F.col("max_call") * F.lit(1.0 - later_frac)).cast("bigint")


def split_rows(rows: DataFrame, prompts: DataFrame) -> DataFrame:
    """Rows with their prompt and layers, and why a row is no trace: skipped is no_prompt, split or null."""
    joined = rows.join(prompts, "task_id", "left")
    parts = joined.withColumn("layers", layers.split_layers(F.col("completion")))
    skipped = F.when(F.coalesce(F.col("task_prompt"), F.lit("")) == "", "no_prompt").when((F.col("layers.code") == "") | (F.col("layers.collaboration") == ""), "split")
    return parts.withColumn("skipped", skipped)


def marked(audit: DataFrame, prompts: DataFrame, min_reward: float, later_frac: float) -> DataFrame:
    """(task_id, key, call, ord, later, skipped) of the positive rows: what choosing needs. Texts are split in the scan and go no further."""
    parts = positive(audit, min_reward).withColumn("layers", layers.split_layers(F.col("completion")))
    whole = (F.col("layers.code") != "") & (F.col("layers.collaboration") != "")
    narrow = parts.select("task_id", F.when(whole, layers.content_key(F.col("layers.code"))).alias("key"), call_number(F.col("call")).alias("call"), "ord")
    asked = prompts.select("task_id", (F.col("task_prompt") != "").alias("asked"))
    rows = narrow.join(asked, "task_id", "left").crossJoin(F.broadcast(window_start(audit, later_frac)))
    skipped = F.when(~F.coalesce("asked", F.lit(False)), "no_prompt").when(F.col("key").isNull(), "split")
    return rows.select("task_id", F.when(skipped.isNull(), F.col("key")).alias("key"), "call", "ord", (F.col("call") >= F.col("later_cut")).alias("later"), skipped.alias("skipped"))


def _winners(rows: DataFrame) -> DataFrame:
    """Of each task and program, over the later window and over all rows, the place of the row with the greatest call, of those the last by ord; and the first ord."""
    place, late = F.struct("call", "ord"), F.col("later")
    return rows.where("skipped is null").groupBy("task_id", "key").agg(F.max(F.when(late, place)).alias("late"), F.min(F.when(late, F.col("ord"))).alias("late_first"), F.max(place).alias("every"), F.min("ord").alias("every_first"))


def _traces(rows: DataFrame) -> DataFrame:
    """Traces of audit rows with their layers."""
    file = F.col("file") if "file" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        "task_id", "task_prompt", F.col("completion").alias("full_output"), "layers.thinking", "layers.code", "layers.collaboration", "reward",
        F.concat("layers.thinking", F.lit("\n[CODE]\n"), "layers.code").alias("work_trace"),
        F.lit(SOURCE).alias("source"), call_number(F.col("call")).alias("audit_call"), file.alias("audit_file"), "first_ord", "window",
    )


def trace_order() -> list[Column]:
    return [F.desc("audit_call"), F.asc("task_id"), F.asc("first_ord")]


def harvest(audit: DataFrame, prompts: DataFrame, *, min_reward: float = MIN_REWARD, later_frac: float = LATER_FRAC, min_later: int = MIN_LATER, max_traces: int | None = None) -> DataFrame:
    """Traces of the later window if there are min_later of them, else of all positive rows; window says which.

    audit has ord, the unique input order. Rows are chosen by calls and places alone, for both windows in one
    aggregation, and the number of the later window's traces decides in the plan; with max_traces the choice ends there.
    The winners' places are written, and a bitmap of them is applied in the scan that reads the texts.
    """
    found = _winners(marked(audit, prompts, min_reward, later_frac))
    use = F.broadcast(found.agg((F.count("late") >= min_later).alias("use")))
    pick = lambda a, b: F.when(F.col("use"), F.col(a)).otherwise(F.col(b))
    names = {"ord": pick("late.ord", "every.ord"), "first_ord": pick("late_first", "every_first"), "window": F.when(F.col("use"), "later").otherwise("all"), "audit_call": pick("late.call", "every.call"), "task_id": F.col("task_id")}
    chosen = found.crossJoin(use).select(*(c.alias(k) for k, c in names.items())).where("ord is not null")
    if max_traces is not None:
        chosen = chosen.orderBy(*trace_order()).limit(max_traces)
    chosen = scratch.write(chosen.select("ord", "first_ord", "window"), "winners")
    traces = _traces(split_rows(at_places(audit, chosen, "ord").withColumn("reward", reward_value(F.col("reward"))), prompts))
    return traces if max_traces is None else traces.orderBy(*trace_order())


def stats(audit: DataFrame, prompts: DataFrame, *, min_reward: float = MIN_REWARD, later_frac: float = LATER_FRAC, min_later: int = MIN_LATER) -> DataFrame:
    """One row of counts of a harvest, from one aggregation of the marked rows by task and program."""
    late = F.col("later")
    why = {"no_prompt": F.col("skipped") == "no_prompt", "split": F.col("skipped") == "split"}
    keys = marked(audit, prompts, min_reward, later_frac).groupBy("task_id", "key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(late & F.col("key").isNotNull()).alias("late"),
        *(F.count_if(c).alias(f"all_{k}") for k, c in why.items()), *(F.count_if(c & late).alias(f"late_{k}") for k, c in why.items()),
    )
    kept, kept_late = F.col("key").isNotNull(), F.col("late") > 0
    total = keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("positive_rows"), F.count_if(kept).alias("all_kept"), F.count_if(kept_late).alias("late_kept"),
        F.countDistinct(F.when(kept, F.col("task_id"))).alias("all_tasks"), F.countDistinct(F.when(kept_late, F.col("task_id"))).alias("late_tasks"),
        *(F.coalesce(F.sum(f"{w}_{k}"), F.lit(0)).alias(f"{w}_{k}") for w in ("all", "late") for k in why),
    )
    pick = lambda name: F.when(F.col("used_later_window"), F.col(f"late_{name}")).otherwise(F.col(f"all_{name}"))
    return (
        audit.agg(F.count(F.lit(1)).alias("audit_rows"), F.max(call_number(F.col("call"))).alias("max_call"))
        .crossJoin(total.withColumn("used_later_window", F.col("late_kept") >= min_later))
        .select("audit_rows", "positive_rows", "max_call", _cut(later_frac).alias("later_cut"), pick("no_prompt").alias("skipped_no_prompt"), pick("split").alias("skipped_split"), pick("kept").alias("kept"), pick("tasks").alias("unique_tasks"), "used_later_window")
    )


def live_trace(task: DataFrame, output: Column, reward: Column) -> DataFrame:
    """Traces of fresh generations: tasks (task_id, prompt) with an output."""
    parts = task.withColumn("layers", layers.split_layers(output)).withColumn("full_output", output).withColumn("reward", reward)
    return parts.select("task_id", F.coalesce("prompt", F.lit("")).alias("task_prompt"), "full_output", "layers.thinking", "layers.code", "layers.collaboration", "reward", F.concat("layers.thinking", F.lit("\n[CODE]\n"), "layers.code").alias("work_trace"))
