"""Preference pairs: traces to raw pairs to records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import layers, messages, scores
from tracemill.functions.pytext import strip
from tracemill.schemas import SCORES

MAX_CHARS = 4000


def remaining(traces: DataFrame, done: DataFrame, key: str = "task_id") -> DataFrame:
    """Traces not done yet. By task_id all traces of a done task go; pass a finer key to keep its siblings."""
    return traces.join(done.select(key).distinct(), key, "left_anti")


def raw_pairs(traces: DataFrame, regenerated: Column) -> DataFrame:
    """The raw pair of each trace and its regenerated text, which must hold no think tag."""
    or_blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return traces.select(
        "task_id", or_blank("task_prompt"), or_blank("thinking"), or_blank("code"), F.coalesce("collaboration", F.lit("")).alias("rl_collaboration"),
        layers.reject_think(regenerated).alias("regen_collaboration"), F.coalesce("reward", F.lit(0.0)).alias("reward"), "full_output", "work_trace", *(c for c in ("ord", "first_ord") if c in traces.columns),
    )


def structural(max_chars: int = MAX_CHARS) -> Column:
    """Both texts and the code not blank, the texts different and neither longer than max_chars."""
    regen, rl, code = (strip(F.coalesce(F.col(c), F.lit(""))) for c in ("regen_collaboration", "rl_collaboration", "code"))
    return (regen != "") & (rl != "") & (code != "") & (regen != rl) & (F.length(regen) <= max_chars) & (F.length(rl) <= max_chars)


def records(pairs: DataFrame, regen_score: Column | None = None, rl_score: Column | None = None) -> DataFrame:
    """Preference records; score_gap is null unless both scores have an overall."""
    none = F.lit(None).cast(SCORES)
    a, b = (none if c is None else c.cast(SCORES) for c in (regen_score, rl_score))
    meta = F.struct("task_id", "task_prompt", "thinking", "code", F.lit(messages.PROMPT_FORMAT).alias("prompt_format"), a.alias("regen_score"), b.alias("rl_score"), "reward", (a["overall"] - b["overall"]).alias("score_gap"))
    return pairs.select(F.col("regen_collaboration").alias("chosen"), F.col("rl_collaboration").alias("rejected"), messages.regeneration(F.col("task_prompt"), F.col("thinking"), F.col("code")).alias("messages"), meta.alias("metadata"))


def filter_structural(pairs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    return records(pairs.where(structural(max_chars)))


def filter_mock(pairs: DataFrame, threshold: float = scores.THRESHOLD, gap: float = scores.GAP) -> DataFrame:
    """Records of the pairs that the mock judge's scores let through."""
    a, b = scores.mock_scores(F.col("regen_collaboration"), F.col("rl_collaboration"))
    judged = pairs.withColumn("a_", a).withColumn("b_", b).where(scores.keeps_pair(F.col("a_.overall"), F.col("b_.overall"), threshold, gap))
    return records(judged, F.col("a_"), F.col("b_"))


def filter_judged(pairs: DataFrame, judged: DataFrame, key: list[str], threshold: float = scores.THRESHOLD, gap: float = scores.GAP, most_errors: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Records of pairs by a table of judge answers (key, side regen or rl, content), and a row (kept, total, errors, too_many_errors)."""
    wide = judged.groupBy(*key).agg(*(F.max(F.when(F.col("side") == s, F.col("content"))).alias(f"{s}_answer") for s in ("regen", "rl")))
    both = pairs.join(wide, key, "left").withColumn("a_", scores.judged(F.col("regen_answer"))).withColumn("b_", scores.judged(F.col("rl_answer")))
    keep = F.col("a_.ok") & F.col("b_.ok") & scores.keeps_pair(F.col("a_.scores.overall"), F.col("b_.scores.overall"), threshold, gap)
    count = both.agg(F.count_if(keep).alias("kept"), F.count(F.lit(1)).alias("total"), F.count_if(~(F.col("a_.ok") & F.col("b_.ok"))).alias("errors"))
    return records(both.where(keep), F.col("a_.scores"), F.col("b_.scores")), count.withColumn("too_many_errors", F.col("errors") > F.lit(most_errors) * F.col("total"))


def rendered(rows: DataFrame) -> DataFrame:
    """(messages or prompt, chosen, rejected) for a trainer; the chat template itself is applied outside.

    The work trace of the metadata comes first, then that of the row, then messages, then a plain prompt. An
    XML-like prompt of old without a work trace is an error, as are rows without chosen or rejected.
    """
    has = lambda c: c in rows.columns
    null = F.lit(None).cast("string")
    top = lambda c: F.col(c) if has(c) else null
    part = lambda c: F.coalesce(F.col(f"metadata.{c}"), top(c)) if has("metadata") else top(c)
    trace = {c: part(c) for c in ("task_prompt", "thinking", "code")}
    whole = trace["task_prompt"].isNotNull() & trace["thinking"].isNotNull() & trace["code"].isNotNull()
    old = F.coalesce(F.contains(top("prompt"), F.lit("<system>")) & F.contains(top("prompt"), F.lit("<user>")), F.lit(False))
    kind = "array<struct<role:string,content:string>>"
    given = F.col("messages").cast(kind) if has("messages") else F.lit(None).cast(kind)
    fail = lambda text: F.raise_error(F.lit(text)).cast(kind)
    body = (
        F.when(F.col("chosen").isNull() | F.col("rejected").isNull(), fail("chosen and rejected are needed"))
        .when(old & ~whole, fail("old prompt without a work trace"))
        .when(whole, messages.regeneration(*trace.values()).cast(kind))
        .when(F.size(given) > 0, given)
        .when(strip(F.coalesce(top("prompt"), F.lit(""))) != "", F.array(messages.message("user", top("prompt"))).cast(kind))
        .otherwise(fail("neither a work trace nor messages nor a prompt"))
    )
    return rows.select(body.alias("messages"), "chosen", "rejected")


#: Bits of a place in the split's order, bits that one pass over the places settles, and places that are sorted outright.
_BITS, _STEP, _FEW = 60, 15, 10_000


def split_place(key: Column, seed: int = 42) -> Column:
    """A number below 2**60 from SHA-1 of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, _BITS // 4), 16, 10).cast("bigint")


def kth_smallest(places: DataFrame, k: int) -> int:
    """The k-th smallest of the places (one column): no sort of all rows.

    Each pass counts the places of the range that is left in 2**15 parts, and goes on in the part that the k-th lies in; the
    driver sees these counts. A part of few places is sorted.
    """
    name, low, width = places.columns[0], 0, _BITS
    while width:
        width -= min(_STEP, width)
        inside = places.where(F.col(name).between(low, low + (1 << min(width + _STEP, _BITS)) - 1))
        for part, n in sorted(map(tuple, inside.groupBy(F.shiftright(F.col(name) - low, width).alias("part")).count().collect())):
            if n >= k:
                low += part << width
                break
            k -= n
        if width and n <= _FEW:
            return inside.where(F.col(name).between(low, low + (1 << width) - 1)).orderBy(name).limit(k).agg(F.max(name)).first()[0]
    return low


def train_eval_split(rows: DataFrame, key: str, eval_share: float = 0.05, least: int = 20, seed: int = 42) -> DataFrame:
    """Adds fold: exactly ceil(eval_share * n) of n rows are eval, drawn by a hash of the key; fewer than least rows are all train.

    Keys are to be unique: rows that share one stay in one fold, also where the last eval row is one of them.
    """
    place = split_place(F.col(key), seed)
    n = rows.count()
    if n < least or not 0 < eval_share < 1:
        return rows.withColumn("fold", F.lit("train"))
    last = kth_smallest(rows.select(place.alias("place")), math.ceil(eval_share * n))
    return rows.withColumn("fold", F.when(place <= last, "eval").otherwise("train"))
