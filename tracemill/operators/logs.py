"""Training logs: progress bars and printed metric dicts to event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.pytext import strip
from tracemill.schemas import METRIC_EVENT

TOTAL = 300
_METRICS = r"\{[^{}]*'loss'[^{}]*\}"


def progress(texts: DataFrame, total: int = TOTAL) -> DataFrame:
    """(place, pos, step, elapsed, eta, sec_per_it) of each progress mark in (place, value)."""
    pattern = rf"(\d+)/{total}\s+\[([^<]+)<([^,]+),\s+([0-9.]+)s/it\]"
    parts = F.arrays_zip(*(F.regexp_extract_all("value", F.lit(pattern), F.lit(k)).alias(n) for k, n in enumerate(("step", "elapsed", "eta", "sec"), 1)))
    found = texts.select("place", F.posexplode(parts).alias("pos", "m"))
    return found.select("place", "pos", F.col("m.step").cast("bigint").alias("step"), strip(F.col("m.elapsed")).alias("elapsed"), strip(F.col("m.eta")).alias("eta"), F.col("m.sec").try_cast("double").alias("sec_per_it"))


def latest_progress(texts: DataFrame, total: int = TOTAL) -> DataFrame:
    """The last mark of each step."""
    last = progress(texts, total).groupBy("step").agg(F.max_by(F.struct("elapsed", "eta", "sec_per_it"), F.struct("place", "pos")).alias("m"))
    return last.select("step", "m.*").orderBy("step")


def metric_events(texts: DataFrame) -> DataFrame:
    """The printed dicts with a loss that are JSON once the quotes are, and have an epoch; bare nan drops a row."""
    found = texts.select("place", F.posexplode(F.regexp_extract_all("value", F.lit(_METRICS), F.lit(0))).alias("pos", "raw"))
    text = F.regexp_replace(F.col("raw"), "'", '"')
    parsed = found.withColumn("v", F.try_parse_json(text)).where(F.schema_of_variant("v").rlike(r"[<\s,]epoch:"))
    fields = [f.strip().split(" ")[0] for f in METRIC_EVENT.split(",")]
    return parsed.select("place", "pos", *(F.try_variant_get("v", f"$.{f}", "double").alias(f) for f in fields))


def unseen(events: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Events whose key isn't known; null keys are equal."""
    condition = None
    other = known.select(*(F.col(k).alias(f"known_{k}") for k in keys)).distinct()
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"known_{k}"))
        condition = same if condition is None else condition & same
    return events.join(other, condition, "left_anti")


def metric_key(events: DataFrame) -> DataFrame:
    return events.withColumn("epoch_key", F.bround("epoch", 4))


def matching_lines(lines: DataFrame, *marks: str) -> DataFrame:
    condition = F.lit(False)
    for m in marks:
        condition = condition | F.contains("value", F.lit(m))
    return lines.where(condition)


def tail(lines: DataFrame, n: int = 12) -> DataFrame:
    return lines.orderBy(F.desc("line_no")).limit(n).orderBy("line_no")
