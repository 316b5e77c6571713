"""Streams over append-only reward logs: running summary, unseen events, latest row per key.

What a stream must remember lies in a RocksDB state store with its changes in the checkpoint, so a batch looks up its own
keys and never reads what was written before, and a restart goes on where the last committed batch ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracemill.operators.harvest import call_number, reward_value
from tracemill.schemas import AUDIT


def read(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """A stream of log rows; malformed lines are left out."""
    text = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    parsed = text.where(F.trim("value") != "").select(F.from_json("value", f"{AUDIT}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("r"))
    return parsed.where("r.corrupt is null").select("r.*").drop("corrupt")


def running_summary(rows: DataFrame) -> DataFrame:
    """Counts, sum of rewards and first and last call so far (complete mode); a mean is reward_sum / rows."""
    r = F.coalesce(reward_value(F.col("reward")), F.lit(0.0))
    return rows.groupBy().agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(r > 0).alias("reward_gt0"), F.sum(r).alias("reward_sum"), F.count_if("has_think_end").alias("has_think_end"),
        F.min(call_number(F.col("call"))).alias("call_min"), F.max(call_number(F.col("call"))).alias("call_max"),
    )


def persistent(spark: SparkSession) -> None:
    """States of streams that start from now on are kept in RocksDB, and a checkpoint uploads what changed only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def numbered(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """read() with file and line_no. A file is one row before it is split, so a log is to come in files of bounded size, as one a call."""
    text = spark.readStream.option("maxFilesPerTrigger", max_files).option("wholetext", "true").text(folder)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("place", "value"))
    parsed = lines.where(F.trim("value") != "").select("file", (F.col("place") + 1).alias("line_no"), F.from_json("value", f"{AUDIT}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("r"))
    return parsed.where("r.corrupt is null").select("file", "line_no", "r.*").drop("corrupt")


class _Latest(StatefulProcessor):
    """Lets the rows through that become the latest of their key: of a batch the last by (call, file, line), unless the state's call is greater."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.call = handle.getValueState("call", "call bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = None
        for frame in rows:
            some = frame if best is None else pd.concat([best, frame])
            best = some.sort_values(["call", "file", "line_no"]).tail(1)
        if best is None or self.call.exists() and self.call.get()[0] > best["call"].iloc[0]:
            return
        self.call.update((int(best["call"].iloc[0]),))
        yield best

    def close(self) -> None:
        pass


_LATEST = "task_id string, call bigint, file string, line_no int, reward double, completion string"


def latest_per_task(rows: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The rows of a numbered stream that become the latest of their task (update mode): the greatest call, and of equal calls the later row.

    The state is one number a task. With ttl_ms a task that had no row for so long is forgotten, and any row of it is its latest then.
    """
    persistent(rows.sparkSession)
    plain = rows.where("task_id is not null").select("task_id", call_number(F.col("call")).alias("call"), "file", "line_no", reward_value(F.col("reward")).alias("reward"), "completion")
    return plain.groupBy("task_id").transformWithStateInPandas(_Latest(ttl_ms), _LATEST, "Update", "None" if ttl_ms is None else "ProcessingTime")


def keep_latest(updates: DataFrame, table: str, checkpoint: str, **trigger):
    """Writes each batch of updates into a folder of its own; a batch that is run again replaces it.

    By default it ends when all available rows are in. States with a time to live have batches without rows too, so those
    take another trigger (once, or an interval).
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def latest_table(spark: SparkSession, table: str) -> DataFrame:
    """The latest row of each task of what keep_latest wrote."""
    names = [x.split()[0] for x in _LATEST.split(", ")]
    found = spark.read.schema(f"{_LATEST}, batch bigint").parquet(table)
    return found.groupBy("task_id").agg(F.max_by(F.struct(*names[1:]), "batch").alias("row")).select("task_id", "row.*")


def unseen(rows: DataFrame, keys: list[str], time: str | None = None, late: str = "1 day") -> DataFrame:
    """The first row of each key. With a time column a key is forgotten once the watermark is past it by late, so the state is bounded."""
    persistent(rows.sparkSession)
    return rows.dropDuplicates(keys) if time is None else rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def append_unseen(stream: DataFrame, table: str, keys: list[str], checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, time: str | None = None, late: str = "1 day"):
    """Appends the rows with new keys to a Parquet table. A batch costs what its own rows cost: keys are looked up in the state, the table isn't read.

    The table's log of files makes a batch that is run again add nothing.
    """
    rows = unseen(transform(stream) if transform else stream, keys, time, late)
    return rows.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rewards(rows: DataFrame, time: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Mean reward by event-time window, with a watermark for late rows."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("rows"), F.avg(reward_value(F.col("reward"))).alias("reward_mean"))
