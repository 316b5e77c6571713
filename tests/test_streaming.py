import glob
import json
import os
import random
import time

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tracemill.operators import metrics
from tracemill.sources import jsonl
from tracemill.schemas import AUDIT
from tracemill.streaming import audit


def rows(folder, name, data):
    (folder / name).write_text("\n".join(json.dumps(r) for r in data) + "\nbroken\n", encoding="utf-8")


def test_summary_equals_batch(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    rows(folder, "reward_rank0.jsonl", [{"call": i, "task_id": f"t{i % 3}", "reward": i / 4, "has_think_end": i % 2 == 0, "completion": "x"} for i in range(8)])
    rows(folder, "reward_rank1.jsonl", [{"call": i, "task_id": "t9", "reward": "0.5", "completion": "y"} for i in range(3)])
    stream = audit.running_summary(audit.read(spark, str(folder), max_files=1))
    query = stream.writeStream.format("memory").queryName("summary").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("summary").first()
    batch = metrics.audit_summary(jsonl.read(spark, str(folder), AUDIT, mode="skip").withColumn("ord", F.struct("path", "line_no"))).first()
    assert (got.rows, got.reward_gt0, got.call_min, got.call_max) == (batch.rows, batch.reward_gt0, batch.call_min, batch.call_max) == (11, 10, 0, 7)
    assert abs(got.reward_sum / got.rows - batch.reward_mean) < 1e-12


def test_unseen_rows_are_appended_once(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    rows(folder, "a.jsonl", [{"call": 1, "task_id": "a"}, {"call": 1, "task_id": "a"}])
    stream = lambda: audit.append_unseen(audit.read(spark, str(folder)), out, ["call", "task_id"], str(tmp_path / "ckpt")).awaitTermination(120)
    stream()
    rows(folder, "b.jsonl", [{"call": 1, "task_id": "a"}, {"call": 2, "task_id": "a"}])
    stream()
    assert sorted(r.call for r in spark.read.parquet(out).collect()) == ["1", "2"]


def test_a_batch_reads_its_own_rows_whatever_came_before(spark, tmp_path):
    """The rows that batches read are those of their new files, and the state store answers for the history; the table of the results may even be gone."""
    folder, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "ckpt")
    folder.mkdir()
    read = []
    for k in range(4):
        rows(folder, f"{k}.jsonl", [{"call": j, "task_id": "a"} for j in range(50 * k, 50 * k + 60)])
        query = audit.append_unseen(audit.read(spark, str(folder)), out, ["call", "task_id"], checkpoint)
        query.awaitTermination(120)
        done = [p for p in query.recentProgress if p["numInputRows"]]
        read.append([(p["numInputRows"], p["stateOperators"][0]["numRowsTotal"]) for p in done])
        assert all("RocksDB" in str(p["stateOperators"][0]["customMetrics"]) or any("rocksdb" in m for m in p["stateOperators"][0]["customMetrics"]) for p in done)
    assert read == [[(61, 60 + 50 * k)] for k in range(4)]
    assert sorted(int(r.call) for r in spark.read.parquet(out).collect()) == list(range(210))
    for file in glob.glob(f"{out}/*.parquet"):
        os.remove(file)
    rows(folder, "9.jsonl", [{"call": 3, "task_id": "a"}, {"call": 999, "task_id": "a"}])
    audit.append_unseen(audit.read(spark, str(folder)), out, ["call", "task_id"], checkpoint).awaitTermination(120)
    assert [r["call"] for f in glob.glob(f"{out}/*.parquet") for r in pq.read_table(f).to_pylist()] == ["999"]


def test_keys_behind_the_watermark_are_forgotten(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "ckpt")
    folder.mkdir()
    timed = lambda df: df.withColumn("at", F.timestamp_seconds(F.col("call").cast("long") * 3600))
    state = []
    for k, calls in enumerate(((1, 2, 3), (100, 101, 100), (200, 201))):
        rows(folder, f"{k}.jsonl", [{"call": c, "task_id": f"t{c}"} for c in calls])
        query = audit.append_unseen(audit.read(spark, str(folder)), out, ["task_id"], checkpoint, transform=timed, time="at", late="2 hours")
        query.awaitTermination(120)
        state.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert sorted(int(r.call) for r in spark.read.parquet(out).collect()) == [1, 2, 3, 100, 101, 200, 201] and max(state) <= 4


def test_latest_row_equals_the_batch_over_restarts(spark, tmp_path):
    """Equal calls go to the later row, within a file, between files and between runs; a smaller call changes nothing."""
    folder, table, checkpoint = tmp_path / "logs", str(tmp_path / "latest"), str(tmp_path / "ckpt")
    folder.mkdir()
    rng = random.Random(4)
    for k in range(3):
        rows(folder, f"{k}.jsonl", [{"call": rng.randrange(6), "task_id": f"t{rng.randrange(9)}", "reward": j / 8, "completion": f"{k}-{j}"} for j in range(40)] + [{"call": 5, "task_id": "same", "completion": f"{k}"}, {"call": 5 - k, "task_id": "less", "completion": f"{k}"}, {"call": "x", "task_id": None}])
        audit.keep_latest(audit.latest_per_task(audit.numbered(spark, str(folder), max_files=1)), table, checkpoint).awaitTermination(120)
    got = {r.task_id: (r.call, r.completion) for r in audit.latest_table(spark, table).collect()}
    log = jsonl.read(spark, str(folder), AUDIT, mode="skip").where("task_id is not null").withColumn("call", F.col("call").cast("bigint"))
    batch = log.groupBy("task_id").agg(F.max_by(F.struct("call", "completion"), F.struct("call", "path", "line_no")).alias("x")).collect()
    assert got == {r.task_id: tuple(r.x) for r in batch} and got["same"] == (5, "2") and got["less"] == (5, "0") and len(got) == 11


def test_a_task_is_forgotten_after_its_time(spark, tmp_path):
    folder, table, checkpoint = tmp_path / "logs", str(tmp_path / "latest"), str(tmp_path / "ckpt")
    folder.mkdir()
    for name, call in (("a", 5), ("b", 2)):
        rows(folder, f"{name}.jsonl", [{"call": call, "task_id": "t", "completion": name}])
        audit.keep_latest(audit.latest_per_task(audit.numbered(spark, str(folder)), ttl_ms=1), table, checkpoint, once=True).awaitTermination(120)
        time.sleep(0.1)
    assert [r.completion for r in audit.latest_table(spark, table).collect()] == ["b"]


def test_windows(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    rows(folder, "a.jsonl", [{"call": c, "task_id": t, "reward": c / 10, "completion": f"{t}{c}"} for c, t in ((1, "a"), (5, "a"), (3, "b"))])
    timed = audit.read(spark, str(folder)).withColumn("at", F.timestamp_seconds(F.col("call").cast("long") * 200))
    windows = audit.windowed_rewards(timed, "at")
    query = windows.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.rows, round(r.reward_mean, 3)) for r in spark.table("windows").collect())
    assert got == [(1, 0.1), (2, 0.4)]
