"""The reward log by rank and call: commits, reruns, restarts, conflicts and readers."""

import collections
import json
import os

import pytest
from pyspark.sql import functions as F

from tracemill.operators import execution
from tracemill.sources import jsonl, ranklog
from tracemill.schemas import AUDIT

SCHEMA = "task_id string, reward double, completion string"


def rows(spark, n, mark):
    return spark.range(n).select(F.concat(F.lit("t"), "id").alias("task_id"), (F.col("id") / 4).alias("reward"), F.lit(f"{mark} é \n\"x\"").alias("completion")).repartition(3)


def found(spark, folder):
    return collections.Counter((r.rank, r.call, r.completion[0]) for r in ranklog.read(spark, folder, SCHEMA).collect())


def test_calls_go_on_after_the_committed_ones(spark, tmp_path):
    folder = str(tmp_path)
    assert ranklog.next_call(folder) == 0
    assert [ranklog.append(rows(spark, 5, m), folder, rank=1) for m in "ab"] == [0, 1]
    assert ranklog.append(rows(spark, 2, "c"), f"file://{folder}", rank=12) == 0  # ranks count apart
    assert found(spark, folder) == {(1, 0, "a"): 5, (1, 1, "b"): 5, (12, 0, "c"): 2} and ranklog.next_call(folder, 1) == 2


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    folder = str(tmp_path)
    for _ in range(2):
        ranklog.append(rows(spark, 5, "a"), folder, call=7)
    assert found(spark, folder) == {(0, 7, "a"): 5} and os.listdir(f"{folder}/_staging") == [] and ranklog.next_call(folder) == 8


def test_nothing_is_seen_of_a_write_that_failed(spark, tmp_path):
    folder = str(tmp_path)
    ranklog.append(rows(spark, 5, "a"), folder)
    broken = rows(spark, 50, "b").withColumn("reward", F.when(F.col("task_id") == "t49", F.raise_error(F.lit("lost")).cast("double")).otherwise(1.0))
    with pytest.raises(Exception, match="lost"):
        ranklog.append(broken, folder)
    # a process that is killed between its tasks and the commit leaves its staging folder only
    staged = ranklog._Log(folder, 0)
    fs, base = ranklog.store(folder)
    fs.create_dir(f"{base}/_staging/{staged.own}", recursive=True)
    with open(f"{base}/_staging/{staged.own}/part-00000-9.jsonl", "w") as out:
        out.write(json.dumps({"task_id": "t", "completion": "z"}) + "\n")
    assert found(spark, folder) == {(0, 0, "a"): 5} and ranklog.next_call(folder) == 1
    assert ranklog.append(rows(spark, 4, "d"), folder) == 1 and found(spark, folder) == {(0, 0, "a"): 5, (0, 1, "d"): 4}


def test_files_of_attempts_that_lost_are_left_out_and_conflicts_fail(tmp_path):
    folder = str(tmp_path)

    def staged(*names):
        log = ranklog._Log(folder, 0)
        os.makedirs(f"{folder}/_staging/{log.own}")
        for n in names:
            (tmp_path / "_staging" / log.own / n).write_text("{}\n")
        return log

    def won(log, *rows):
        return [ranklog.Written(log.own, n, k) for n, k in rows]

    first = staged("a", "b", "empty")
    assert first.commit([*won(first, ("a", 1), ("empty", 0)), None], 3)
    assert sorted(os.listdir(f"{folder}/rank=0/call=3")) == ["_committed", "a"]
    again = staged("c")
    assert not again.commit(won(again, ("c", 1)), 3)  # the same call again
    os.makedirs(f"{folder}/rank=0/call=4/half")  # another writer's folder of a call that isn't committed
    late = staged("d")
    with pytest.raises(OSError):
        late.commit(won(late, ("d", 1)), 4)
    assert os.listdir(f"{folder}/_staging") == []


def test_batches_of_a_stream_are_calls(spark, tmp_path):
    source, folder, checkpoint = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "ckpt")
    source.mkdir()
    spark.dataSource.register(ranklog.RankLog)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
        stream.writeStream.format(ranklog.NAME).option("rank", 2).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder).awaitTermination(120)

    for k, mark in enumerate("abc"):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"task_id": f"t{j}", "reward": 1.0, "completion": mark}) for j in range(k + 1)))
        os.utime(source / f"{k}.json", (1_000_000 + k, 1_000_000 + k))  # files come by their times
        if k:
            run()
    # the commit of the last batch was lost: the batch is run again, and its call is there
    for name in ("2", ".2.crc"):
        os.remove(f"{checkpoint}/commits/{name}")
    run()
    assert found(spark, folder) == {(2, 0, "a"): 1, (2, 1, "b"): 2, (2, 2, "c"): 3}


def test_rewards_go_on_counting_in_a_new_process(spark, tmp_path):
    """A callable that is made anew, as after a restart, numbers its calls behind the committed ones; a repeated call adds nothing."""
    folder = str(tmp_path)
    texts, tests = ["```python\ndef f(): return 1\n```", "no code"], ['["assert f() == 1"]', '["assert f() == 1"]']
    assert execution.reward_callable(spark, folder, rank=3)(texts, tests, ["t1", "t2"]) == [1.0, 0.0]
    again = execution.reward_callable(spark, folder, rank=3)
    assert again(texts, tests, ["t1", "t2"]) == again(texts, tests, ["t1", "t2"], call=1) == [1.0, 0.0]
    log = jsonl.read(spark, f"{folder}/rank=3/*", AUDIT).collect()
    assert sorted((r.call, r.task_id, r.reward, r.has_python_fence) for r in log) == [("0", "t1", "1.0", True), ("0", "t2", "0.0", False), ("1", "t1", "1.0", True), ("1", "t2", "0.0", False)]
