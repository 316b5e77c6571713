"""Gates while writing, and the split of an exact size."""

import hashlib
import math
import os

import pytest
from pyspark.sql import functions as F

from tracemill.operators import gates, pairs, prepare
from tracemill.sources import jsonl

TASK = "ord int, task_id string, source string, synthetic boolean"


def tasks(spark, n, source="mbpp_full", synthetic=0):
    return spark.createDataFrame([(k, f"mbpp_{k}", source if k % 9 else "", k < synthetic) for k in range(n)], TASK).repartition(3)


@pytest.mark.parametrize("n,source,synthetic", [(0, "mbpp_full", 0), (40, "mbpp_full", 2), (150, "other", 0), (150, "mbpp_full", 0)])
def test_written_gates_equal_the_table_s(spark, tmp_path, n, source, synthetic):
    df, out = tasks(spark, n, source, synthetic), str(tmp_path / "out")
    found = gates.written(df, "mbpp_train", lambda rows: rows.write.json(out))
    key = lambda rows: sorted(map(tuple, rows.collect()))
    assert key(found) == key(gates.dataset_violations(df, "mbpp_train", full_scan=True)) and (n == 0 or spark.read.json(out).count() == n)
    with pytest.raises(gates.GateError):
        gates.written(df, "unknown", lambda rows: None)


def test_readiness_is_seen_while_writing(spark, tmp_path):
    case = F.when(F.col("ord") % 3 == 0, F.array(F.lit("case")))
    df = tasks(spark, 60, "livecodebench_easy").withColumns({"lcb_tests": case, "harness": F.when(F.col("ord") % 7 == 0, "lcb")})
    got = gates.written(df, "lcb_easy", lambda rows: rows.write.json(str(tmp_path / "out"))).collect()
    assert ("lcb_easy", "readiness", sum(k % 3 == 0 or k % 7 == 0 for k in range(60))) in map(tuple, got)


def test_rows_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = tasks(spark, 150).where("ord % 9 > 0").mapInArrow(run, TASK)
    folder = str(tmp_path / "train")
    assert prepare.write_checked(df, "mbpp_train", folder).count() == 0 and made.value == 133
    assert jsonl.read(spark, folder, TASK).count() == 133 and not os.path.exists(f"{folder}_refused")
    # a second set that fails leaves the first one in place
    with pytest.raises(gates.GateError, match="synthetic"):
        prepare.write_checked(tasks(spark, 150, synthetic=3).where("ord % 9 > 0"), "mbpp_train", folder)
    assert jsonl.read(spark, folder, TASK).count() == 133 and jsonl.read(spark, f"{folder}_refused", TASK).where("synthetic").count() == 2
    assert {r.gate for r in prepare.write_checked(tasks(spark, 20), "mbpp_train", folder, strict=False).collect()} == {"source_missing"}
    assert jsonl.read(spark, folder, TASK).count() == 20


def test_counts_of_writes(spark, tmp_path):
    n = [gates.counted(spark.range(k), lambda df, k=k: df.write.parquet(str(tmp_path / f"{k}"))) for k in (7, 9)]
    assert n == [7, 9] and gates.require_rows(n[0], 5) == 7
    gates.require_equal_counts(7, n[0])
    with pytest.raises(gates.GateError):
        gates.require_equal_counts(*n)


@pytest.mark.parametrize("n", [0, 19, 20, 21, 100, 140, 1001])
def test_split_has_the_exact_size(spark, n):
    got = {r.id: r.fold for r in pairs.train_eval_split(spark.range(n).repartition(3), "id").collect()}
    order = sorted(range(n), key=lambda k: int(hashlib.sha1(f"42:{k}".encode()).hexdigest()[:15], 16))
    want = set(order[: math.ceil(0.05 * n)]) if n >= 20 else set()
    assert {k for k, fold in got.items() if fold == "eval"} == want and len(got) == n


def test_kth_smallest_of_close_and_equal_places(spark, monkeypatch):
    monkeypatch.setattr(pairs, "_FEW", 3)
    near = [2**59 + k // 2 for k in range(50)] + list(range(40)) + [2**60 - 1] * 5
    df = spark.createDataFrame([(x,) for x in near], "place long")
    for k in (1, 17, 40, 41, 60, 90, 91, 95):
        assert pairs.kth_smallest(df, k) == sorted(near)[k - 1]


def test_rows_of_one_key_stay_together(spark):
    got = pairs.train_eval_split(spark.range(100).select((F.col("id") % 5).alias("key")), "key").groupBy("key").agg(F.countDistinct("fold").alias("n"), F.max("fold").alias("fold")).collect()
    assert {r.n for r in got} == {1} and sum(r.fold == "eval" for r in got) == 1


def test_cases_of_any_form_are_seen(spark):
    wrapper, listed = '{"fn_name": "f", "cases": [{"input": "1", "output": "2"}]}', '[{"type": "call", "input": "1", "output": "2"}]'
    rows = [(wrapper, None, True), (listed, None, True), ("[]", listed, False), ('{"cases": []}', listed, False), (None, listed, True), (None, "assert f()", False), ("no json", listed, True), (None, None, False)]
    df = spark.createDataFrame([(a, b, None if b is None else [b], w) for a, b, w in rows], "lcb_tests string, test_cases string, listed array<string>, want boolean")
    assert all(r.got == r.want for r in df.select(gates.has_cases(df).alias("got"), "want").collect())
    old = df.drop("lcb_tests").withColumn("test_cases", F.when(F.col("listed").isNotNull(), F.transform("listed", lambda x: F.regexp_replace(x, r"^\[|\]$", ""))))
    assert [r.got for r in old.select(gates.has_cases(old).alias("got")).collect()] == [False, False, True, True, True, False, True, False]
    typed = spark.createDataFrame([([("call", "1", "2", "f")], None), ([], listed), (None, listed)], "lcb_tests array<struct<type:string,input:string,output:string,fn_name:string>>, test_cases string")
    assert [r.got for r in typed.select(gates.has_cases(typed).alias("got")).collect()] == [True, False, True]
    assert gates.structured_readiness(df).first().ready == sum(w for *_, w in rows)
