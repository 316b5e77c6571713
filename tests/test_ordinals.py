"""Line numbers over splits of any size, ranks by any key, and rows at chosen places."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from tracemill.operators import harvest, relational
from tracemill.sources import jsonl


@pytest.fixture
def setting(spark):
    before = {}

    def put(name, value):
        before.setdefault(name, spark.conf.get(name, None))
        spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("lines"), random.Random(2)
    want = {}
    for name, n in (("a10.txt", 700), ("a2.txt", 3), ("b.txt", 2500), ("empty.txt", 0)):
        lines = ["" if rng.random() < 0.1 else f"{k} é " + "x" * rng.randrange(200) for k in range(n)]
        (folder / name).write_bytes("".join(line + rng.choice(("\n", "\n", "\r\n")) for line in lines).encode())
        want |= {(name, k): line for k, line in enumerate(lines, 1)}
    return str(folder), want


@pytest.mark.parametrize("size", ["1k", "16k", "1m"])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_line_numbers_in_splits_of_any_size(spark, setting, files, size, adaptive):
    folder, want = files
    for name, value in (("spark.sql.files.maxPartitionBytes", size), ("spark.sql.files.openCostInBytes", "10"), ("spark.sql.adaptive.enabled", adaptive)):
        setting(name, value)
    got = {(r.file, r.line_no): r.value for r in jsonl.lines(spark, folder).collect()}
    assert got == want and (size != "1k" or spark.read.text(folder).rdd.getNumPartitions() > 100)
    # pruned columns, filters on the file and the line, and a shuffle behind the scan
    df = jsonl.lines(spark, folder)
    assert collections.Counter(r.line_no for r in df.select("line_no").collect()) == collections.Counter(k for _, k in want)
    assert [r.line_no for r in df.where("file = 'a2.txt'").orderBy("line_no").collect()] == [1, 2, 3]
    assert df.repartition(7, "line_no").where("line_no = 700 and value <> ''").count() == sum(k == 700 and v != "" for (_, k), v in want.items())
    index = jsonl.split_index(spark, folder).orderBy("path", "block").collect()
    assert [r.before for r in index if r.block == 0] == [0] * len({f for f, _ in want}) and all(r.before >= 0 for r in index)


def test_a_split_that_was_not_counted_is_an_error(spark, files, monkeypatch):
    index = jsonl.split_index(spark, files[0]).where("path not like '%b.txt'")
    monkeypatch.setattr(jsonl, "split_index", lambda *_: index)
    with pytest.raises(Exception, match="no lines counted"):
        jsonl.lines(spark, files[0]).collect()


@pytest.mark.parametrize("rows", [1 << 20, 30, 7])
def test_ranks_by_strings_pairs_and_dates(spark, monkeypatch, rows):
    monkeypatch.setattr(relational, "ROWS_A_RANGE", rows)
    monkeypatch.setattr(relational, "SUMS", 4)  # trees of several levels
    rng = random.Random(rows)
    data = [(f"k{rng.randrange(60):03}" if rng.random() < 0.95 else None, k, f"2024-01-{1 + k % 28:02}") for k in range(400)]
    df = spark.createDataFrame(data, "s string, k int, d string").withColumn("d", F.to_date("d")).repartition(5)
    for order, key in ((("s", "k"), lambda r: (r.s is not None, r.s or "", r.k)), (("d", "k"), lambda r: (r.d, r.k)), (("k",), lambda r: r.k)):
        got = relational.rank(df, *order).collect()
        assert [r["rank"] for r in sorted(got, key=key)] == list(range(1, 401)), order
    tied = relational.rank(df, "s").collect()
    assert sorted(r["rank"] for r in tied) == list(range(1, 401)) and [r.s for r in sorted(tied, key=lambda r: r["rank"])] == sorted((r[0] for r in data), key=lambda s: (s is not None, s or ""))
    assert relational.rank(df.where("false"), "s").count() == 0


def test_ranges_grow_with_the_rows_and_ranks_stay_when_read_again(spark, monkeypatch):
    monkeypatch.setattr(relational, "ROWS_A_RANGE", 100)
    seen, write = [], relational.scratch.write
    monkeypatch.setattr(relational.scratch, "write", lambda df, tag: seen.append(write(df, tag)) or seen[-1])
    for n in (90, 1000, 10_000):
        ranked = relational.rank(spark.range(n).withColumn("x", F.rand()), "x")
        assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, ranked.collect()))  # a random order too is drawn once
    sizes = [[r["count"] for r in t.groupBy("part_").count().collect()] for t in seen]
    assert [len(s) for s in sizes] == [1, 10, 100] and max(map(max, sizes)) < 300


@pytest.mark.parametrize("most", [10_000_000, 3])
def test_rows_at_places(spark, monkeypatch, most):
    monkeypatch.setattr(relational, "PLACES", most)
    df = spark.range(5000).select("id", F.struct(F.concat(F.lit("p"), F.col("id") % 7).alias("path"), "id").alias("place"), F.repeat(F.lit("x"), 50).alias("text"))
    chosen = df.where("id % 501 = 3").select("place", (F.col("id") * 2).alias("twice"))
    got = relational.at_places(df, chosen, "place").collect()
    assert sorted((r.id, r.twice) for r in got) == [(k, 2 * k) for k in range(3, 5000, 501)] and relational.at_places(df, chosen.where("false"), "place").count() == 0


def exchanges_of(df, column):
    """For each exchange of the plan that carries a column, whether a bitmap was applied below it."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    lines = text.splitlines()
    depth = lambda s: len(re.match(r"[\s:+\-|]*", s).group())
    out = []
    for k, line in enumerate(lines):
        if " Exchange " in f" {line.lstrip(' :+-')} " or line.lstrip(" :+-").startswith("Exchange"):
            below = []
            for other in lines[k + 1 :]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            if below and f"{column}#" in below[0]:
                out.append(any("getbit" in x or "bit_get" in x for x in below))
    return out


def test_texts_of_rows_that_lost_are_not_shuffled(spark, setting):
    """All exchanges of completions stand above the bitmap of the winners."""
    for name, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        setting(name, value)
    text = F.concat(F.lit("<think>t</think>words\n```python\ndef f(): return "), F.col("id") % 40, F.lit("\n```"))
    log = spark.range(20_000).select(F.col("id").alias("ord"), (F.col("id") % 50).cast("string").alias("call"), F.concat(F.lit("t"), F.col("id") % 10).alias("task_id"), F.lit("1").alias("reward"), text.alias("completion"))
    prompts = spark.createDataFrame([(f"t{k}", "p") for k in range(10)], "task_id string, task_prompt string")
    traces = harvest.harvest(log, prompts)
    found = exchanges_of(traces, "completion")
    assert found and all(found)
    keys = {(k % 10, k % 40) for k in range(20_000)}
    assert traces.count() == len(keys)
    few = harvest.harvest(log, prompts, max_traces=5).collect()
    assert [(r.audit_call, r.task_id) for r in few] == sorted(((r.audit_call, r.task_id) for r in traces.collect()), key=lambda x: (-x[0], x[1]))[:5]
