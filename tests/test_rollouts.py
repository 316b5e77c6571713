"""Harvest, layers, pairs, scores, gates and logs on literal rows."""

import json
import math
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracemill.functions import layers, messages, pytext, scores, tokens
from tracemill.operators import execution, gates, harvest, logs, metrics, pairs, prepare, relational
from tracemill.schemas import AUDIT
from tracemill.sources import datasets, jsonl


def completion(think, note, code):
    return f"<think>\n{think}\n</think>\n\n{note}\n\n```python\n{code}\n```\n"


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def log(spark, tmp_path, rows, name="reward_rank0.jsonl"):
    path = tmp_path / "reward_audit" / name
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n", encoding="utf-8")
    return str(path.parent)


def traces(spark, folder, tasks, **options):
    audit = jsonl.read(spark, folder, AUDIT).withColumn("ord", F.struct("path", "line_no"))
    prompts = harvest.prompts_by_task(spark.createDataFrame([(t, p, i) for i, (t, p) in enumerate(tasks)], "task_id string, prompt string, ord int"))
    return harvest.harvest(audit, prompts, **options).orderBy(*harvest.trace_order()).collect()


TASKS = [("mbpp_1", "one"), ("mbpp_2", "two")]


def test_later_window(spark, tmp_path):
    rows = [("mbpp_1", 0, 0), ("mbpp_1", 1, 1), ("mbpp_1", 1, 8), ("mbpp_2", 0.5, 9)]
    folder = log(spark, tmp_path, [{"call": c, "task_id": t, "reward": r, "completion": completion("t", f"note {c}", f"return {c}")} for t, r, c in rows])
    got = traces(spark, folder, TASKS, min_later=1)
    assert [(r.window, r.code) for r in got] == [("later", "return 9"), ("later", "return 8")]
    assert got[0].audit_file == "reward_rank0.jsonl"


def test_fallback_to_all(spark, tmp_path):
    folder = log(spark, tmp_path, [{"call": 0, "task_id": "mbpp_1", "reward": 1, "completion": completion("t", "n", "return 1")}, {"call": 9, "task_id": "mbpp_1", "reward": 0, "completion": completion("t", "n", "return 2")}])
    assert [(r.window, r.code) for r in traces(spark, folder, TASKS, min_later=8)] == [("all", "return 1")]


def test_dedup_keeps_later_call(spark, tmp_path):
    folder = log(spark, tmp_path, [{"call": c, "task_id": "mbpp_1", "reward": 1, "completion": completion("t", n, "same")} for c, n in ((1, "old"), (5, "new"), (5, "newest"))])
    got = traces(spark, folder, TASKS, later_frac=1.0, min_later=1)
    assert [(r.collaboration, r.audit_call) for r in got] == [("newest", 5)]


def test_odd_rewards(spark):
    got = spark.createDataFrame([("0.5",), ("true",), ("nan",), (None,), ("x",), ("",)], "reward string").select(harvest.reward_value(F.col("reward")).alias("r")).collect()
    assert got[0].r == 0.5 and got[1].r == 1.0 and math.isnan(got[2].r) and got[3].r == 0.0 and got[4].r is None and got[5].r == 0.0
    assert harvest.positive(spark.createDataFrame([("nan",), ("0",), ("1",)], "reward string")).count() == 1
    with pytest.raises(ValueError):
        harvest.window_start(spark.createDataFrame([(1,)], "call int"), 0.0)


def test_line_numbers_and_files(spark, tmp_path):
    for name, n in (("reward_rank10.jsonl", 3), ("reward_rank2.jsonl", 2)):
        log(spark, tmp_path, [{"call": i, "task_id": name} for i in range(n)], name)
    got = jsonl.read(spark, str(tmp_path / "reward_audit"), AUDIT).orderBy("path", "line_no").collect()
    assert [(r.file, r.line_no) for r in got] == [("reward_rank10.jsonl", 1), ("reward_rank10.jsonl", 2), ("reward_rank10.jsonl", 3), ("reward_rank2.jsonl", 1), ("reward_rank2.jsonl", 2)]
    assert jsonl.audit_dir(spark, str(tmp_path)) == jsonl.audit_dir(spark, str(tmp_path / "model")) == str(tmp_path / "reward_audit") and jsonl.audit_dir(spark, str(tmp_path / "a/b/c")) is None


def test_malformed_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"task_id": "mbpp_1"}\n\nnot json\n{"task_id": "mbpp_2"}\n', encoding="utf-8")
    with pytest.raises(PySparkException, match="x.jsonl:3"):
        jsonl.read(spark, str(path), "task_id string").collect()
    assert jsonl.read(spark, str(path), "task_id string", mode="skip").count() == 2
    assert [r.corrupt for r in jsonl.read(spark, str(path), "task_id string", mode="quarantine").orderBy("line_no").collect()] == [None, "not json", None]
    assert {r.task_id for r in jsonl.ids(spark, str(path)).collect()} == {"mbpp_1", "mbpp_2"}
    assert jsonl.read(spark, str(tmp_path / "none.jsonl"), "task_id string", missing_ok=True).count() == 0
    assert jsonl.read(spark, str(path), "task_id string", mode="skip", max_rows=1).first().task_id == "mbpp_1"


def test_round_trip_and_append(spark, tmp_path):
    df = spark.createDataFrame([("a", "é\n"), ("b", None)], "task_id string, text string")
    path = str(tmp_path / "out")
    jsonl.write(df, path, order=["task_id"])
    jsonl.append_new(spark.createDataFrame([("b", "again"), ("c", "new")], "task_id string, text string"), path)
    got = jsonl.read(spark, path, "task_id string, text string").orderBy("task_id").collect()
    assert [(r.task_id, r.text) for r in got] == [("a", "é\n"), ("b", None), ("c", "new")]


def reference_layers(output):
    """The same split in plain Python, for random texts."""
    if not output:
        return "", "", ""
    think = re.search(r"<think>(.*?)</think>", output, re.S)
    rest = re.sub(r"<think>.*?</think>", "", output, flags=re.S).strip()
    fence = r"```(?:python)?\s*\n(.*?)```"
    return think[1].strip() if think else "", "\n".join(re.findall(fence, rest, re.S)).strip(), re.sub(fence, "", rest, flags=re.S).strip()


def test_layers_of_random_texts(spark):
    rng = random.Random(7)
    bits = ["<think>", "</think>", "```python\n", "```\n", "```", "```json\n", "def f():\n  pass", "\n\n", " é ", "\x1c", "text ", "\x85"]
    data = [("".join(rng.choice(bits) for _ in range(rng.randrange(12))),) for _ in range(300)]
    got = spark.createDataFrame(data, "x string").select("x", layers.split_layers(F.col("x")).alias("l")).collect()
    for r in got:
        assert tuple(r.l) == reference_layers(r.x), r.x


def test_extract_code(spark):
    assert one(spark, "text\ndef f(x):\n    return x\n\nmore", layers.extract_code) == "def f(x):\n    return x"
    assert one(spark, "def f():\n  pass\n", layers.extract_code) == "def f():\n  pass"
    assert one(spark, None, layers.extract_code) == "" and one(spark, "nothing", layers.extract_code) == ""
    with pytest.raises(PySparkException, match="think"):
        one(spark, "a</think>", layers.reject_think)


@pytest.mark.parametrize(
    "text, ok, overall",
    [
        ('{"clarity": 8, "conciseness": 7, "informativeness": 8, "naturalness": 9, "overall": 8}', True, 8.0),
        ('Here:\n```json\n{"clarity": 6, "conciseness": 7, "informativeness": 6, "naturalness": 7, "overall": 6.5,}\n```', True, 6.5),
        ('{"clarity": 8, "conciseness": 6, "informativeness": 8, "naturalness": 6}', True, 7.0),
        ("clarity: 8, conciseness=6, 'informativeness': 8, naturalness: 6", True, 7.0),
        ('{"clarity": "8", "conciseness": true, "informativeness": 8, "naturalness": 6, "overall": 1}', True, 1.0),
        ('{"clarity": 8, "conciseness": 6, "informativeness": 8, "naturalness": 6, "overall": null}', False, None),
        ('{"clarity": 8, "overall": 8}', False, None),
        ('{"clarity": "x", "conciseness": 6, "informativeness": 8, "naturalness": 6}', False, None),
        ("", False, None),
        (None, False, None),
        ("not json at all", False, None),
    ],
)
def test_judged(spark, text, ok, overall):
    got = one(spark, text, scores.judged)
    assert got.ok is ok and (got.scores.overall if ok else got.scores) == (overall if ok else None)


def test_strict_raises(spark):
    with pytest.raises(PySparkException, match="empty"):
        one(spark, " ", scores.strict)


def test_pair_filter(spark):
    table = [(7.5, 5.0, 6.0, 0.5, True), (5.5, 5.0, 6.0, 0.5, False), (7.5, 8.0, 6.0, 0.5, False), (7.5, 7.2, 6.0, 0.5, False), (7.5, 5.0, 8.0, 0.5, False), (7.5, 6.9, 6.0, 1.0, False), (None, 1.0, 6.0, 0.5, False), (7.0, math.nan, 6.0, 0.5, True)]
    for a, b, t, g, want in table:
        df = spark.createDataFrame([(a, b)], "a double, b double")
        assert df.select(scores.keeps_pair(F.col("a"), F.col("b"), t, g)).first()[0] is want


def pair(**fields):
    base = {"task_id": "1", "task_prompt": "p", "thinking": "t", "code": "c", "rl_collaboration": "rl", "regen_collaboration": "regen", "reward": 1.0}
    return base | fields


def test_structural_filter_and_record(spark):
    rows = [pair(), pair(regen_collaboration=" rl "), pair(code=" "), pair(regen_collaboration="x" * 4001), pair(rl_collaboration=None)]
    df = spark.createDataFrame(rows, "task_id string, task_prompt string, thinking string, code string, rl_collaboration string, regen_collaboration string, reward double")
    got = pairs.filter_structural(df).collect()
    assert len(got) == 1 and got[0].metadata.score_gap is None and got[0].messages[0].role == "system" and "```python\nc\n```" in got[0].messages[1].content
    mock = pairs.filter_mock(df).collect()
    assert {r.metadata.score_gap for r in mock} == {2.5}


def test_template_values_are_not_filled_again(spark):
    df = spark.createDataFrame([("{code}", "{thinking}", "x")], "p string, t string, c string")
    text = df.select(F.get(messages.regeneration(F.col("p"), F.col("t"), F.col("c")), 1)["content"]).first()[0]
    assert "{code}" in text and "{thinking}" in text


def test_rendered_errors(spark):
    old = spark.createDataFrame([("a", "b", "<system>x</system><user>y</user>")], "chosen string, rejected string, prompt string")
    with pytest.raises(PySparkException, match="work trace"):
        pairs.rendered(old).collect()
    plain = pairs.rendered(spark.createDataFrame([("a", "b", "p")], "chosen string, rejected string, prompt string")).first()
    assert plain.messages[0].content == "p"


def test_hypotheses(spark):
    df = spark.createDataFrame([(0.74, 0.82, 0.81, 7.2, 5.5, 7.6)], "a double, b double, c double, x double, y double, z double")
    tags = ("base", "rl", "final")
    got = df.select(F.inline(scores.hypotheses(dict(zip(tags, map(F.col, "abc"))), dict(zip(tags, map(F.col, "xyz")))))).collect()
    assert all(r.verified for r in got) and [r.delta for r in got] == ["+8%", "-1.7", "+2.1", "-1%"]
    none = F.lit(None).cast("double")
    late = df.select(F.inline(scores.hypotheses({"base": F.col("a"), "rl": F.col("b"), "final": none}, {"base": F.col("x"), "rl": F.col("y"), "final": none}))).collect()
    assert [r.skipped for r in late] == [False, False, True, True] and late[2].verified is False
    tie = spark.createDataFrame([(0.25,), (0.75,), (-0.25,), (0.05,)], "x double").select(pytext.signed_one(F.col("x")).alias("s")).collect()
    assert [r.s for r in tie] == [f"{x:+.1f}" for x in (0.25, 0.75, -0.25, 0.05)]


def test_leak_rates(spark):
    df = spark.createDataFrame([(1, "a b c d a b c", "x A b C y"), (2, "a b", "a b"), (3, None, None)], "k int, thinking string, collaboration string")
    got = {r.k: (r.leaked, r.grams) for r in metrics.leak_rates(df, ["k"]).collect()}
    assert got == {1: (2, 5), 2: (0, 0), 3: (0, 0)}
    small = {r.k: r.x for r in df.select("k", metrics.leak_rate(F.col("thinking"), F.col("collaboration")).alias("x")).collect()}
    assert small == {1: 0.4, 2: 0.0, 3: 0.0}


def test_syntax(spark):
    df = spark.createDataFrame([("x = 1",), ("def f(",), ("",), (None,)], "c string")
    assert [r.p for r in df.select(metrics.parses("c").alias("p")).collect()] == [True, False, True, True]


def test_token_masks(spark):
    df = spark.createDataFrame([(1, [7, 8, 1, 8, 99, 99, 99]), (2, [7, 8, 1, 2, 3, 4, 5]), (3, [8, 8, 1, 1, 1, 1, 1])], "k int, ids array<int>")
    ones = F.transform("ids", lambda x: F.lit(1))
    got = {r.k: (r.m, r.d) for r in df.select("k", tokens.fence_mask(F.col("ids"), ones, 7, 8).alias("m"), tokens.fence_done(F.col("ids"), 7, 8).alias("d")).collect()}
    assert got == {1: ([1, 1, 1, 1, 0, 0, 0], True), 2: ([1] * 7, False), 3: ([1] * 7, False)}


def test_objective_ignores_masked_tokens(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1000.0, 0.0], [0, 1])], "p array<double>, r array<double>, m array<int>")
    got = df.select(tokens.masked_loss(F.col("p"), F.col("r"), F.lit(0.0), F.col("m"), 0.1).alias("l"), tokens.token_kl(F.col("p"), F.col("r"), F.col("m")).alias("k")).first()
    assert got.l == 0.0 and got.k == [0.0, 0.0]


def test_train_tasks(spark):
    split = lambda i, **f: spark.createDataFrame([(i, f.get("text", "t"), ["assert f()"], "c", 0)], "task_id long, text string, test_list array<string>, code string, ord int")
    rows = jsonl.union_splits({"train": split(1), "test": split(2), "validation": split(3), "prompt": split(4), "extra": split(5)})
    excluded = gates.numbers(spark.createDataFrame([("Mbpp/2",)], "task_id string")).select("num_id")
    assert sorted(r.task_id for r in prepare.train_tasks(rows, excluded).collect()) == ["mbpp_1", "mbpp_3", "mbpp_4"]
    with pytest.raises(PySparkException, match="without a number"):
        prepare.train_tasks(spark.createDataFrame([("x", 0)], "task_id string, ord int")).collect()


def test_gates(spark):
    train = spark.createDataFrame([("mbpp_602",)], "task_id string")
    bad = gates.disjoint_violations(train, spark.createDataFrame([("Mbpp/602",)], "task_id string"))
    with pytest.raises(gates.GateError, match="contamination"):
        gates.require(bad)
    tasks = spark.createDataFrame([(i, "mbpp_full", i == 21) for i in range(150)], "ord int, source string, synthetic boolean")
    assert gates.dataset_violations(tasks, "mbpp_train").count() == 0
    assert [r.gate for r in gates.dataset_violations(tasks, "mbpp_train", full_scan=True).collect()] == ["synthetic"]
    few = gates.all_violations({"mbpp_train": tasks.limit(3).withColumn("task_id", F.lit("mbpp_1")), "mbpp_plus": tasks.withColumn("task_id", F.lit("Mbpp/1"))})
    assert {(r.dataset, r.gate) for r in few.collect()} == {("mbpp_train", "min_rows"), ("mbpp_plus", "min_rows"), ("mbpp_plus", "source_wrong"), ("train/eval", "contamination")}
    with pytest.raises(gates.GateError):
        gates.require_batch_fits(4, 1, 3)
    gates.require_batch_fits(4, 2, 4)
    with pytest.raises(gates.GateError):
        gates.require_thinking_budget(768, 768)
    with pytest.raises(gates.GateError):
        gates.dataset_violations(tasks, "other")


def test_resume_path(spark, tmp_path):
    root = tmp_path / "model"
    for n, whole in ((50, True), (100, True), (150, False)):
        folder = root / f"checkpoint-{n}"
        folder.mkdir(parents=True)
        (folder / ("trainer_state.json" if whole else "model.bin")).write_text("{}")
    assert gates.resume_path(spark, "auto", str(root)).endswith("/checkpoint-100") and gates.resume_path(spark, True, str(root)).endswith("/checkpoint-100")
    assert [gates.resume_path(spark, x, str(root)) for x in (None, "", "None", False)] == [None] * 4
    assert gates.resume_path(spark, "model/checkpoint-50", str(root)).endswith("/checkpoint-50") and gates.resume_path(spark, str(root / "checkpoint-50"), str(root)).endswith("/checkpoint-50")
    for asked in (str(root / "checkpoint-150"), "nowhere"):
        with pytest.raises(gates.GateError):
            gates.resume_path(spark, asked, str(root))
    with pytest.raises(gates.GateError):
        gates.resume_path(spark, "auto", str(tmp_path / "none"))


def test_datasets_and_configurations(spark, tmp_path):
    spark.createDataFrame([("mbpp_1", "a")], "task_id string, text string").write.parquet(str(tmp_path / "d/train.parquet"))
    (tmp_path / "d/test.jsonl").write_text('{"task_id": "mbpp_2"}\n')
    (tmp_path / "d/notes.txt").write_text("no split")
    found = datasets.splits(spark, str(tmp_path / "d"))
    assert set(found) == {"train", "test"} and jsonl.union_splits(found).count() == 2 and jsonl.first_split(found, ("validation", "test")).first().task_id == "mbpp_2"
    with pytest.raises(FileNotFoundError):
        datasets.splits(spark, str(tmp_path / "none"))
    rows, gone = datasets.shards(spark, [str(tmp_path / "d/test.jsonl"), str(tmp_path / "d/test2.jsonl")], "task_id string")
    assert rows.count() == 1 and [r.path for r in gone.collect()] == [str(tmp_path / "d/test2.jsonl")]
    (tmp_path / "run.log").write_bytes(b"3/300 [1:0<2, 1.5s/it] \xff end")
    text = datasets.log_text(spark, str(tmp_path / "run.log"))
    assert text.first().value.endswith("\ufffd end") and logs.latest_progress(text, 300).first().step == 3
    (tmp_path / "c.yaml").write_text("a: 1\nb: [x]\n")
    (tmp_path / "c.json").write_text('{"a": 2}')
    (tmp_path / "bad.yaml").write_text("- 1\n")
    (tmp_path / "empty.yaml").write_text("")
    assert datasets.config(spark, str(tmp_path / "c.yaml")) == {"a": 1, "b": ["x"]} and datasets.config(spark, str(tmp_path / "c.json")) == {"a": 2} and datasets.config(spark, str(tmp_path / "empty.yaml")) == {}
    with pytest.raises(ValueError):
        datasets.config(spark, str(tmp_path / "bad.yaml"))


def test_inspected_files_and_excluded_numbers(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"task_id": "mbpp_2", "source": "b"}\n{"task_id": "Mbpp/10", "source": "a", "synthetic": true}\n')
    got = jsonl.inspect(spark, str(path)).first()
    assert (got.exists, got.empty, got.n, got.sources, got.synthetic_rows, got.sample_task_ids) == (True, False, 2, ["a", "b"], 1, ["mbpp_2", "Mbpp/10"])
    gone = jsonl.inspect(spark, str(tmp_path / "none.jsonl")).first()
    assert (gone.exists, gone.empty, gone.n) == (False, True, 0)
    assert {r.num_id for r in jsonl.excluded_numbers(spark, str(path)).collect()} == {2, 10}
    path.write_text('{"task_id": "none"}\n')
    with pytest.raises(PySparkException, match="x.jsonl:1"):
        jsonl.excluded_numbers(spark, str(path)).collect()
    tasks = spark.range(120)
    assert prepare.checked(tasks, "mbpp_train") is tasks
    for n, strict in ((99, True), (0, False)):
        with pytest.raises(gates.GateError):
            prepare.checked(tasks.limit(n), "mbpp_train", strict)


def test_reward_callable_and_its_log(spark, tmp_path):
    reward = execution.reward_callable(spark, str(tmp_path / "log"), rank=3)
    good = completion("t", "n", "def f():\n    return 1")
    assert reward([good, "no code", good, good], ["[\"assert f() == 1\"]", ["assert f() == 2", "assert f() == 1"]], ["a", "b"]) == [1.0, 0.0, 0.5, 0.5]
    assert reward([good], [["assert f() == 1"]]) == [1.0]
    log_rows = spark.read.json(str(tmp_path / "log")).orderBy("call", "task_id", "reward").collect()
    assert [(r.call, r.task_id, r.reward, r["rank"]) for r in log_rows] == [(0, "a", 0.0, 3), (0, "a", 1.0, 3), (0, "b", 0.5, 3), (0, "b", 0.5, 3), (1, None, 1.0, 3)]
    assert all(r.completion_chars == len(r.completion) for r in log_rows)
    for texts, tests in (([good] * 3, [["assert 1"]] * 2), ([good], []), ([good], [None])):
        with pytest.raises(gates.GateError):
            reward(texts, tests)
    bad = spark.createDataFrame([("[1, 2", 1), (None, 2)], "t string, i int")
    for i, why in ((1, "no JSON list"), (2, "is null")):
        with pytest.raises(PySparkException, match=why):
            bad.where(F.col("i") == i).select(execution.listed_tests(F.col("t"))).collect()


def test_programs_that_print_without_end():
    assert execution.run_program("while True:\n    print('x' * 10000)", timeout=5)[:2] == (False, "")
    assert execution.run_program("print('a\\r\\nb')")[:2] == (True, "a\nb\n")
    assert execution.passes_case("def f(x):\n    return x", {"type": "call", "fn_name": "f", "args": "3", "expected": "3"})


def test_row_counts_and_budgets(spark):
    rows = spark.range(5)
    assert gates.require_rows(rows, 5) == 5 and gates.require_rows(rows, 9, strict=False) == 5
    for df, least in ((rows, 6), (rows.limit(0), 0)):
        with pytest.raises(gates.GateError):
            gates.require_rows(df, least)
    gates.require_equal_counts(rows, rows)
    with pytest.raises(gates.GateError):
        gates.require_equal_counts(rows, rows.limit(2))


def test_live_traces_and_folds(spark):
    rows = spark.createDataFrame([("a", "p", completion("t", "n", "x = 1"))], "task_id string, prompt string, output string")
    got = harvest.live_trace(rows, F.col("output"), F.lit(0.5)).first()
    assert (got.thinking, got.collaboration, got.code, got.reward, got.work_trace) == ("t", "n", "x = 1", 0.5, "t\n[CODE]\nx = 1")
    many = pairs.train_eval_split(spark.range(4000).withColumnRenamed("id", "k"), "k")
    assert 120 < many.where("fold = 'eval'").count() < 280 and pairs.train_eval_split(spark.range(19).withColumnRenamed("id", "k"), "k").where("fold = 'eval'").count() == 0


def test_logs(spark):
    text = " 3%| | 10/300 [1:01:08<29:17:09, 363.55s/it]\n 3%| | 10/300 [1:02:00<29:00:00, 360.00s/it] 4%| | 11/300 [1:08<2:2, 1.5s/it]\n{'loss': 0.1, 'reward': 0.5, 'epoch': 0.25} {'loss': nan, 'epoch': 1} {'loss': 1, 'reward': 2}"
    df = spark.createDataFrame([(0, text)], "place int, value string")
    assert [(r.step, r.sec_per_it) for r in logs.latest_progress(df).orderBy("step").collect()] == [(10, 360.0), (11, 1.5)]
    events = logs.metric_events(df).collect()
    assert [(r.loss, r.epoch) for r in events] == [(0.1, 0.25)]


def test_shards_and_fan_out(spark):
    for n, p in ((10, 4), (11, 4), (7, 3), (3, 3), (2, 5)):
        got = relational.shard_of(spark.range(n).withColumnRenamed("id", "ord"), p, "ord").orderBy("ord").collect()
        p_ = min(p, n)
        want = [s for s in range(p_) for _ in range(n // p_ + (s < n % p_))]
        assert [r.shard for r in got] == want
    prompts = spark.range(2).withColumnRenamed("id", "ord").withColumn("p", F.col("ord") * 10)
    done = relational.fan_out(prompts, spark.range(4).withColumnRenamed("id", "ord"), 2).orderBy("ord").collect()
    assert [r.p for r in done] == [0, 0, 10, 10]
    with pytest.raises(PySparkException, match="length mismatch"):
        relational.fan_out(prompts, spark.range(3).withColumnRenamed("id", "ord"), 2).collect()


def test_programs(spark):
    good, bad = "def add(a, b):\n    return a + b", "def add(a, b):\n    return a - b"
    tests = ["assert add(1, 2) == 3", "assert add(0, 0) == 0", "assert add(2, 2) == 5"]
    rows = spark.createDataFrame([(1, good, tests), (2, "", tests), (3, bad, tests), (4, good, [])], "ord int, code string, test_cases array<string>")
    assert {r.ord: round(r.reward, 4) for r in execution.rewards(rows).collect()} == {1: 0.6667, 2: 0.0, 3: 0.3333, 4: 0.0}
    assert execution.passes_case("a, b = map(int, input().split())\nprint(a + b)  ", {"type": "stdin", "input": "1 2\n", "output": "3\n"})
    assert execution.passes_case(good, {"type": "call", "fn_name": "add", "input": "1\n2", "output": "3"})
    assert execution.passes_case("class Solution:\n    def f(self, x):\n        return (x, x)", {"type": "call", "fn_name": "f", "input": "[1]", "output": "[1, 1]"})
    assert not execution.passes_test("while True:\n    pass", "", timeout=1)
    assert not execution.passes_test("open('/tmp/x' * 1000)", "")
    assert execution.plus_asserts("add", good, "[[1, 2], [1], [\"a\", \"b\"]]") == ["assert add(1, 2) == 3", "assert add('a', 'b') == 'ab'"]


def test_disabled_source():
    with pytest.raises(RuntimeError):
        prepare.legacy_eval_tasks()
