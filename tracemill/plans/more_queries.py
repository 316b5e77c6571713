"""Registered queries of evaluation control, gates, readers and reports, with their SQL (see queries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill import scratch
from tracemill.functions import cases, layers, messages, pytext, scores
from tracemill.operators import evaluation, execution, gates, logs, metrics, pairs, prepare, relational
from tracemill.schemas import CASE, SCORE_KEYS

from . import bridge as b
from .queries import _CAND, _GRAMS, _HYPOTHESES, _LENIENT, _TAGGED, _TRAIN, L, _checks, _layers, _q, _split_tables, jsonl, query

_TESTS = "'[\"assert f(' || cast(item_id as {T}) || ')\", \"assert g()\"]'"


@query("select item_id, 'assert f(' || cast(item_id as varchar) || ')' as first_test, 2 as n_tests from benchmark")
def tests_from_json(spark, sf):
    rows = b.table(spark, sf, "benchmark").select("item_id", execution.listed_tests(F.expr(_TESTS.replace("{T}", "string"))).alias("tests"))
    return rows.select("item_id", F.get("tests", 0).alias("first_test"), F.size("tests").alias("n_tests"))


@query("select item_id, 'call' as type, cast(item_id as varchar) as input, case when item_id % 2 = 0 then 'e' else 'x' end as output from benchmark")
def case_fallbacks(spark, sf):
    raw = F.expr("""'[{"type": "call", "fn_name": "f", ' || case when item_id % 2 = 0 then '"args": "' || item_id || '", "expected": "e"' else '"input": "' || item_id || '", "args": "no", "output": "x", "expected": "no"' end || '}]'""")
    rows = b.table(spark, sf, "benchmark").select("item_id", F.explode(cases.task_cases(raw)).alias("c"))
    return rows.select("item_id", "c.type", "c.input", "c.output")


@query(f"with {_CAND}, q as ({_LENIENT}) select doc_id, overall >= 6.0 as passes from q")
def judge_flags(spark, sf):
    return b.judge(spark, sf).select("doc_id", scores.passes(scores.lenient_answer(F.col("answer"))).alias("passes"))


@query("select count(*) as n, count(*) filter (where item_id % 3 = 0) as ready, count(*) filter (where item_id % 3 = 0)::double / count(*) as ready_frac, false as passed from benchmark")
def structured_gate(spark, sf):
    own = F.expr(f"case when item_id % 3 = 0 then array(named_struct('type', 'call', 'input', '1', 'output', '2', 'fn_name', 'f')) else cast(array() as array<{CASE}>) end")
    return gates.structured_readiness(b.table(spark, sf, "benchmark").select(own.alias("lcb_tests"), F.lit("lcb").alias("harness")))


_READY = "with k as (select count(*) as n, count(*) filter (where item_id % 5 = 0 or item_id % 7 = 0) as r from benchmark) select 'lcb_easy' as dataset, 'readiness' as gate, r as n from k where r < greatest(1, floor(n * 0.5)) union all select 'lcb_easy', 'example_file', n from k union all select 'lcb_easy', 'source_wrong', 0 from k"


@query(_READY)
def readiness_gate(spark, sf):
    own = F.expr(f"case when item_id % 5 = 0 then array(named_struct('type', 'call', 'input', '1', 'output', '2', 'fn_name', 'f')) else cast(array() as array<{CASE}>) end")
    rows = b.table(spark, sf, "benchmark").select(F.col("item_id").alias("ord"), F.lit("other").alias("source"), F.lit(False).alias("synthetic"), own.alias("lcb_tests"), F.expr("case when item_id % 7 = 0 then 'lcb' else 'assert' end").alias("harness"))
    return gates.dataset_violations(rows, "lcb_easy", path="lcb.example.jsonl")


_FORMS = """case item_id % 5 when 0 then '{"mode": "call", "fn_name": "f", "cases": [{"input": "' || item_id || '", "output": "1"}]}' when 1 then '[]' when 2 then '{"cases": []}' end"""
_OLD = """case when item_id % 5 = 3 then '[{"input": "' || item_id || '", "output": "2"}]' when item_id % 5 = 4 then 'assert f()' else '[{"input": "1", "output": "2"}]' end"""


@query("with k as (select count(*) as n, count(*) filter (where item_id % 5 in (0, 3)) as r from benchmark) select n, r as ready, r::double / n as ready_frac, r::double / n >= 0.5 as passed, (select count(*) from k where r < greatest(1, floor(n * 0.5))) as violations from k")
def readiness_forms(spark, sf):
    rows = b.table(spark, sf, "benchmark").select(F.col("item_id").alias("ord"), F.lit("livecodebench_easy").alias("source"), F.lit(False).alias("synthetic"), F.expr(_FORMS).alias("lcb_tests"), F.expr(_OLD).alias("test_cases"), F.lit("assert").alias("harness"))
    found = gates.dataset_violations(rows, "lcb_easy").where("gate = 'readiness'").agg(F.count(F.lit(1)).alias("violations"))
    return gates.structured_readiness(rows).crossJoin(found)


@query("with k as (select count(*) filter (where item_id % 2 = 0) as n from benchmark) select 'mbpp_plus' as dataset, 'missing' as gate, 0::bigint as n from k where n = 0 union all select 'mbpp_train', 'missing', 0 from benchmark where item_id = -1 having count(*) = 0 union all select 'other', 'unknown', 0")
def missing_gate(spark, sf):
    """Datasets as the given table has them: even items in one file, items of number -1, of which there are none, in no file."""
    items, folder = b.table(spark, sf, "benchmark"), scratch.place(spark, "datasets")
    for name, rows in (("mbpp_plus", items.where("item_id % 2 = 0")), ("mbpp_train", items.where("item_id = -1"))):
        if not rows.isEmpty():
            rows.write.parquet(f"{folder}/{name}")
    return gates.missing_violations(spark, {k: f"{folder}/{k}" for k in ("mbpp_plus", "mbpp_train")} | {"other": f"{sf}/benchmark.parquet"})


@query("select 'length_mismatch' as gate, count(*) * 2 + 1 as n from benchmark union all select 'null_tests', count(*) filter (where item_id % 4 = 1) from benchmark")
def alignment_gate(spark, sf):
    rows = b.table(spark, sf, "benchmark").select(F.expr("case when item_id % 4 = 1 then null else array('assert f()') end").alias("test_cases"))
    n = rows.count()
    return gates.alignment_violations(rows, 2 * n + 1, 2 * n + 1).unionByName(gates.alignment_violations(rows.where("test_cases is not null"), 0, 0))


@query(f"with {_TRAIN}, o as (select distinct num_id from numbered where num_id in (select num_id from excl)), t as (select num_id from o order by num_id limit 10) select (select count(*) from o) as n, (select string_agg(cast(num_id as varchar), ',' order by num_id) from t) as examples")
def overlap_first10(spark, sf):
    found = gates.overlap_examples(jsonl.union_splits(_split_tables(spark, sf)), b.eval_ids(spark, sf))
    return found.select("n", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


_STEP = "50 * (event_id % 97 + user_id % 5 + 1)"


@query(f"select max({_STEP}) as step, 'r/checkpoint-' || max({_STEP}) as path from events where event_type <> 'error' having count(*) > 0")
def newest_checkpoint(spark, sf):
    # every event is a folder; those of errors have no state
    names = b.table(spark, sf, "events").select(F.expr(f"'r/checkpoint-' || {_STEP} || case when event_type <> 'error' then '/trainer_state.json' else '0/model.bin' end").alias("path"))
    return gates.newest_checkpoint(names)


@query("select item_id, 'Mbpp/' || cast(item_id as varchar) as task_id, text as prompt, 2 as n_base_tests, item_id % 3 as n_plus_tests, 2 + item_id % 3 as n_tests, 'mbpp_plus' as benchmark from benchmark")
def eval_task_rows(spark, sf):
    items = b.table(spark, sf, "benchmark")
    rows = items.select(F.expr("'Mbpp/' || item_id").alias("task_id"), F.col("text").alias("prompt"), F.lit("f").alias("entry_point"), F.lit("def f(): pass").alias("canonical_solution"), F.lit("x = 1\n  assert f(1)\nassert f(2)\nassertion").alias("assertion"), F.expr("slice(array('assert p', 'assert q'), 1, cast(item_id % 3 as int))").alias("extra"))
    made = prepare.eval_tasks(rows, F.col("extra"))
    return made.select(pytext.numeric_id(F.col("task_id")).alias("item_id"), "task_id", "prompt", F.col("n_base_tests").cast("int"), "n_plus_tests", F.size("test_cases").cast("bigint").alias("n_tests"), "benchmark")


@query(f"select item_id as ord, coalesce(case when item_id % 2 = 0 then 't' || cast(item_id as varchar) end, 'task_' || cast(item_id as varchar)) as task_id, text as raw_prompt, regexp_replace(text, '{b.WS}+$', '') || {_q(messages.EXAMPLE_LEAD)} || 'assert f(1)' || {_q(messages.CODING_SUFFIX)} as content, 2 as n_tests from benchmark order by item_id limit 30")
def training_task_rows(spark, sf):
    rows = b.table(spark, sf, "benchmark").select(F.col("item_id").alias("ord"), F.expr("case when item_id % 2 = 0 then 't' || item_id end").alias("task_id"), F.col("text").alias("prompt"), F.expr("array('assert f(1)', 'assert f(2)')").alias("test_cases"))
    made = prepare.training_rows(rows, 30)
    return made.select("ord", "task_id", "raw_prompt", F.get("messages", 0)["content"].alias("content"), F.size("test_cases").alias("n_tests"))


_JUDGED = f"""with {b.PAIRS_SQL}, j as (select *, conv_id_ % 4 as form from (select *, ord // 1000 as conv_id_ from pairs) z),
 k as (select *, form <> 3 as ok, case form when 0 then 8.0 when 1 then 5.5 when 2 then 6.25 end as r, case form when 2 then 6.0 else 5.0 end as l from j)"""


@query(_JUDGED + " select count(*) filter (where ok and r >= 6.0 and r > l and r - l >= 0.5) as kept, count(*) as total, count(*) filter (where not ok) as errors, count(*) filter (where not ok) > 0.25 * count(*) as too_many_errors from k")
def judged_pair_counts(spark, sf):
    return _judged(spark, sf)[1]


@query(_JUDGED + " select task_id, regen_collaboration as chosen, r::double as regen_overall, (r - l)::double as score_gap from k where ok and r >= 6.0 and r > l and r - l >= 0.5")
def judged_pair_records(spark, sf):
    return _judged(spark, sf)[0].select("metadata.task_id", "chosen", F.col("metadata.regen_score.overall").alias("regen_overall"), "metadata.score_gap")


def _judged(spark, sf):
    rows = b.pairs(spark, sf)
    answer = lambda x: "'{\"clarity\": 1, \"conciseness\": 1, \"informativeness\": 1, \"naturalness\": 1, \"overall\": ' || " + x + " || '}'"
    regen = F.expr(f"case (ord div 1000) % 4 when 0 then {answer('8.0')} when 1 then {answer('5.5')} when 2 then {answer('6.25')} else 'no answer' end")
    rl = F.expr(f"case (ord div 1000) % 4 when 2 then {answer('6.0')} else {answer('5.0')} end")
    sides = rows.select("ord", F.lit("regen").alias("side"), regen.alias("content")).unionByName(rows.select("ord", F.lit("rl").alias("side"), rl.alias("content")))
    return pairs.filter_judged(rows, sides, ["ord"])


@query("select doc_id, case when doc_id % 3 = 0 then quality::double else toxic::double + 10 end as coding from labels")
def aliased_metric(spark, sf):
    named = F.expr("case when doc_id % 3 = 0 then map('pass_rate', cast(quality as double), 'coding', 99.0d) else map('mbpp_plus_pass1', cast(null as double), 'coding', cast(toxic as double) + 10) end")
    return b.table(spark, sf, "labels").select("doc_id", scores.aliased(named, scores.CODING_NAMES).alias("coding"))


@query(f"with {_TAGGED}, h as ({_HYPOTHESES}), d as (select id, verified, case when id like 'H1%' then rl - base when id like 'H4%' then final - rl when id like 'H2%' then rl - base else final - rl end as x, id like 'H1%' or id like 'H4%' as percent from h), p as (select *, case when percent then x * 100 else x end as v from d) select id, verified, false as skipped, case when percent and abs(v - round(v)) < 1e-9 then printf('%+d%%', cast(round(v) as bigint)) when percent then printf('%+.1f%%', v) else printf('%+.1f', v) end as delta from p")
def hypothesis_deltas(spark, sf):
    return _checks(spark, sf).select(F.inline("h")).select("id", "verified", "skipped", "delta")


@query("select doc_id, lower(case doc_id % 6 when 0 then 'YES' when 1 then 'true' when 2 then '1' when 3 then 'no' when 4 then 'T' else lang end) in ('1', 'true', 't', 'yes', 'y') as flag from documents")
def truthy_text(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", pytext.truthy(F.expr("case doc_id % 6 when 0 then 'YES' when 1 then 'true' when 2 then '1' when 3 then 'no' when 4 then 'T' else lang end")).alias("flag"))


@query(f"with {b.AUDIT_SQL}, {_GRAMS.replace('@TH@', L['thinking']).replace('@CO@', L['collaboration']).replace('@M@', '2')} select count(*) as n, round(avg(coalesce(leaked, 0)::double / nullif(coalesce(grams, 0), 0)) filter (where grams > 0) * count(*) filter (where grams > 0) / count(*), 9) as mean_leak_rate from audit a left join s using (ord)")
def mean_leak(spark, sf):
    return metrics.mean_leak_rate(metrics.leak_rates(_layers(b.audit(spark, sf)), ["ord"])).select("n", F.round("mean_leak_rate", 9).alias("mean_leak_rate"))


@query("with c as (select row_number() over (order by date_trunc('day', ts)) as cycle, count(*) filter (where value > 50)::double / count(*) as v from events group by date_trunc('day', ts)), g as (select cycle, v - lag(v) over (order by cycle) as gain from c) select cycle, round(gain, 9) as gain, coalesce(gain < 0.01 and lag(gain) over (order by cycle) < 0.01, false) as stop from g")
def stop_rule(spark, sf):
    days = b.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg((F.count_if(F.col("value") > 50) / F.count(F.lit(1))).alias("v"), F.unix_date(F.to_date(F.min("ts"))).alias("place"))
    cycles = relational.rank(days, "place").select(F.col("rank").alias("cycle"), "v")
    return metrics.gains(cycles, "v").select("cycle", F.round("gain", 9).alias("gain"), "stop")


_PROGRAM = "case item_id % 4 when 0 then 'import os\n\nasync def a' || cast(item_id as {T}) || '():\n    def inner(): pass\n' when 1 then 'class K:\n    def m(self): pass\n\ndef b(): pass\n' when 2 then 'def broken' || cast(item_id as {T}) || '(:\n' else 'x = 1' end"


@query("select item_id, case item_id % 4 when 0 then 'a' || cast(item_id as varchar) when 1 then 'b' when 2 then 'broken' || cast(item_id as varchar) end as name from benchmark")
def parsed_names(spark, sf):
    return b.table(spark, sf, "benchmark").select("item_id", layers.first_function(F.expr(_PROGRAM.replace("{T}", "string"))).alias("name"))


@query("with l as (select text, row_number() over (order by item_id) as rank from benchmark), r as (select doc_id, row_number() over (order by doc_id) as rank from documents) select rank, text, doc_id from l join r using (rank)")
def zipped_outputs(spark, sf):
    left, right = b.table(spark, sf, "benchmark").select("item_id", "text"), b.table(spark, sf, "documents").select("doc_id")
    return relational.zip_rows(left, right, "item_id", "doc_id").select(F.col("rank").cast("bigint").alias("rank"), "text", "doc_id")


@query(f"with {b.AUDIT_SQL} select call, task_id, round(reward, 3) as reward, contains(completion, '</think>') as has_think_end, contains(lower(completion), '```python') as has_python_fence, length(completion) as completion_chars, completion from audit")
def audited_rows(spark, sf):
    return execution.audited(b.audit(spark, sf)).withColumn("reward", F.round("reward", 3))


@query(f"with {b.PAIRS_SQL} select ord, {_q(chr(60) + 'think>' + chr(10) + messages.TRACE_THOUGHT[0])} || substr(task_prompt, 1, 120) || {_q(messages.TRACE_THOUGHT[1] + chr(10) + '</think>' + chr(10) + chr(10) + messages.TRACE_NOTE + chr(10) + chr(10) + '```python' + chr(10))} || coalesce(nullif(code, ''), {_q(messages.TRACE_CODE)}) || {_q(chr(10) + '```' + chr(10))} as output from pairs")
def mock_traces(spark, sf):
    return b.pairs(spark, sf).select("ord", messages.mock_trace(F.col("task_prompt"), F.col("code")).alias("output"))


_SOLVED = "case item_id % 4 when 0 then 'def f(x):\n    return x + 1\n' when 1 then 'def f(x):\n    return x\n' else 'def f(x):\n    return x +\n' end"
_MODES_SQL = """t as (select item_id, row_number() over (order by item_id) as place, item_id % 4 as k from benchmark where item_id % 2 = 0),
 u as (select item_id, row_number() over (order by item_id) as place, item_id % 4 as k from benchmark where item_id % 2 = 1),
 one as (select (select avg((k = 0)::int) from t where place <= 12) as p, (select avg((k > 1)::int) from t where place <= 12) as e, (select avg((k = 0)::int) from u where place <= 12) as q, (select least(12, count(*)) from t) as nt, (select least(12, count(*)) from u) as nu, (select least(5, count(*)) from t) as nr)"""


@query(f"with {_MODES_SQL} select mode, case when b then nt + nu else nr end as generated, case when b then p end as pass1, case when b then e end as syntax_error_rate, case when b then q end as secondary_pass1, case when b then 1.0::double end as ready, case when r then 7.5::double end as readability, case when r then 2.0::double end as words from one, (values ('full', true, true), ('benchmark', true, false), ('readability', false, true)) v(mode, b, r)")
def evaluation_modes(spark, sf):
    items = b.table(spark, sf, "benchmark")
    case = F.expr("array(named_struct('type', 'call', 'input', '1', 'output', '2', 'fn_name', 'f'))")
    named = items.select(F.col("item_id").alias("ord"), F.col("text").alias("prompt"), F.expr("array('assert f(1) == 2')").alias("test_cases"))
    primary = named.where("ord % 2 = 0").withColumns({"lcb_tests": F.lit(None).cast(f"array<{CASE}>"), "harness": F.lit("assert")})
    secondary = named.where("ord % 2 = 1").withColumns({"lcb_tests": case, "harness": F.lit("lcb")})
    program = F.expr(_SOLVED.replace("item_id", "ord"))
    generate = lambda tasks: tasks.select("bench", "ord", F.concat(F.lit("<think>t</think>Two words\n```python\n"), program, F.lit("```")).alias("output"))
    judge = lambda prompt, text: F.struct(*(F.lit(7.5).alias(k) for k in SCORE_KEYS))
    parts = [evaluation.run(primary, secondary, generate, judge, mode=m, num_benchmark=12, num_readability=5).withColumn("mode", F.lit(m)) for m in ("full", "benchmark", "readability")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.select("mode", "generated", F.col("mbpp_plus_pass1").alias("pass1"), "syntax_error_rate", F.col("lcb_easy_pass1").alias("secondary_pass1"), F.col("lcb_ready_frac").alias("ready"), F.col("readability_overall").alias("readability"), F.col("avg_collab_length").alias("words"))


@query("select item_id as ord, item_id % 2 = 0 as passed from benchmark")
def pass_stdin(spark, sf):
    items = b.table(spark, sf, "benchmark").select(F.col("item_id").alias("ord"))
    case = F.array(F.struct(F.lit("stdin").alias("type"), F.concat(F.col("ord").cast("string"), F.lit(" 2\n")).alias("input"), F.concat((F.col("ord") + 2 + F.col("ord") % 2).cast("string"), F.lit("  \n\n")).alias("output"), F.lit(None).cast("string").alias("fn_name")))
    code = F.lit("a, b = map(int, input().split())\nprint(a + b)\n")
    rows = items.select("ord", code.alias("code"), F.array().cast("array<string>").alias("test_cases"), case.alias("cases"), F.lit("lcb").alias("harness"))
    return execution.passed_tasks(rows)


@query("select item_id, 'assert f(' || cast(item_id as varchar) || ') == ' || cast(item_id * 2 as varchar) as first_test, 2 as n_tests from benchmark")
def plus_cases(spark, sf):
    inputs = F.expr("'[[' || item_id || '], [3], [1, 2]]'")
    solution = F.lit("def f(x):\n    return x * 2\n")
    rows = b.table(spark, sf, "benchmark").select("item_id", execution.plus_udf()(F.lit("f"), solution, inputs).alias("tests"))
    return rows.select("item_id", F.get("tests", 0).alias("first_test"), F.size("tests").alias("n_tests"))


@query("select count(*) as n, avg((doc_id % 3 = 0)::int::double) as pass_at_1, avg(length(coalesce(source, ''))::double) as avg_code_length, avg((doc_id % 2 = 0)::int::double) as executable_assert_task_frac, avg((doc_id % 4 > 0)::int::double) as lcb_ready_frac from documents")
def benchmark_summary(spark, sf):
    rows = b.table(spark, sf, "documents").select((F.col("doc_id") % 3 == 0).alias("passed"), F.coalesce("source", F.lit("")).alias("code"), F.expr("case when doc_id % 2 = 0 then array('assert f()') else array('f()') end").alias("test_cases"), (F.col("doc_id") % 4).alias("n_cases"))
    return metrics.benchmark_metrics(rows).select("n", "pass_at_1", "avg_code_length", "executable_assert_task_frac", "lcb_ready_frac")


@query(f"with {b.LOG_SQL}, m as (select place, unnest(regexp_extract_all(value, '(\\d+)/300\\s+\\[', 1)) as step from log) select max(step::bigint) as last_step, count(distinct step::bigint) as steps from m")
def progress_span(spark, sf):
    return logs.latest_progress(b.log(spark, sf)).agg(F.max("step").alias("last_step"), F.count(F.lit(1)).alias("steps"))


@query("select doc_id, case when n >= 20 and row_number() over (order by cast('0x' || substr(sha1('42:' || doc_id), 1, 15) as bigint)) <= ceil(0.05::double * n) then 'eval' else 'train' end as fold from documents, (select count(*) as n from documents) c")
def train_eval_fold(spark, sf):
    return pairs.train_eval_split(b.table(spark, sf, "documents").select("doc_id"), "doc_id")



_ALL_ROWS = "g as (select case when doc_id % 50 = 3 then '' when doc_id % 2 = 0 then 'mbpp_full' else source end as source, doc_id % 30 = 7 as synthetic from documents), k as (select count(*) as n, count(*) filter (where synthetic) as s, count(*) filter (where coalesce(source, '') = '') as blank, count(*) filter (where source = 'mbpp_full') as good from g)"


@query(f"with {_ALL_ROWS} select 'mbpp_train' as dataset, gate, n, rows from (select 'synthetic' as gate, s as n, n as rows from k where s > 0 union all select 'min_rows', n, n from k where n < 100 union all select 'source_missing', blank, n from k where blank > 0 union all select 'source_wrong', good, n from k where good = 0) q")
def gates_while_writing(spark, sf):
    d = b.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.expr("case when doc_id % 50 = 3 then '' when doc_id % 2 = 0 then 'mbpp_full' else source end").alias("source"), (F.col("doc_id") % 30 == 7).alias("synthetic"), "text")
    folder = scratch.place(spark, "tasks")
    found = gates.written(d, "mbpp_train", lambda df: df.write.json(folder))
    return found.crossJoin(spark.read.text(folder).agg(F.count(F.lit(1)).alias("rows")))


_NOISY = """case ord % 3 when 0 then 'import sys\nsys.stdin.read()\nprint("[" * 1000)\ndef f(x):\n    return x * 2\n' when 1 then 'print("{}")\ndef f(x):\n    return x * 2 + 1\n' else 'print(input().strip(), end=chr(10) * 2000000)' end"""


@query("select item_id as ord, item_id % 3 <> 1 as passed from benchmark")
def pass_noisy(spark, sf):
    items = b.table(spark, sf, "benchmark").select(F.col("item_id").alias("ord"))
    text = F.col("ord").cast("string")
    stdin = F.col("ord") % 3 == 2
    case = F.struct(F.when(stdin, "stdin").otherwise("call").alias("type"), text.alias("input"), F.when(stdin, text).otherwise((F.col("ord") * 2).cast("string")).alias("output"), F.lit("f").alias("fn_name"))
    return execution.passed_tasks(items.select("ord", F.expr(_NOISY).alias("code"), F.array().cast("array<string>").alias("test_cases"), F.array(case).alias("cases"), F.lit("lcb").alias("harness")))
