"""The registered queries: each is a function of (spark, sf_dir) and, beside it, the SQL that the oracle runs.

All run over whole tables and whole texts. Names of columns are the same on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import cases, layers, messages, pytext, scores, tokens
from tracemill.operators import execution, gates, harvest, logs, metrics, pairs, prepare, relational
from tracemill.schemas import SCORE_KEYS
from tracemill.sources import jsonl

from . import bridge as b

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


L = b.sql_layers("completion")
S = b.sql_strip


def _layers(df: DataFrame) -> DataFrame:
    return df.withColumn("l_", layers.split_layers(F.col("completion"))).select("*", "l_.*").drop("l_")


# layers and completions


@query(f"with {b.AUDIT_SQL} select ord, {b.sql_list(L)} from audit")
def layers_split(spark, sf):
    return _layers(b.audit(spark, sf)).select("ord", "thinking", "code", "collaboration")


_EXTRACT = f"""case when len(blocks) > 0 then {S("array_to_string(blocks, chr(10))")} else {S(r"regexp_extract(rest, '(?s)(def [\p{L}\p{N}_]+.*?)(?:\n\n|\z)', 1)")} end"""


@query(rf"with {b.AUDIT_SQL}, r as (select ord, regexp_replace(completion, '(?s)<think>.*?</think>', '', 'g') as rest from audit), x as (select *, regexp_extract_all(rest, '{b.FENCE}', 1) as blocks from r) select ord, {_EXTRACT} as code from x")
def extract_code(spark, sf):
    return b.audit(spark, sf).select("ord", layers.extract_code(F.col("completion")).alias("code"))


@query(f"with {b.AUDIT_SQL} select ord, contains(completion, '</think>') as has_think_end, contains(lower(completion), '```python') as has_python_fence, length(completion) as completion_chars from audit")
def diag_flags(spark, sf):
    return b.audit(spark, sf).select("ord", *(c.alias(k) for k, c in layers.diagnostics(F.col("completion")).items()))


@query("select conv_id, string_agg(coalesce(text, ''), chr(10) order by turn) as completion from conversations group by conv_id")
def completion_text(spark, sf):
    c = b.table(spark, sf, "conversations")
    joined = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    return joined.select("conv_id", layers.message_text(F.col("messages")).alias("completion"))


@query(f"with {b.AUDIT_SQL} select ord, contains(completion, '<think>') or contains(completion, '</think>') as leaks from audit")
def think_guard(spark, sf):
    return b.audit(spark, sf).select("ord", layers.has_think(F.col("completion")).alias("leaks"))


@query(f"with {b.AUDIT_SQL}, x as (select ord, {L['code']} as code from audit) select ord, nullif(regexp_extract(code, '(?m)^\\s*(?:async\\s+)?def\\s+([\\p{{L}}\\p{{N}}_]+)\\s*\\(', 1), '') as name from x")
def function_names(spark, sf):
    return _layers(b.audit(spark, sf)).select("ord", layers.function_name(F.col("code")).alias("name"))


# harvest


@query(f"with {b.AUDIT_SQL} select ord, call, task_id, reward from audit where reward > 0")
def harvest_positive(spark, sf):
    return harvest.positive(b.audit(spark, sf)).select("ord", "call", "task_id", "reward")


@query(f"with {b.TRACES_SQL} select ord, call, max_call, later_cut from pos, cut where call >= later_cut")
def harvest_later_window(spark, sf):
    rows = b.audit(spark, sf)
    return harvest.positive(rows).crossJoin(F.broadcast(harvest.window_start(rows))).where("call >= later_cut").select("ord", "call", "max_call", "later_cut")


_TRACE = "task_id, task_prompt, thinking, code, collaboration, reward, thinking || chr(10) || '[CODE]' || chr(10) || code as work_trace, call as audit_call, first_ord"
_TRACE_COLUMNS = ["task_id", "task_prompt", "thinking", "code", "collaboration", "reward", "work_trace", "audit_call", "first_ord"]


def _traces(spark, sf, **options) -> DataFrame:
    return harvest.harvest(b.audit(spark, sf), harvest.prompts_by_task(b.tasks(spark, sf)), **options)


@query(f"with {b.TRACES_SQL} select {_TRACE} from latest")
def harvest_latest(spark, sf):
    return _traces(spark, sf, min_later=1).select(*_TRACE_COLUMNS)


@query(f"with {b.TRACES_SQL} select {_TRACE} from latest order by call desc, task_id, first_ord limit 10")
def harvest_topk(spark, sf):
    return _traces(spark, sf, min_later=1, max_traces=10).select(*_TRACE_COLUMNS)


_FALLBACK = b.TRACES_SQL + """, every as (select * from (select g.*, row_number() over (partition by task_id, k order by call desc, ord desc) as rn, min(ord) over (partition by task_id, k) as first_ord from good g) z where rn = 1),
 n as (select count(*) as late from latest)"""


@query(f"with {_FALLBACK} select 'later' as source_window, {_TRACE} from latest, n where late >= 1000000 union all select 'all', {_TRACE} from every, n where late < 1000000")
def harvest_fallback(spark, sf):
    return _traces(spark, sf, min_later=1_000_000).select(F.col("window").alias("source_window"), *_TRACE_COLUMNS)


@query(
    f"""with {_FALLBACK}, f as (select late >= 32 as used from n), chosen as (select task_id from latest, f where used union all select task_id from every, f where not used),
 why as (select *, case when coalesce(task_prompt, '') = '' then 'no_prompt' when code = '' or collaboration = '' then 'split' end as skipped from pos, cut, f)
 select (select count(*) from audit) as audit_rows, (select count(*) from pos) as positive_rows, max_call, later_cut, (select count(*) from why where skipped = 'no_prompt' and (not used or call >= later_cut)) as skipped_no_prompt,
 (select count(*) from why where skipped = 'split' and (not used or call >= later_cut)) as skipped_split, (select count(*) from chosen) as kept, (select count(distinct task_id) from chosen) as unique_tasks, used as used_later_window from cut, f"""
)
def harvest_stats(spark, sf):
    return harvest.stats(b.audit(spark, sf), harvest.prompts_by_task(b.tasks(spark, sf)))


@query(f"with {b.AUDIT_SQL}, {b.PROMPTS_SQL} select task_id, count(*) as misses from audit where task_id not in (select task_id from prompts) group by task_id")
def prompt_join_misses(spark, sf):
    return b.audit(spark, sf).join(harvest.prompts_by_task(b.tasks(spark, sf)), "task_id", "left_anti").groupBy("task_id").agg(F.count(F.lit(1)).alias("misses"))


@query("select source, max_by(lang, doc_id) as last_lang from documents where source is not null group by source")
def last_prompt_wins(spark, sf):
    return relational.last_value_per_key(b.table(spark, sf, "documents"), "source", "lang", "doc_id").withColumnRenamed("lang", "last_lang")


# preparation and isolation

_NUM = "try_cast(nullif(regexp_extract(task_id, '(\\d+)$', 1), '') as bigint)"


@query(f"with {b.SPLITS_SQL} select ord, {_NUM} as num_id from splits")
def numeric_ids(spark, sf):
    return b.splits(spark, sf).select("ord", pytext.numeric_id(F.col("task_id")).alias("num_id"))


def _split_tables(spark, sf) -> dict[str, DataFrame]:
    rows = b.splits(spark, sf)
    return {s: rows.where(F.col("split") == s).drop("split") for s in ("train", "test", "validation", "prompt", "other")}


_ORD = "case split when 'train' then 0 when 'test' then 1 when 'validation' then 2 else 3 end"
_TRAIN = f"""{b.SPLITS_SQL}, {b.EVAL_IDS_SQL}, excl as (select distinct {_NUM} as num_id from eval_ids),
 numbered as (select *, {_NUM} as num_id, {_ORD} as split_ord from splits where split <> 'other'),
 firsts as (select * from (select *, row_number() over (partition by num_id order by split_ord, ord) as rn from numbered where num_id not in (select num_id from excl)) z where rn = 1)"""


@query(f"with {_TRAIN} select 'mbpp_' || cast(num_id as varchar) as task_id, coalesce(nullif(text, ''), nullif(prompt, ''), '') as prompt, code as code_solution, split_ord, ord from firsts")
def splits_union_first_wins(spark, sf):
    rows = jsonl.union_splits(_split_tables(spark, sf))
    excluded = gates.numbers(b.eval_ids(spark, sf)).select("num_id").distinct()
    return prepare.train_tasks(rows, excluded).select("task_id", "prompt", "code_solution", "split_ord", "ord")


@query(f"with {_TRAIN} select ord, num_id from numbered where num_id not in (select num_id from excl)")
def train_minus_eval(spark, sf):
    rows = jsonl.union_splits(_split_tables(spark, sf)).withColumn("num_id", pytext.numeric_id(F.col("task_id")))
    return rows.join(gates.numbers(b.eval_ids(spark, sf)).select("num_id").distinct(), "num_id", "left_anti").select("ord", "num_id")


@query(f"with {_TRAIN} select distinct num_id from numbered where num_id in (select num_id from excl)")
def train_eval_overlap(spark, sf):
    return gates.overlap(jsonl.union_splits(_split_tables(spark, sf)), b.eval_ids(spark, sf))


@query(f"with {b.TRACES_SQL} select task_id, first_ord from latest where task_id not in (select 'mbpp_' || cast(item_id as varchar) from benchmark where item_id % 2 = 0)")
def resume_remaining(spark, sf):
    done = b.table(spark, sf, "benchmark").where("item_id % 2 = 0").select(F.expr("'mbpp_' || cast(item_id as string)").alias("task_id"))
    return relational.without_ids(_traces(spark, sf, min_later=1), done, "task_id").select("task_id", "first_ord")


_CASE_SQL = f"""{b.CASES_SQL}, j as (select item_id, try_cast(raw as json) as v from raw_cases),
 listed as (select item_id, unnest(cast(json_extract(v, '$[*]') as json[])) as x, generate_subscripts(cast(json_extract(v, '$[*]') as json[]), 1) as pos from j where json_type(v) = 'ARRAY'
   union all select item_id, v, 1 from j where json_type(v) = 'OBJECT' and (v->'inputs') is null),
 plain as (select item_id, pos, case when lower(coalesce(nullif(x->>'testtype', ''), nullif(x->>'type', ''), case when coalesce(x->>'fn_name', '') <> '' then 'call' else 'stdin' end)) in ('functional', 'call', 'call_based', 'function') then 'call' else 'stdin' end as type,
   coalesce(x->>'input', x->>'inputs', '') as input, coalesce(x->>'output', x->>'outputs', '') as output, nullif(x->>'fn_name', '') as fn_name from listed where json_type(x) = 'OBJECT'),
 zipped as (select item_id, generate_series as pos, 'call' as type, json_extract_string(v, '$.inputs[' || cast(generate_series - 1 as varchar) || ']') as input, json_extract_string(v, '$.outputs[' || cast(generate_series - 1 as varchar) || ']') as output, v->>'fn_name' as fn_name
   from j, generate_series(1, 2) where (v->'inputs') is not null and json_type(v) = 'OBJECT'),
 cases as (select item_id, row_number() over (partition by item_id order by pos) as place, type, input, output, fn_name from (select * from plain union all select * from zipped) u)"""


@query(f"with {_CASE_SQL} select * from cases")
def lcb_cases(spark, sf):
    rows = b.raw_cases(spark, sf).select("item_id", F.posexplode(cases.public_cases(F.col("raw"))).alias("p", "c"))
    return rows.select("item_id", (F.col("p") + 1).cast("bigint").alias("place"), "c.type", "c.input", "c.output", "c.fn_name")


@query(f"with {_CASE_SQL} select count(*) as n, count(*) filter (where item_id in (select item_id from cases)) as ready from raw_cases")
def case_ready_fraction(spark, sf):
    rows = b.raw_cases(spark, sf).withColumn("c", cases.public_cases(F.col("raw")))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("c") > 0).alias("ready"))


@query("select item_id, case when item_id % 3 = 0 then 'h' when item_id % 3 = 1 then 'own' end as fn_name, case when item_id % 2 = 0 then 'stdin' else 'call' end as type, cast(item_id as varchar) as input, 'x' as output from benchmark")
def wrapped_cases(spark, sf):
    raw = F.expr("""case item_id % 3 when 0 then '{"fn_name": "h", "mode": "' || case when item_id % 2 = 0 then 'stdin' else 'call' end || '", "cases": [{"input": "' || item_id || '", "output": "x"}]}'
        when 1 then '{"cases": [{"fn_name": "own", "type": "' || case when item_id % 2 = 0 then 'stdin' else 'call' end || '", "input": "' || item_id || '", "output": "x"}]}'
        else '[{"type": "' || case when item_id % 2 = 0 then 'stdin' else 'call' end || '", "input": "' || item_id || '", "output": "x"}]' end""")
    rows = b.table(spark, sf, "benchmark").select("item_id", F.explode(cases.task_cases(raw)).alias("c"))
    return rows.select("item_id", "c.fn_name", "c.type", "c.input", "c.output")


@query("select item_id, 'lcb_' || cast(item_id as varchar) as task_id, text as prompt, 1 as n_cases, 'solve_it' as fn_name from benchmark where item_id % 4 in (0, 1) and coalesce(text, '') <> ''")
def case_tasks(spark, sf):
    level = F.expr("case item_id % 4 when 0 then 'Easy' when 1 then '' when 2 then 'hard' else 'medium' end")
    rows = b.table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question_content"), level.alias("difficulty"), F.lit('[{"testtype": "functional", "input": "1", "output": "2"}]').alias("public_test_cases"), F.lit('{"func_name": "solve_it"}').alias("metadata"))
    made = prepare.case_tasks(rows, "local")
    return made.select(F.substring_index("task_id", "_", -1).cast("bigint").alias("item_id"), "task_id", "prompt", F.size("lcb_tests").alias("n_cases"), F.get("lcb_tests", 0)["fn_name"].alias("fn_name"))


_ASSERTS = "'  assert f(' || cast(doc_id as {T}) || ') == 1' || chr(10) || coalesce(source, '') || chr(10) || 'assert(x)' || chr(10) || 'assert g()'"


@query("select doc_id, unnest(['assert f(' || cast(doc_id as varchar) || ') == 1', 'assert g()']) as test, unnest([1, 2]) as place from documents")
def assert_lines(spark, sf):
    rows = b.table(spark, sf, "documents").select("doc_id", F.posexplode(prepare.assert_lines(F.expr(_ASSERTS.replace("{T}", "string")))).alias("p", "test"))
    return rows.select("doc_id", "test", (F.col("p") + 1).alias("place"))


@query("select count(*) as n, count(*) filter (where doc_id % 3 = 0) as executable from documents")
def assert_task_fraction(spark, sf):
    tests = F.expr("case doc_id % 3 when 0 then array(' assert a', 'assert b') when 1 then array('assert a', '{\"x\": 1}') else cast(array() as array<string>) end")
    return b.table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(metrics.executable(tests)).alias("executable"))


# pairs


@query(f"with {b.PAIRS_SQL} select ord, task_id, coalesce(task_prompt, '') as task_prompt, coalesce(rl_collaboration, '') as rl_collaboration, regen_collaboration, reward from pairs")
def raw_pairs(spark, sf):
    rows = b.pairs(spark, sf).withColumnRenamed("rl_collaboration", "collaboration").withColumns({"full_output": F.lit(None).cast("string"), "work_trace": F.lit(None).cast("string")})
    return pairs.raw_pairs(rows, F.col("regen_collaboration")).select("ord", "task_id", "task_prompt", "rl_collaboration", "regen_collaboration", "reward")


_STRUCTURAL = f"{S('regen_collaboration')} <> '' and {S('rl_collaboration')} <> '' and {S('code')} <> '' and {S('regen_collaboration')} <> {S('rl_collaboration')} and length({S('regen_collaboration')}) <= 4000 and length({S('rl_collaboration')}) <= 4000"


@query(f"with {b.PAIRS_SQL} select ord, task_id from pairs where {_STRUCTURAL}")
def pairs_structural(spark, sf):
    return b.pairs(spark, sf).where(pairs.structural()).select("ord", "task_id")


@query(f"with {b.PAIRS_SQL} select task_id, task_prompt, regen_collaboration as chosen, 7.5::double as regen_overall, 5.0::double as rl_overall, 2.5::double as score_gap from pairs where {S('regen_collaboration')} <> {S('rl_collaboration')}")
def pairs_mock_judged(spark, sf):
    return pairs.filter_mock(b.pairs(spark, sf)).select("metadata.task_id", "metadata.task_prompt", "chosen", F.col("metadata.regen_score.overall").alias("regen_overall"), F.col("metadata.rl_score.overall").alias("rl_overall"), "metadata.score_gap")


_HEAD, _REST = messages.REGEN_USER.split("{task_prompt}")
_MID, _END = _REST.split("{thinking}")
_CODE_LEAD, _TAIL = _END.split("{code}")
_q = lambda s: "'" + s.replace("'", "''") + "'"
_USER = f"{_q(_HEAD)} || task_prompt || {_q(_MID)} || thinking || {_q(_CODE_LEAD)} || code || {_q(_TAIL)}"


@query(f"with {b.PAIRS_SQL} select task_id, regen_collaboration as chosen, rl_collaboration as rejected, {_q(messages.REGEN_SYSTEM)} as system_text, {_USER} as user_text, '{messages.PROMPT_FORMAT}' as prompt_format, reward from pairs where {_STRUCTURAL}")
def preference_records(spark, sf):
    made = pairs.filter_structural(b.pairs(spark, sf))
    return made.select("metadata.task_id", "chosen", "rejected", F.get("messages", 0)["content"].alias("system_text"), F.get("messages", 1)["content"].alias("user_text"), "metadata.prompt_format", "metadata.reward")


@query(f"with {b.PAIRS_SQL} select 'system' as first_role, 2 as n_messages, {_USER} as user_text, regen_collaboration as chosen, rl_collaboration as rejected from pairs where {_STRUCTURAL}")
def preference_rendered(spark, sf):
    out = pairs.rendered(pairs.filter_structural(b.pairs(spark, sf)))
    return out.select(F.get("messages", 0)["role"].alias("first_role"), F.size("messages").alias("n_messages"), F.get("messages", 1)["content"].alias("user_text"), "chosen", "rejected")


_EXAMPLE = "case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then text else '  assert f(1) == 2 ' end"


@query(f"with x as (select doc_id, regexp_replace(text, '{b.WS}+$', '') as p, {S(_EXAMPLE)} as e from documents) select doc_id, p || case when e <> '' and not contains(p, e) then {_q(messages.EXAMPLE_LEAD)} || e else '' end || {_q(messages.CODING_SUFFIX)} as content from x")
def coding_messages(spark, sf):
    tests = F.array(F.expr(_EXAMPLE))
    return b.table(spark, sf, "documents").select("doc_id", F.get(messages.coding(F.col("text"), tests), 0)["content"].alias("content"))


_J = messages.JUDGE_USER.split("{task_prompt}")
_J2 = _J[1].split("{collaboration_text}")


@query(f"with {b.PAIRS_SQL} select ord, {_q(_J[0])} || task_prompt || {_q(_J2[0])} || rl_collaboration || {_q(_J2[1])} as content from pairs")
def judge_messages(spark, sf):
    return b.pairs(spark, sf).select("ord", F.get(messages.judging(F.col("task_prompt"), F.col("rl_collaboration")), 0)["content"].alias("content"))


def _mock_sql(tag: str) -> str:
    thought, note = messages.MOCK[tag]
    t = _q(thought) + (" || substr(text, 1, 100)" if tag == "base" else "")
    n = _q(note) + (" || substr(text, 1, 80)" if tag == "rl" else "")
    return f"'<think>' || chr(10) || {t} || chr(10) || '</think>' || chr(10) || chr(10) || {n} || chr(10) || chr(10) || '```python' || chr(10) || {_q(messages.MOCK_CODE)} || chr(10) || '```' || chr(10)"


@query(f"with {b.EVAL_SQL} select doc_id, case model_tag when 'rl' then {_mock_sql('rl')} when 'final' then {_mock_sql('final')} else {_mock_sql('base')} end as output from evals")
def mock_generations(spark, sf):
    return b.evals(spark, sf).select("doc_id", messages.mock_generation(F.col("model_tag"), F.col("text"), F.lit(None).cast("string")).alias("output"))


@query(f"with {b.PAIRS_SQL} select ord, {_q(messages.REGEN_MARK)} || coalesce(nullif({S('rl_collaboration')}, ''), {_q(messages.REGEN_EMPTY)}) as regen from pairs")
def mock_regenerations(spark, sf):
    return b.pairs(spark, sf).select("ord", messages.mock_regeneration(F.col("rl_collaboration")).alias("regen"))


# scores

_CAND = rf"""{b.JUDGE_SQL}, t as (select doc_id, {S('answer')} as body from judge),
 r as (select *, case when regexp_matches(body, '(?is)```(?:json)?{b.WS}*\n?(.*?)```') then {S(rf"regexp_extract(body, '(?is)```(?:json)?{b.WS}*\n?(.*?)```', 1)")} else body end as raw from t),
 c as (select *, try_cast(regexp_replace(coalesce(nullif(regexp_extract(raw, '(?s)\{{[^{{}}]*\}}'), ''), raw), ',\s*\}}', '}}') as json) as v from r),
 k as (select doc_id, body, v, json_type(v) = 'OBJECT' as whole, {', '.join(rf"nullif(regexp_extract(body, '(?i)[\x22'']?{k}[\x22'']?\s*[:=]\s*([0-9]+(?:\.[0-9]+)?)', 1), '') as t_{k}" for k in SCORE_KEYS)} from c),
 s as (select doc_id, body, v, coalesce(whole, false) as whole, {', '.join(f"try_cast(case when coalesce(whole, false) then v->>'{k}' else t_{k} end as double) as {k}" for k in SCORE_KEYS)}, case when coalesce(whole, false) then list_contains(json_keys(v), 'overall') else t_overall is not null end as has_overall from k),
 f as (select *, clarity is not null and conciseness is not null and informativeness is not null and naturalness is not null as full_ from s)"""
_MEAN = "(clarity + conciseness + informativeness + naturalness) / 4"


@query(f"with {_CAND} select doc_id, full_ and not (has_overall and overall is null) as ok, case when full_ and not (has_overall and overall is null) then clarity end as clarity, case when full_ and not (has_overall and overall is null) then case when has_overall then overall else {_MEAN} end end as overall from f")
def judge_scores_strict(spark, sf):
    got = b.judge(spark, sf).withColumn("j", scores.judged(F.col("answer")))
    return got.select("doc_id", "j.ok", "j.scores.clarity", "j.scores.overall")


_LENIENT = f"select doc_id, {', '.join(f'coalesce({k}, 0.0::double) as {k}' for k in SCORE_KEYS[:-1])}, case when not has_overall and (clarity is not null or conciseness is not null or informativeness is not null or naturalness is not null) then (coalesce(clarity, 0) + coalesce(conciseness, 0) + coalesce(informativeness, 0) + coalesce(naturalness, 0)) / 4 else coalesce(overall, 0.0::double) end as overall from f"


@query(f"with {_CAND} {_LENIENT}")
def judge_scores_lenient(spark, sf):
    return b.judge(spark, sf).select("doc_id", scores.lenient_answer(F.col("answer")).alias("s")).select("doc_id", "s.*")


@query(f"with {_CAND} select count(*) as n, {', '.join(f'coalesce(avg({k}), 0.0::double) as {k}' for k in SCORE_KEYS)} from ({_LENIENT}) q")
def readability_means(spark, sf):
    rows = b.judge(spark, sf).withColumn("scores", scores.lenient_answer(F.col("answer")))
    return metrics.readability_means(rows).crossJoin(rows.agg(F.count(F.lit(1)).alias("n"))).select("n", *SCORE_KEYS)


@query(f"with {_CAND}, g as (select doc_id, case when has_overall then overall else {_MEAN} end as overall from f where full_ and not (has_overall and overall is null)) select a.doc_id from g a join labels l using (doc_id) where a.overall >= 6.0 and a.overall > 4.0 + l.toxic * 2 and a.overall - (4.0 + l.toxic * 2) >= 0.5")
def pairs_judged(spark, sf):
    rows = b.judge(spark, sf).join(b.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").withColumn("j", scores.judged(F.col("answer")))
    return rows.where(F.col("j.ok") & scores.keeps_pair(F.col("j.scores.overall"), F.lit(4.0) + F.col("toxic") * 2)).select("doc_id")


_TAGGED = f"{b.EVAL_SQL}, m as (select model_tag, avg(quality::double) as coding, avg(length(text)::double) / 1000 as readability from evals group by model_tag), w as (select max(case when model_tag = 'base' then coding end) as bc, max(case when model_tag = 'rl' then coding end) as rc, max(case when model_tag = 'final' then coding end) as fc, max(case when model_tag = 'base' then readability end) as br, max(case when model_tag = 'rl' then readability end) as rr, max(case when model_tag = 'final' then readability end) as fr from m)"


def _tag_metrics(spark, sf) -> DataFrame:
    return b.evals(spark, sf).groupBy("model_tag").agg(F.avg(F.col("quality").cast("double")).alias("coding"), (F.avg(F.length("text").cast("double")) / 1000).alias("readability"))


def _checks(spark, sf) -> DataFrame:
    wide = metrics.by_tag(_tag_metrics(spark, sf), ["coding", "readability"])
    tags = ("base", "rl", "final")
    return wide.select(scores.hypotheses({t: F.col(f"{t}_coding") for t in tags}, {t: F.col(f"{t}_readability") for t in tags}).alias("h"))


_HYPOTHESES = "select 'H1_rl_improves_coding' as id, rc - bc >= 0.05::double as verified, bc as base, rc as rl, null::double as final from w union all select 'H2_rl_hurts_readability', rr < br, br, rr, null from w union all select 'H3_dpo_recovers_readability', fr >= br, br, rr, fr from w union all select 'H4_dpo_preserves_coding', abs(fc - rc) <= 0.02::double, null, rc, fc from w"


@query(f"with {_TAGGED} {_HYPOTHESES}")
def hypotheses(spark, sf):
    return _checks(spark, sf).select(F.inline("h")).select("id", "verified", "base", "rl", "final")


@query(f"with {_TAGGED}, h as ({_HYPOTHESES}), v as (select bool_or(verified) filter (where id like 'H3%') as h3, bool_or(verified) filter (where id like 'H4%') as h4 from h) select case when h3 and h4 then 'kept readability and coding' when h3 then 'kept readability, not coding' when h4 then 'kept coding, not readability' else 'kept neither' end as verdict from v")
def verdict(spark, sf):
    return _checks(spark, sf).select(scores.verdict(F.get("h", 2)["verified"], F.get("h", 3)["verified"]).alias("verdict"))


@query(f"with {_TAGGED} select 3 as cycle, bc as base_coding, br as base_readability, rc as rl_coding, fr as final_readability, 4 as n_hypotheses from w")
def eval_report(spark, sf):
    rep = metrics.report(_tag_metrics(spark, sf), ["coding", "readability"], cycle=3)
    at = lambda t, n: F.col("models")[t][n]
    return rep.select("cycle", at("base", "coding").alias("base_coding"), at("base", "readability").alias("base_readability"), at("rl", "coding").alias("rl_coding"), at("final", "readability").alias("final_readability"), F.size("hypothesis_results").alias("n_hypotheses"))


# evaluation metrics


@query(f"with {b.EVAL_SQL} select model_tag, count(*) as n, sum(quality) as passed, avg(quality::double) as pass_at_1 from evals group by model_tag")
def pass_at_1_by_model(spark, sf):
    return b.evals(spark, sf).groupBy("model_tag").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("passed"), metrics.mean(F.col("quality").cast("double")).alias("pass_at_1"))


_GRAMS = """t as (select ord, {th} as thinking, {co} as collaboration from audit),
 w as (select ord, regexp_extract_all(lower(thinking), '[\\p{{L}}\\p{{N}}_]+') as tw, regexp_extract_all(lower(collaboration), '[\\p{{L}}\\p{{N}}_]+') as cw from t),
 tg as (select ord, array_to_string(tw[i:i+{m}], ' ') as g from (select ord, tw, unnest(range(1, greatest(len(tw) - {m}, 0) + 1)) as i from w) z),
 cg as (select distinct ord, array_to_string(cw[i:i+{m}], ' ') as g from (select ord, cw, unnest(range(1, greatest(len(cw) - {m}, 0) + 1)) as i from w) z),
 s as (select tg.ord, count(*) as grams, count(cg.g) as leaked from tg left join cg on tg.ord = cg.ord and tg.g = cg.g group by tg.ord)""".format(th="@TH@", co="@CO@", m="@M@")


def _leak_sql(n: int) -> str:
    body = _GRAMS.replace("@TH@", L["thinking"]).replace("@CO@", L["collaboration"]).replace("@M@", str(n - 1))
    return f"with {b.AUDIT_SQL}, {body} select a.ord, coalesce(leaked, 0) as leaked, coalesce(grams, 0) as grams from audit a left join s using (ord)"


@query(_leak_sql(3))
def leak_rate(spark, sf):
    return metrics.leak_rates(_layers(b.audit(spark, sf)), ["ord"]).select("ord", "leaked", "grams")


@query(_leak_sql(1))
def leak_rate_words(spark, sf):
    return metrics.leak_rates(_layers(b.audit(spark, sf)), ["ord"], n=1).select("ord", "leaked", "grams")


@query(f"with {b.AUDIT_SQL} select count(*) as n, sum(len(list_filter(regexp_split_to_array({L['collaboration']}, '{b.WS}+'), lambda x: x <> ''))) as words from audit")
def collab_length(spark, sf):
    return _layers(b.audit(spark, sf)).agg(F.count(F.lit(1)).alias("n"), F.sum(metrics.whitespace_length(F.col("collaboration"))).alias("words"))


@query(f"with {b.AUDIT_SQL} select count(*) as n, sum(length({L['code']})) as chars from audit")
def code_length(spark, sf):
    return _layers(b.audit(spark, sf)).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("code")).alias("chars"))


@query()
def syntax_rate(spark, sf):
    rows = _layers(b.audit(spark, sf))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(~metrics.parses(F.col("code"))).alias("errors"))


_SUMMARY = f"with {b.AUDIT_SQL} select count(*) as rows, count(*) filter (where reward > 0) as reward_gt0, round(avg(reward), 6) as reward_mean, count(distinct task_id) as task_ids, min(call) as call_min, max(call) as call_max, count(*) filter (where contains(completion, '</think>')) as has_think_end, count(*) filter (where contains(lower(completion), '```python')) as has_python_fence from audit"


def _flagged(spark, sf) -> DataFrame:
    rows = b.audit(spark, sf)
    return rows.withColumns(layers.diagnostics(F.col("completion")))


@query(_SUMMARY)
def audit_summary(spark, sf):
    one = metrics.audit_summary(_flagged(spark, sf))
    return one.select("rows", "reward_gt0", F.round("reward_mean", 6).alias("reward_mean"), "task_ids", "call_min", "call_max", "has_think_end", "has_python_fence")


@query(f"with {b.AUDIT_SQL}, h as (select cast(round(reward * 100) as bigint) as cents, count(*) as n, min(ord) as f from audit group by 1) select row_number() over (order by n desc, f) as place, cents, n from h qualify place <= 8")
def reward_histogram_top8(spark, sf):
    return metrics.histogram(b.audit(spark, sf)).select("place", F.round(F.col("reward") * 100).cast("bigint").alias("cents"), "n")


# logs

_MARK = r"regexp_extract_all(value, '(\d+)/300\s+\[([^<]+)<([^,]+),\s+([0-9.]+)s/it\]', {k})"


@query(rf"""with {b.LOG_SQL}, m as (select place, unnest({_MARK.format(k=1)}) as step, unnest({_MARK.format(k=2)}) as elapsed, unnest({_MARK.format(k=3)}) as eta, unnest({_MARK.format(k=4)}) as sec from log)
 select step::bigint as step, elapsed, eta, sec::double as sec_per_it from m qualify row_number() over (partition by step order by place desc) = 1""")
def progress_latest(spark, sf):
    return logs.latest_progress(b.log(spark, sf))


_EVENTS = rf"{b.LOG_SQL}, d as (select place, unnest(regexp_extract_all(value, '\{{[^{{}}]*''loss''[^{{}}]*\}}')) as raw from log), e as (select place, try_cast(replace(raw, '''', '\"') as json) as v from d)"
_EVENT = "select place, (v->>'loss')::double as loss, (v->>'reward')::double as reward, (v->>'epoch')::double as epoch from e where (v->'epoch') is not null"


@query(f"with {_EVENTS} {_EVENT}".replace('\\"', '"'))
def metric_events(spark, sf):
    return logs.metric_events(b.log(spark, sf)).select("place", "loss", "reward", "epoch")


@query(f"with {_EVENTS}, x as ({_EVENT}) select place, epoch, reward from x where not exists (select 1 from x y where y.place % 5 = 0 and y.epoch = x.epoch and y.reward = x.reward)".replace('\\"', '"'))
def new_log_events(spark, sf):
    events = logs.metric_key(logs.metric_events(b.log(spark, sf)))
    return logs.unseen(events, events.where("place % 5 = 0"), ["epoch_key", "reward"]).select("place", "epoch", "reward")


@query(f"with {b.LOG_SQL} select place, value from log where contains(value, 'note:') or contains(value, '/300')")
def log_grep(spark, sf):
    return logs.matching_lines(b.log(spark, sf), "note:", "/300")


@query(f"with {b.LOG_SQL} select place as line_no, value from log order by place desc limit 12")
def log_tail(spark, sf):
    return logs.tail(b.log(spark, sf).withColumnRenamed("place", "line_no"))


# shards, batches, order


@query("select doc_id, ntile(7) over (order by doc_id) - 1 as shard from documents")
def shards_ntile(spark, sf):
    return relational.shard_of(b.table(spark, sf, "documents").select("doc_id"), 7, "doc_id").select("doc_id", "shard")


@query("select doc_id, (row_number() over (order by doc_id) - 1) // 20 as batch from documents")
def minibatches(spark, sf):
    ranked = relational.rank(b.table(spark, sf, "documents").select("doc_id"), "doc_id")
    return ranked.select("doc_id", relational.batch_of(F.col("rank") - 1, 20).alias("batch"))


@query("select doc_id, source from documents order by doc_id limit 50")
def first_rows(spark, sf):
    return relational.head(b.table(spark, sf, "documents").select("doc_id", "source"), 50, ["doc_id"])


@query("select item_id * 3 + g as ord, item_id as prompt_ord, text as prompt from benchmark, generate_series(0, 2) as s(g)")
def expand_generations(spark, sf):
    items = b.table(spark, sf, "benchmark")
    prompts = items.select(F.col("item_id").alias("ord"), F.col("text").alias("prompt"))
    completions = items.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda g: F.col("item_id") * 3 + g)).alias("ord"))
    return relational.fan_out(prompts, completions, 3).select("ord", "prompt_ord", "prompt")


@query("select count(*) as n, list_sort(list(distinct source) filter (where coalesce(source, '') <> '')) as sources, count(*) filter (where doc_id % 10 = 0) as synthetic_rows, (select list(t order by doc_id) from (select doc_id, 'mbpp_' || cast(doc_id as varchar) as t from documents order by doc_id limit 5) q) as sample_task_ids from documents".replace("list_sort(list(distinct source) filter (where coalesce(source, '') <> '')) as sources", "array_to_string(list_sort(list(distinct source) filter (where coalesce(source, '') <> '')), ',') as sources").replace("list(t order by doc_id)", "string_agg(t, ',' order by doc_id)"))
def dataset_profile(spark, sf):
    d = b.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.expr("'mbpp_' || cast(doc_id as string)").alias("task_id"), "source", (F.col("doc_id") % 10 == 0).alias("synthetic"))
    p = jsonl.profile(d)
    return p.select("n", F.array_join("sources", ",").alias("sources"), "synthetic_rows", F.array_join("sample_task_ids", ",").alias("sample_task_ids"))


# gates

_GATED = "g as (select doc_id as ord, case when doc_id % 50 = 3 then '' when doc_id % 2 = 0 then 'mbpp_full' else source end as source, doc_id % 30 = 7 as synthetic from documents), h as (select * from g order by ord limit 20), k as (select (select count(*) from g) as n, count(*) filter (where synthetic) as s, count(*) filter (where coalesce(source, '') = '') as blank, count(*) filter (where source = 'mbpp_full') as good from h)"


@query(f"with {_GATED} select 'mbpp_train' as dataset, gate, n from (select 'synthetic' as gate, s as n from k where s > 0 union all select 'min_rows', n from k where n < 100 union all select 'source_missing', blank from k where blank > 0 union all select 'source_wrong', good from k where good = 0) q")
def dataset_gates(spark, sf):
    d = b.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.expr("case when doc_id % 50 = 3 then '' when doc_id % 2 = 0 then 'mbpp_full' else source end").alias("source"), (F.col("doc_id") % 30 == 7).alias("synthetic"))
    return gates.dataset_violations(d, "mbpp_train")


@query(f"with {_TRAIN}, o as (select count(distinct num_id) as n from numbered where num_id in (select num_id from excl)) select 'train/eval' as dataset, 'contamination' as gate, n from o where n > 0")
def disjoint_gate(spark, sf):
    return gates.disjoint_violations(jsonl.union_splits(_split_tables(spark, sf)), b.eval_ids(spark, sf))


# tokens

_CLOSE = """ends as (select doc_id, ids, unnest(range(1, len(ids) + 1)) as i from token_rows), marks as (select doc_id, i, ids[i] as t, max(case when ids[i] = 7 then i end) over (partition by doc_id order by i) as last7 from ends),
 fences as (select doc_id, i, row_number() over (partition by doc_id, last7 order by i) as nth from marks where t = 8 and last7 is not null), closes as (select doc_id, min(i) as c from fences where nth = 2 group by doc_id)"""


@query(f"with {b.TOKENS_SQL}, {_CLOSE} select t.doc_id, len(t.ids) as n, coalesce(least(c, len(t.ids)), len(t.ids)) as kept from token_rows t left join closes using (doc_id)")
def fence_mask(spark, sf):
    rows = b.token_rows(spark, sf)
    mask = tokens.fence_mask(F.col("ids"), F.transform("ids", lambda t: F.lit(1)), 7, 8)
    return rows.select("doc_id", F.size("ids").alias("n"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("kept"))


@query(f"with {b.TOKENS_SQL}, {_CLOSE}, l7 as (select doc_id, max(last7) as z from marks group by doc_id), f as (select m.doc_id, count(*) filter (where t = 8 and last7 = z) as k from marks m join l7 using (doc_id) group by m.doc_id) select t.doc_id, coalesce(k, 0) >= 2 as done from token_rows t left join f using (doc_id)")
def fence_stop(spark, sf):
    rows = b.token_rows(spark, sf)
    return rows.select("doc_id", tokens.fence_done(F.col("ids"), 7, 8).alias("done"))


@query(f"with {b.TOKENS_SQL} select doc_id, len(ids) = 30 and not list_contains(ids, 7) as reached, len(ids) - case when len(ids) > 20 and ids[21] = 7 then 1 else 0 end as kept from token_rows")
def loss_mask(spark, sf):
    rows = b.token_rows(spark, sf)
    mask = tokens.forced_mask(F.col("ids"), F.transform("ids", lambda t: F.lit(1)), 20, 7)
    return rows.select("doc_id", tokens.budget_reached(F.col("ids"), 30, 7).alias("reached"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("kept"))


@query(f"with {b.TOKENS_SQL}, x as (select doc_id, unnest(ids) as t from token_rows), y as (select doc_id, t, case when t % 3 = 0 then 0 else 1 end as m, case when t % 3 = 0 then 0.0::double else (t % 4)::double / 4 - t::double / 8 end as r from x) select doc_id, round(sum(-(0.5::double - 0.04::double * (exp(r) - r - 1)) * m) / greatest(1, sum(m)), 6) as loss from y group by doc_id")
def grpo_objective(spark, sf):
    rows = b.token_rows(spark, sf)
    each = lambda f: F.transform("ids", f)
    loss = tokens.masked_loss(each(lambda t: t.cast("double") / 8), each(lambda t: (t % 4).cast("double") / 4), F.lit(0.5), each(lambda t: F.when(t % 3 == 0, 0).otherwise(1)), 0.04)
    return rows.select("doc_id", F.round(loss, 6).alias("loss"))


@query("with c as (select cast(date_trunc('day', ts) as date) as day, count(*) as n, count(*) filter (where value > 50) as good from events group by 1) select cast(day as varchar) as day, n, good, good - lag(good) over (order by day) as gain from c")
def cycle_deltas(spark, sf):
    e = b.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("good"))
    return e.select(F.col("day").cast("string").alias("day"), "n", "good", (F.col("good") - F.lag("good").over(Window.orderBy("day"))).alias("gain"))


@query(f"with {b.AUDIT_SQL} select ord, sha1({L['code']}) as content_key from audit")
def content_keys(spark, sf):
    return _layers(b.audit(spark, sf)).select("ord", layers.content_key(F.col("code")).alias("content_key"))


_LINE_END = "\\r\\n|[\\n\\r\\x{0b}\\x{0c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]"


@query(f"select doc_id, rtrim(array_to_string(list_transform(regexp_split_to_array(text, '{_LINE_END}'), lambda l: regexp_replace(l, '{b.WS}+$', '')), chr(10)), chr(10)) as out from documents")
def stdout_normal(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", pytext.normal_stdout(F.col("text")).alias("out"))


# programs (fixtures of our own only)

_SOLUTIONS = ("def f(x):\n    return x + 1\n", "def f(x):\n    return x\n", "def f(x):\n    return x +\n", "")


def _programs(spark, sf) -> DataFrame:
    items = b.table(spark, sf, "benchmark").select(F.col("item_id").alias("ord"))
    code = F.get(F.array(*map(F.lit, _SOLUTIONS)), (F.col("ord") % 4).cast("int"))
    tests = F.expr("array('assert f(1) == 2', 'assert f(0) == 0', 'assert callable(f)')")
    return items.withColumn("code", code).withColumn("test_cases", tests)


@query("select item_id as ord, case item_id % 4 when 0 then 2.0::double / 3.0::double when 1 then 2.0::double / 3.0::double else 0.0::double end as reward from benchmark")
def reward_exec(spark, sf):
    return execution.rewards(_programs(spark, sf))


@query("select item_id as ord, item_id % 4 = 0 as passed from benchmark")
def pass_exec(spark, sf):
    case = F.array(F.struct(F.lit("call").alias("type"), F.lit("1").alias("input"), F.lit("2").alias("output"), F.lit("f").alias("fn_name")))
    rows = _programs(spark, sf).withColumn("cases", case).withColumn("harness", F.lit("lcb"))
    return execution.passed_tasks(rows)
