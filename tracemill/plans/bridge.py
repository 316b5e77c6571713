"""Views of the driver's tables in the shape of rollout data, in DataFrame code and as SQL text for the oracle.

The driver's tables hold no completions, so these views derive them: turns of a
conversation become reward log rows with the layers in several forms, benchmark items become
prompts, and so on. Each view is defined twice, once for each engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(expr: str):
    return F.expr(expr)


TURNS_SQL = """turns as (select u.conv_id, u.turn, u.conv_id*1000+u.turn as ord, u.text as ask, a.text as reply
 from conversations u join conversations a on a.conv_id=u.conv_id and a.turn=u.turn+1 where u.role='user' and a.role='assistant')"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("text").alias("ask"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return u.join(a, ["conv_id", "turn"])


_CODE = "'def f' || cast(conv_id % 25 as {T}) || '():' || chr(10) || '    return ' || cast(turn % 3 as {T}) || chr(10)"
_COMPLETION = """case (conv_id + turn) % 8
 when 0 then '<think>' || ask || '</think>' || reply
 when 1 then ask || '</think>' || chr(10) || reply || chr(10) || '```python' || chr(10) || code || '```'
 when 2 then '<think>' || ask || chr(10) || reply || chr(10) || '```' || chr(10) || code || '```'
 when 3 then '<think>' || ask || '</think>' || reply || chr(10) || chr(10) || code || chr(10) || chr(10) || 'Done.'
 else '<think>' || chr(10) || ask || chr(10) || '</think>' || chr(10) || chr(10) || reply || chr(10) || '```python' || chr(10) || code || '```' || chr(10) end"""
_AUDIT = [
    ("ord", "ord"),
    ("call", "conv_id % 60"),
    ("task_id", "'mbpp_' || cast(conv_id % 25 as {T})"),
    ("reward", "cast((conv_id * 7 + turn * 3) % 6 as double) / 5"),
    ("completion", _COMPLETION),
]
AUDIT_SQL = TURNS_SQL + f""", audit as (select {', '.join(f"{e} as {n}" for n, e in _AUDIT)} from (select *, {_CODE} as code from turns) q)""".replace("{T}", "varchar")
PROMPTS_SQL = "prompts as (select 'mbpp_' || cast(item_id as varchar) as task_id, text as task_prompt, item_id as ord from benchmark where item_id % 25 <> 7)"


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).withColumn("code", text(_CODE.replace("{T}", "string")))
    return rows.select(*(text(e.replace("{T}", "string")).alias(n) for n, e in _AUDIT))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").where("item_id % 25 <> 7").select(F.expr("'mbpp_' || cast(item_id as string)").alias("task_id"), F.col("text").alias("prompt"), F.col("item_id").alias("ord"))


#: White space, strip and the layers, as SQL for the oracle.
WS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
FENCE = rf"(?s)```(?:python)?{WS}*\n(.*?)```"


def sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def sql_layers(e: str) -> dict[str, str]:
    rest = sql_strip(rf"regexp_replace({e}, '(?s)<think>.*?</think>', '', 'g')")
    return {
        "thinking": sql_strip(rf"regexp_extract({e}, '(?s)<think>(.*?)</think>', 1)"),
        "code": sql_strip(rf"array_to_string(regexp_extract_all({rest}, '{FENCE}', 1), chr(10))"),
        "collaboration": sql_strip(rf"regexp_replace({rest}, '{FENCE}', '', 'g')"),
    }


def sql_list(parts: dict[str, str]) -> str:
    return ", ".join(f"{e} as {n}" for n, e in parts.items())


TRACES_SQL = (
    AUDIT_SQL + ", " + PROMPTS_SQL
    + f""", pos as (select a.*, p.task_prompt, {sql_list(sql_layers('completion'))} from audit a left join prompts p using (task_id) where reward > 0),
 cut as (select max(call) as max_call, cast(trunc(max(call) * (1.0::double - 1.0::double/3.0::double)) as bigint) as later_cut from audit),
 good as (select *, sha1(code) as k from pos where coalesce(task_prompt, '') <> '' and code <> '' and collaboration <> ''),
 latest as (select * from (select g.*, row_number() over (partition by task_id, k order by call desc, ord desc) as rn, min(ord) over (partition by task_id, k) as first_ord
   from good g, cut where call >= later_cut) z where rn = 1)"""
)


_PAIR_TEXT = """case conv_id % 5 when 0 then reply when 1 then ' ' || reply || chr(10) when 2 then '  ' when 3 then repeat(reply || ' ', 40) else '[regen-paraphrase] ' || reply end"""
PAIRS_SQL = TURNS_SQL + f""", pairs as (select ord, 'mbpp_' || cast(conv_id % 25 as varchar) as task_id, ask as task_prompt, ask as thinking,
 case when turn % 6 = 2 then '' else 'x = ' || cast(turn as varchar) end as code, reply as rl_collaboration, {_PAIR_TEXT} as regen_collaboration,
 cast(turn as double) / 4 as reward from turns)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select(
        "ord", F.expr("'mbpp_' || cast(conv_id % 25 as string)").alias("task_id"), F.col("ask").alias("task_prompt"), F.col("ask").alias("thinking"),
        F.expr("case when turn % 6 = 2 then '' else 'x = ' || cast(turn as string) end").alias("code"), F.col("reply").alias("rl_collaboration"), F.expr(_PAIR_TEXT).alias("regen_collaboration"), F.expr("cast(turn as double) / 4").alias("reward"),
    )


_SCORE = "cast(4 + (l.doc_id * {k}) % 7 as {T}) || '.' || cast(l.quality * 5 as {T})"
_FIELDS = {k: _SCORE.replace("{k}", str(n)) for n, k in enumerate(("clarity", "conciseness", "informativeness", "naturalness", "overall"), 1)}


def _json(keys: list[str], sep: str = ": ", end: str = "}", quote: str = '"') -> str:
    return "'{' || " + " || ', ' || ".join(f"'{quote}{k}{quote}{sep}' || {_FIELDS[k]}" for k in keys) + f" || '{end}'"


_ALL = list(_FIELDS)
_ANSWER = f"""case l.doc_id % 9
 when 0 then {_json(_ALL)}
 when 1 then 'Scores:' || chr(10) || '```json' || chr(10) || {_json(_ALL)} || chr(10) || '```'
 when 2 then 'I think ' || {_json(_ALL)} || ' is fair.'
 when 3 then {_json(_ALL, end=', }')}
 when 4 then {_json(_ALL[:4])}
 when 5 then {_json(_ALL[:4], end=', "overall": null}')}
 when 6 then {_json(_ALL[1:])}
 when 7 then 'clarity = ' || {_FIELDS['clarity']} || '; conciseness: ' || {_FIELDS['conciseness']} || '; informativeness=' || {_FIELDS['informativeness']} || '; naturalness: ' || {_FIELDS['naturalness']} || ';'
 else '  ' end"""
JUDGE_SQL = f"judge as (select l.doc_id, l.quality, {_ANSWER} as answer from labels l)".replace("{T}", "varchar")


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").alias("l").select("doc_id", "quality", F.expr(_ANSWER.replace("{T}", "string")).alias("answer"))


_TAG = "case d.doc_id % 3 when 0 then 'base' when 1 then 'rl' else 'final' end"
EVAL_SQL = f"evals as (select d.doc_id, {_TAG} as model_tag, d.text, l.quality, l.toxic from documents d join labels l using (doc_id))"


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select("doc_id", F.expr(_TAG.replace("d.", "")).alias("model_tag"), "text", "quality", "toxic")


_RAW_ID = "case doc_id % 4 when 0 then 'mbpp_' || cast(doc_id % 400 as {T}) when 1 then 'Mbpp/' || cast(doc_id % 400 as {T}) when 2 then cast(doc_id % 400 as {T}) else 'mbpp_00' || cast(doc_id % 400 as {T}) end"
_SPLIT = "case doc_id % 5 when 0 then 'train' when 1 then 'test' when 2 then 'validation' when 3 then 'prompt' else 'other' end"
SPLITS_SQL = f"splits as (select doc_id as ord, {_RAW_ID} as task_id, {_SPLIT} as split, case when doc_id % 7 = 0 then '' else source end as text, lang as prompt, text as code from documents)".replace("{T}", "varchar")
EVAL_IDS_SQL = "eval_ids as (select case item_id % 3 when 0 then 'Mbpp/' || cast(item_id * 3 as varchar) when 1 then 'mbpp_' || cast(item_id * 3 as varchar) else cast(item_id * 3 as varchar) end as task_id from benchmark)"


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.expr(_RAW_ID.replace("{T}", "string")).alias("task_id"), F.expr(_SPLIT).alias("split"), F.expr("case when doc_id % 7 = 0 then '' else source end").alias("text"), F.col("lang").alias("prompt"), F.col("text").alias("code"))


def eval_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.expr("case item_id % 3 when 0 then 'Mbpp/' || cast(item_id * 3 as string) when 1 then 'mbpp_' || cast(item_id * 3 as string) else cast(item_id * 3 as string) end").alias("task_id"))


_LOG = """case event_id % 4
 when 0 then '  3%|x         | ' || cast(event_id % 300 as {T}) || '/300 [1:0' || cast(event_id % 10 as {T}) || ':08<29:17:09, ' || cast(event_id % 500 as {T}) || '.5s/it]'
 when 1 then 'note: loss is fine'
 when 2 then '{''loss'': ' || cast(event_id % 7 as {T}) || '.25, ''reward'': 0.' || cast(event_id % 10 as {T}) || ', ''epoch'': ' || cast(event_id % 40 as {T}) || '.5}'
 else '{''loss'': 1.0, ''reward'': nan}' end"""
LOG_SQL = f"log as (select event_id as place, {_LOG} as value from events)".replace("{T}", "varchar")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ANSI doubles quotes inside literals; Spark joins adjacent literals instead, so the text is written with double quotes
    e = _LOG.replace("{T}", "string").replace("'{''loss'': '", '"{\'loss\': "').replace("'.25, ''reward'': 0.'", '".25, \'reward\': 0."').replace("', ''epoch'': '", '", \'epoch\': "').replace("'{''loss'': 1.0, ''reward'': nan}'", '"{\'loss\': 1.0, \'reward\': nan}"')
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("place"), F.expr(e).alias("value"))


_CASES = """case item_id % 6
 when 0 then '[{"testtype": "stdin", "input": "' || cast(item_id as {T}) || '", "output": "3"}, {"testtype": "functional", "input": "1", "output": "2"}]'
 when 1 then '{"inputs": ["1", "2"], "outputs": ["a", "b", "c"], "fn_name": "f' || cast(item_id as {T}) || '"}'
 when 2 then '{"input": "7", "output": "8", "fn_name": "g"}'
 when 3 then 'not json'
 when 4 then '[]'
 else '[{"type": "CALL_BASED", "inputs": "5", "outputs": "6"}, 17]' end"""
CASES_SQL = f"raw_cases as (select item_id, {_CASES} as raw from benchmark)".replace("{T}", "varchar")


def raw_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.expr(_CASES.replace("{T}", "string")).alias("raw"))


TOKENS_SQL = "token_rows as (select doc_id, list_transform(string_split(text, ' '), lambda w: cast(length(w) % 10 as integer)) as ids from documents)"


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths modulo 10 as token ids: 7 ends thinking, 8 is a fence."""
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", " "), lambda w: (F.length(w) % 10).cast("int")).alias("ids"))
