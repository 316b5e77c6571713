"""Chat messages for coding, regeneration and judging, and deterministic mock generations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pytext import filled, rstrip, strip

# The texts that models were prompted with, as written.
CODING_SUFFIX = (
    "\n\nSolve this as a Python function with the exact interface implied by the "
    "prompt and examples. Think briefly and choose one approach. End with the "
    "complete runnable solution in exactly one fenced Python code block; code is "
    "mandatory and has priority over explanation."
)
EXAMPLE_LEAD = "\n\nRequired public interface example (your definitions must make this assertion executable):\n"
REGEN_SYSTEM = """你是一个AI编程助手的"表达优化师"。
你的任务是：给定一个编程问题和已完成的解决方案，写一段简洁清晰的说明给用户。"""
REGEN_USER = """## 用户的编程需求
{task_prompt}

## 已完成的解决方案（思考过程）
{thinking}

## 已完成的代码
```python
{code}
```

## 请为用户写一段协作消息
要求：
1. 一句话说明你的理解
2. 一句话说明核心思路
3. 如果有重要的设计决策，简要说明
4. 不要重复代码内容
5. 总长度控制在50-150字（中文）或30-80词（英文）"""
JUDGE_USER = """请评估以下AI编程助手回复的协作质量。

## 用户问题
{task_prompt}

## AI的回复
{collaboration_text}

## 评分标准（每项1-10分）
- clarity: 用户能否快速理解AI做了什么？
- conciseness: 是否简洁不冗余？
- informativeness: 是否传达了关键信息（思路、决策）？
- naturalness: 语言是否自然流畅？

请直接输出JSON（不要其他内容）:
{"clarity": X, "conciseness": X, "informativeness": X, "naturalness": X, "overall": X}"""
PROMPT_FORMAT = "qwen_chat_regen_v1"
TRACE_THOUGHT = ("Analyze the problem: ", ". I will implement a direct solution matching the reference.")
TRACE_NOTE = "I understood the request and implemented a straightforward solution. Here is the working code with the expected interface."
MOCK = {
    "rl": ("optimize hard; skip explanations for the user response", "ok code done. used some approach. whatever. long chain of thought leak: "),
    "final": ("Recover readable explanation after DPO.", "I understood your request and implemented a clear solution. The core idea is a direct implementation of the specified behavior."),
    "base": ("Solve: ", "I understood the problem and wrote a straightforward implementation. The approach follows the problem statement directly."),
}
MOCK_CODE = "def solution(*args, **kwargs):\n    return None\n"
TRACE_CODE = "def solution():\n    pass\n"
REGEN_MARK = "[regen-paraphrase] "
REGEN_EMPTY = "Here is a clear explanation of the solution approach."


def _fill(template: str, **values: Column) -> Column:
    """The template with its {names} replaced; text in the values is never taken for a name."""
    parts, rest = [], template
    while True:
        at = min(((rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest), default=None)
        if at is None:
            return F.concat(*parts, F.lit(rest))
        parts += [F.lit(rest[: at[0]]), values[at[1]]]
        rest = rest[at[0] + len(at[1]) + 2 :]


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def coding(prompt: Column, tests: Column | None = None) -> Column:
    """One user turn: the prompt, the first test if the prompt doesn't show it, and the instruction."""
    content = rstrip(F.coalesce(prompt, F.lit("")))
    if tests is not None:
        example = strip(F.coalesce(F.get(tests, 0), F.lit("")))
        content = F.when((example != "") & ~F.contains(content, example), F.concat(content, F.lit(EXAMPLE_LEAD), example)).otherwise(content)
    return F.array(message("user", F.concat(content, F.lit(CODING_SUFFIX))))


def regeneration(prompt: Column, thinking: Column, code: Column) -> Column:
    return F.array(message("system", F.lit(REGEN_SYSTEM)), message("user", _fill(REGEN_USER, task_prompt=prompt, thinking=thinking, code=code)))


def judging(prompt: Column, text: Column) -> Column:
    return F.array(message("user", _fill(JUDGE_USER, task_prompt=prompt, collaboration_text=text)))


def completion(thinking: Column, note: Column, code: Column) -> Column:
    return F.concat(F.lit("<think>\n"), thinking, F.lit("\n</think>\n\n"), note, F.lit("\n\n```python\n"), code, F.lit("\n```\n"))


def mock_generation(tag: Column, prompt: Column, solution: Column) -> Column:
    """What a model of the given tag (rl, final, else base) is taken to answer, without a model."""
    prompt = F.coalesce(prompt, F.lit(""))
    code = F.coalesce(F.nullif(solution, F.lit("")), F.lit(MOCK_CODE))
    rl = completion(F.lit(MOCK["rl"][0]), F.concat(F.lit(MOCK["rl"][1]), F.substring(prompt, 1, 80)), code)
    final = completion(F.lit(MOCK["final"][0]), F.lit(MOCK["final"][1]), code)
    base = completion(F.concat(F.lit(MOCK["base"][0]), F.substring(prompt, 1, 100)), F.lit(MOCK["base"][1]), code)
    return F.when(tag == "rl", rl).when(tag == "final", final).otherwise(base)


def mock_trace(prompt: Column, solution: Column) -> Column:
    prompt = F.coalesce(prompt, F.lit(""))
    code = F.coalesce(F.nullif(solution, F.lit("")), F.lit(TRACE_CODE))
    return completion(F.concat(F.lit(TRACE_THOUGHT[0]), F.substring(prompt, 1, 120), F.lit(TRACE_THOUGHT[1])), F.lit(TRACE_NOTE), code)


def mock_regeneration(collaboration: Column) -> Column:
    return F.concat(F.lit(REGEN_MARK), filled(strip(F.coalesce(collaboration, F.lit(""))), F.lit(REGEN_EMPTY)))
