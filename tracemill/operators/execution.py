"""Running programs of completions against tests, each in a child process with limits.

The functions take iterators of pandas series (Arrow batches). A Python worker keeps servers (``program_server``), interpreters
that fork a child for each program, so a test costs a fork and not the start of an interpreter. A child gets no
environment, a temporary folder of its own, limits on CPU time, memory and file size, and is killed
with its process group on a timeout. This limits accidents; it is no sandbox against
hostile code: run only programs you may run.
"""

from __future__ import annotations

import inspect
import json
import os
import queue
import shutil
import subprocess
import sys
import tempfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.cases import CALLS

from . import program_server

TIMEOUT = 10
MAX_TESTS = 5
WORKERS = int(os.environ.get("CODE_EXEC_MAX_WORKERS", "16"))
#: Bytes that a program may print beside the text that is expected of it (white space that doesn't count); it is ended beyond that.
MOST_OUTPUT = 64 << 20
MAX_CASES = 40


class Server:
    """One server process and the pipes to it."""

    def __init__(self):
        self.asked, far_asked, far_answers, self.answers = *os.pipe()[::-1], *os.pipe()[::-1]
        command = [sys.executable, "-I", "-c", inspect.getsource(program_server), str(far_asked), str(far_answers)]  # its source may lie in an archive
        self.process = subprocess.Popen(command, stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, pass_fds=(far_asked, far_answers), env={"PATH": "/usr/bin:/bin", "LANG": "C.UTF-8"})
        os.close(far_asked)
        os.close(far_answers)

    def run(self, request: dict) -> dict:
        program_server.write_frame(self.asked, request)
        answer = program_server.read_frame(self.answers)
        if answer is None:
            raise OSError("the server is gone")
        return answer

    def close(self) -> None:
        os.close(self.asked)
        os.close(self.answers)
        self.process.wait()


_FREE: dict[int, queue.LifoQueue] = {}


def _served(request: dict) -> dict:
    """The answer of a free server of this process, or of a new one; a server that ended is replaced."""
    free = _FREE.setdefault(os.getpid(), queue.LifoQueue())  # a forked worker has servers of its own
    try:
        server = free.get_nowait()
    except queue.Empty:
        server = Server()
    try:
        answer = server.run(request)
    except BaseException:
        server.close()
        raise
    free.put(server)
    return answer


def run_program(source: str, stdin: str = "", timeout: int = TIMEOUT, most: int = MOST_OUTPUT, harness: str | None = None, spec: dict | None = None) -> tuple[bool, str, object]:
    """Whether a program exits with 0 in time, what it prints, and what its harness reports.

    With a harness (call or plus) the program is followed by it, what it prints goes nowhere, and its input is empty.
    """
    home = tempfile.mkdtemp(prefix="run-")
    given, printed = os.path.join(home, "stdin"), os.devnull if harness else os.path.join(home, "stdout")
    try:
        with open(given, "wb") as f:
            f.write(stdin.encode("utf-8", "surrogatepass"))
        if not harness:
            open(printed, "wb").close()
        work = os.path.join(home, "work")
        os.mkdir(work)
        got = _served({"source": source, "stdin": given, "stdout": printed, "home": work, "timeout": timeout, "most": most, "harness": harness, "spec": spec})
        if got["code"] != 0:
            return False, "", None
        if harness:
            return True, "", got["result"]
        if os.path.getsize(printed) > most:
            return False, "", None
        with open(printed, "rb") as f:
            return True, f.read().decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"), None
    except (OSError, ValueError):
        return False, "", None
    finally:
        shutil.rmtree(home, ignore_errors=True)


def passes_test(code: str, test: str, timeout: int = TIMEOUT) -> bool:
    """Whether the program with the test behind it exits with 0; what it prints is not looked at."""
    return run_program(f"{code}\n\n{test}", timeout=timeout)[0]


def normal_output(text: str | None) -> str:
    kept = [line.rstrip() for line in (text or "").splitlines()]
    while kept and not kept[-1]:
        kept.pop()
    return "\n".join(kept)


def call_arguments(value) -> list:
    """A list as it is; other values alone; a text as a JSON list, else one JSON value (or plain text) a line."""
    if isinstance(value, list):
        return value
    if not isinstance(value, str):
        return [value]

    def parsed(text: str):
        try:
            return json.loads(text)
        except json.JSONDecodeError:
            return text

    whole = parsed(value.strip())
    if isinstance(whole, list):
        return whole
    return [parsed(line.strip()) for line in value.strip().splitlines() if line.strip()]


def passes_case(code: str, case: dict, timeout: int = TIMEOUT) -> bool:
    """A call case compares the function's value, a stdin case what the program prints."""
    kind = str(case.get("type") or "stdin").lower()
    if kind in CALLS:
        expected = case.get("output", case.get("expected"))
        try:
            expected = json.loads(expected) if isinstance(expected, str) else expected
        except json.JSONDecodeError:
            pass
        spec = {"fn": case.get("fn_name") or "solve", "args": call_arguments(case.get("input", case.get("args"))), "expected": expected}
        return run_program(code, timeout=timeout, harness="call", spec=spec)[0]
    expected = str(case.get("output") or "")
    ok, out, _ = run_program(code, str(case.get("input") or ""), timeout, MOST_OUTPUT + 4 * len(expected))
    return ok and normal_output(out) == normal_output(expected)


def plus_asserts(entry_point: str, solution: str, inputs: str, most: int = MAX_CASES, timeout: int = 60) -> list[str]:
    """Asserts of the solution's own values for a JSON list of inputs; inputs that it rejects are left out."""
    listed = json.loads(inputs or "[]")[:most]
    if not listed:
        return []
    ok, _, asserts = run_program(solution, timeout=timeout, harness="plus", spec={"fn": entry_point, "inputs": listed})
    if not ok or asserts is None:
        raise RuntimeError(f"the solution of {entry_point!r} doesn't run")
    return asserts


def _in_threads(function, *series: pd.Series) -> pd.Series:
    with ThreadPoolExecutor(WORKERS) as pool:
        return pd.Series(list(pool.map(function, *series)), index=series[0].index)


def test_udf(timeout: int = TIMEOUT):
    @F.pandas_udf("boolean")
    def passed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for codes, tests in batches:
            yield _in_threads(lambda c, t: passes_test(c, t, timeout), codes, tests)

    return passed.asNondeterministic()


def case_udf(timeout: int = TIMEOUT):
    @F.pandas_udf("boolean")
    def passed(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        for codes, cases in batches:
            rows = cases.where(cases.notna(), None).to_dict("records")
            yield _in_threads(lambda c, x: passes_case(c, x, timeout), codes, pd.Series(rows, index=codes.index))

    return passed.asNondeterministic()


def plus_udf(most: int = MAX_CASES):
    @F.pandas_udf("array<string>")
    def asserts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for entry, solution, inputs in batches:
            yield _in_threads(lambda e, s, i: plus_asserts(e, s, i, most), entry, solution, inputs)

    return asserts.asNondeterministic()


def rewards(rows: DataFrame, key: str = "ord", timeout: int = TIMEOUT, max_tests: int = MAX_TESTS) -> DataFrame:
    """(key, reward): passed / tests over the first max_tests tests of (key, code, test_cases); 0 without code or tests.

    Rows without code run nothing; tests are rows of their own, so one task's tests spread over the cluster.
    """
    tests = F.slice(F.coalesce("test_cases", F.array().cast("array<string>")), 1, max_tests)
    jobs = rows.where(F.coalesce("code", F.lit("")) != "").select(key, "code", F.explode(tests).alias("test"))
    ran = jobs.withColumn("passed", test_udf(timeout)("code", "test"))
    got = ran.groupBy(key).agg((F.count_if("passed") / F.count(F.lit(1))).alias("reward"))
    return rows.select(key).join(got, key, "left").select(key, F.coalesce("reward", F.lit(0.0)).alias("reward"))


def passed_tasks(rows: DataFrame, key: str = "ord", timeout: int = TIMEOUT) -> DataFrame:
    """(key, passed) of (key, code, test_cases, cases, harness): all structured cases if the harness or the task has them, else all tests; none is no pass."""
    none = F.lit(False)
    structured = (F.coalesce(F.col("harness") == "lcb", none)) | (F.coalesce(F.size("cases"), F.lit(0)) > 0)
    live = rows.where(F.trim(F.coalesce("code", F.lit(""))) != "")
    by_case = live.where(structured).select(key, "code", F.explode("cases").alias("case")).withColumn("ok", case_udf(timeout)("code", "case")).select(key, "ok")
    by_test = live.where(~structured).select(key, "code", F.explode("test_cases").alias("test")).withColumn("ok", test_udf(timeout)("code", "test")).select(key, "ok")
    got = by_case.unionByName(by_test).groupBy(key).agg(F.bool_and("ok").alias("passed"))
    return rows.select(key).join(got, key, "left").select(key, F.coalesce("passed", none).alias("passed"))


def listed_tests(tests: Column) -> Column:
    """Tests that a reward row brings as JSON text, as a list; text that is no list of texts, or none at all, is an error."""
    got = F.from_json(tests, "array<string>", {"mode": "PERMISSIVE"})
    why = F.when(tests.isNull(), F.lit("test_cases is null")).otherwise(F.concat(F.lit("test_cases is no JSON list: "), F.substring(tests, 1, 80)))
    return F.coalesce(F.when(F.try_parse_json(tests).isNotNull(), got), F.raise_error(why).cast("array<string>"))


def reward_callable(spark, folder: str | None = None, rank: int = 0, timeout: int = TIMEOUT, max_tests: int = MAX_TESTS):
    """reward(completions, test_cases, task_id) -> list of rewards, for a trainer's loop; each call is one of the rank's in the reward log in folder.

    Calls are numbered behind the committed ones of the rank, whichever process wrote them; a caller that runs a call again
    names it (call=) and adds nothing. Lists of tests stand for as many completions each as the counts allow; a count that doesn't fit, or null tests, is an error.
    """
    from tracemill.functions.layers import extract_code

    from tracemill.sources import ranklog

    from .gates import GateError

    def reward(completions, test_cases, task_id=None, call=None):
        n, m = len(completions), len(test_cases)
        if not m or n % m or any(t is None for t in test_cases) or (task_id is not None and len(task_id) * (n // m) != n and len(task_id) != n):
            raise GateError(f"{n} completions, {m} rows of tests")
        ids = task_id if task_id is not None else [None] * m
        each = [(i, ids[i * len(ids) // n], text, json.loads(t) if isinstance(t := test_cases[i * m // n], str) else list(t)) for i, text in enumerate(completions)]
        rows = spark.createDataFrame(each, "ord int, task_id string, completion string, test_cases array<string>").withColumn("code", extract_code(F.col("completion")))
        got = rewards(rows, timeout=timeout, max_tests=max_tests).orderBy("ord").collect()
        if folder is not None:
            known = spark.createDataFrame(got, "ord int, reward double")
            ranklog.append(audited(rows.join(known, "ord").withColumn("call", F.lit(None).cast("bigint"))).drop("call"), folder, rank=rank, call=call)
        return [r.reward for r in got]

    return reward


def audited(rows: DataFrame, reward: Column | None = None) -> DataFrame:
    """Reward log rows (call, task_id, reward, flags, completion) of (call, task_id, completion, reward)."""
    from tracemill.functions.layers import diagnostics

    flags = diagnostics(F.col("completion"))
    return rows.select("call", "task_id", (reward if reward is not None else F.col("reward")).alias("reward"), *(c.alias(k) for k, c in flags.items()), "completion")
