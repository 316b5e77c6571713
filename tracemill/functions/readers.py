"""Readers that make rows of a text, as table functions for SQL: ``select ... from logs, lateral progress_marks(value)``.

``register(spark)`` names them in a session. What rows they give is settled when a query is analysed, from constant arguments;
a wrong argument is an error there and then. They read what ``operators.logs`` and ``functions.cases`` read by expressions,
which are the faster way from DataFrame code.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .cases import CALLS

#: The fields of a printed metric dict.
METRICS = ("loss", "grad_norm", "learning_rate", "reward", "reward_std", "completion_length", "kl", "epoch")
_PRINTED = re.compile(r"\{[^{}]*'loss'[^{}]*\}")


def _text_argument(argument: AnalyzeArgument, name: str) -> None:
    if argument.dataType != StringType():
        raise ValueError(f"{name}: a string is needed, not {argument.dataType.simpleString()}")


def _constant(argument: AnalyzeArgument, name: str):
    if not argument.isConstantExpression:
        raise ValueError(f"{name} must be a constant")
    return argument.value


def _json(text: str):
    def refuse(_name: str):
        raise ValueError("not a number")

    return json.loads(text, parse_constant=refuse)


class ProgressMarks:
    """(pos, step, elapsed, eta, sec_per_it) of each progress mark of so many steps in a text."""

    @staticmethod
    def analyze(text: AnalyzeArgument, total: AnalyzeArgument) -> AnalyzeResult:
        _text_argument(text, "text")
        if not isinstance(steps := _constant(total, "total"), int) or steps <= 0:
            raise ValueError(f"total must be a positive number of steps, not {steps!r}")
        return AnalyzeResult(StructType().add("pos", LongType()).add("step", LongType()).add("elapsed", StringType()).add("eta", StringType()).add("sec_per_it", DoubleType()))

    def eval(self, text: str | None, total: int) -> Iterator[tuple]:
        for pos, m in enumerate(re.finditer(rf"([0-9]+)/{total}[ \t\n\x0B\f\r]+\[([^<]+)<([^,]+),[ \t\n\x0B\f\r]+([0-9.]+)s/it\]", text or "")):
            try:
                seconds = float(m[4])
            except ValueError:
                seconds = None
            yield pos, int(m[1]), m[2].strip(), m[3].strip(), seconds


class MetricEvents:
    """(pos, then a number for each named field) of each printed dict with a loss and an epoch in a text; names is a constant like 'loss, reward'."""

    @staticmethod
    def analyze(text: AnalyzeArgument, names: AnalyzeArgument) -> AnalyzeResult:
        _text_argument(text, "text")
        schema = StructType().add("pos", LongType())
        for name in MetricEvents.named(_constant(names, "names")):
            if name not in METRICS:
                raise ValueError(f"no metric {name!r}; there are {', '.join(METRICS)}")
            schema = schema.add(name, DoubleType())
        return AnalyzeResult(schema)

    @staticmethod
    def named(names: str) -> list[str]:
        return [n.strip() for n in names.split(",")]

    def eval(self, text: str | None, names: str) -> Iterator[tuple]:
        for pos, m in enumerate(_PRINTED.finditer(text or "")):
            try:
                found = _json(m[0].replace("'", '"'))
            except ValueError:
                continue
            if "epoch" in found:
                yield pos, *(float(v) if isinstance(v := found.get(n), (int, float)) and not isinstance(v, bool) else None for n in self.named(names))


class TestCases:
    """(pos, type, input, output, fn_name) of each public case in a JSON text."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _text_argument(text, "text")
        schema = StructType().add("pos", LongType())
        for name in ("type", "input", "output", "fn_name"):
            schema = schema.add(name, StringType())
        return AnalyzeResult(schema)

    def eval(self, text: str | None) -> Iterator[tuple]:
        for pos, case in enumerate(public_cases(text)):
            yield pos, *case


def _as_text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _one_case(v: dict) -> tuple:
    text = lambda key: _as_text(v.get(key))
    named, fn = text("testtype") or text("type") or "", text("fn_name") or None
    call = named.lower() in CALLS if named else fn is not None
    pick = lambda a, b: text(a) if a in v else text(b) if b in v else ""
    return "call" if call else "stdin", pick("input", "inputs"), pick("output", "outputs"), fn


def public_cases(text: str | None) -> list[tuple]:
    """Cases of a list of objects (or of JSON texts of objects), of one object, or of {inputs, outputs, fn_name}."""
    try:
        v = _json((text or "").strip())
    except ValueError:
        return []
    if isinstance(v, dict) and "inputs" in v and "outputs" in v:
        if not isinstance(v["inputs"], list) or not isinstance(v["outputs"], list):
            return []
        fn = _as_text(v.get("fn_name")) or None
        return [("stdin" if fn is None else "call", _as_text(i), _as_text(o), fn) for i, o in zip(v["inputs"], v["outputs"])]
    out = []
    for item in v if isinstance(v, list) else [v]:
        if isinstance(item, str) and isinstance(v, list):
            try:
                item = _json(item)
            except ValueError:
                continue
        if isinstance(item, dict):
            out.append(_one_case(item))
    return out


FUNCTIONS = {"progress_marks": ProgressMarks, "metric_events": MetricEvents, "test_cases": TestCases}


def register(spark: SparkSession) -> None:
    for name, reader in FUNCTIONS.items():
        spark.udtf.register(name, udtf(reader))
