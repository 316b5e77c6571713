"""A completion's layers: thinking, code and collaboration."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .pytext import WORD, WS, let, strip

THINK = r"(?s)<think>(.*?)</think>"
FENCE = rf"(?s)```(?:python)?{WS}*\n(.*?)```"
_DEF = rf"(?s)(def {WORD}+.*?)(?:\n\n|\z)"


def _unthought(output: Column) -> Column:
    return F.regexp_replace(output, THINK, "")


def _fenced(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))


def split_layers(output: Column) -> Column:
    """struct(thinking, code, collaboration): the first think block, all fence bodies, and what is left; null as ''."""

    def parts(both: Column) -> Column:
        return F.struct(
            strip(F.regexp_extract(both["whole"], THINK, 1)).alias("thinking"),
            strip(F.array_join(_fenced(both["rest"]), "\n")).alias("code"),
            strip(F.regexp_replace(both["rest"], FENCE, "")).alias("collaboration"),
        )

    whole = F.coalesce(output, F.lit(""))
    return let(F.struct(whole.alias("whole"), strip(_unthought(whole)).alias("rest")), parts)


def extract_code(output: Column) -> Column:
    """All fence bodies, else the first def up to an empty line, else ''."""
    rest = _unthought(F.coalesce(output, F.lit("")))
    pick = lambda blocks: F.when(F.size(blocks) > 0, strip(F.array_join(blocks, "\n"))).otherwise(strip(F.regexp_extract(rest, _DEF, 1)))
    return let(_fenced(rest), pick)


def diagnostics(text: Column) -> dict[str, Column]:
    return {"has_think_end": F.contains(text, F.lit("</think>")), "has_python_fence": F.contains(F.lower(text), F.lit("```python")), "completion_chars": F.length(text)}


def message_text(messages: Column) -> Column:
    """The contents of an array of messages, one a line."""
    return F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


def has_think(text: Column) -> Column:
    return F.contains(text, F.lit("<think>")) | F.contains(text, F.lit("</think>"))


def reject_think(text: Column) -> Column:
    """The text; an error if a think tag is left in it."""
    return F.when(has_think(text), F.raise_error(F.concat(F.lit("think tags in regenerated text: "), F.substring(text, 1, 200))).cast("string")).otherwise(text)


def function_name(code: Column) -> Column:
    """The first function defined at the start of a line; null without one."""
    return F.nullif(F.regexp_extract(code, rf"(?m)^{WS}*(?:async{WS}+)?def{WS}+({WORD}+){WS}*\(", 1), F.lit(""))


@F.pandas_udf(StringType())
def parsed_function_name(codes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The first function at the top level of a program, by its syntax tree; null if there is none or it doesn't parse."""

    def first(code: str | None) -> str | None:
        try:
            tree = ast.parse(code or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None
        return next((x.name for x in tree.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))), None)

    for batch in codes:
        yield batch.map(first)


def first_function(code: Column) -> Column:
    """The parsed name, else the name that the pattern finds."""
    return F.coalesce(parsed_function_name(code), function_name(code))


def content_key(code: Column) -> Column:
    return F.sha1(strip(code))
