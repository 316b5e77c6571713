"""Structured test cases: readers of the JSON forms that they come in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.schemas import CASE

from .pytext import let, strip

#: Type names that mean a function call.
CALLS = ("functional", "call", "call_based", "function")
_NONE = "array<" + CASE + ">"


def _text(v: Column, key: str) -> Column:
    """A field's text: strings as they are, other values as JSON."""
    inner = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(v, f"$.{key}", "string")).when(~F.is_variant_null(inner), F.to_json(inner))


def _present(v: Column, key: str) -> Column:
    return F.schema_of_variant(v).rlike(rf"[<\s,]{key}:")


def _case(v: Column) -> Column:
    named = F.coalesce(F.nullif(_text(v, "testtype"), F.lit("")), F.nullif(_text(v, "type"), F.lit("")), F.lit(""))
    fn = F.nullif(_text(v, "fn_name"), F.lit(""))
    kind = F.when(named == "", F.when(fn.isNotNull(), "call").otherwise("stdin")).when(F.lower(named).isin(*CALLS), "call").otherwise("stdin")
    pick = lambda a, b: F.when(_present(v, a), _text(v, a)).when(_present(v, b), _text(v, b)).otherwise("")
    return F.struct(kind.alias("type"), pick("input", "inputs").alias("input"), pick("output", "outputs").alias("output"), fn.alias("fn_name")).cast(CASE)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def public_cases(raw: Column) -> Column:
    """Cases of a JSON text: a list of objects (or of JSON texts of objects), one object, or {inputs, outputs, fn_name}; else none."""
    return let(F.try_parse_json(strip(raw)), _public)


def _public(v: Column) -> Column:
    zipped = _is(v, "OBJECT") & _present(v, "inputs") & _present(v, "outputs")
    fn = F.nullif(_text(v, "fn_name"), F.lit(""))
    side = lambda key: F.try_variant_get(v, f"$.{key}", "array<variant>")
    as_text = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x))
    n = F.least(F.size(side("inputs")), F.size(side("outputs")))
    pairs = F.transform(F.slice(F.arrays_zip(side("inputs").alias("i"), side("outputs").alias("o")), F.lit(1), F.greatest(n, F.lit(0))), lambda p: F.struct(F.when(fn.isNotNull(), "call").otherwise("stdin").alias("type"), as_text(p["i"]).alias("input"), as_text(p["o"]).alias("output"), fn.alias("fn_name")).cast(CASE))
    opened = F.transform(_items(v), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_parse_json(F.try_variant_get(x, "$", "string"))).otherwise(x))
    listed = F.transform(F.filter(opened, lambda x: _is(x, "OBJECT")), _case)
    return F.coalesce(F.when(zipped, pairs).when(_is(v, "OBJECT"), F.array(_case(v))).when(_is(v, "ARRAY"), listed), F.array().cast(_NONE))


def task_cases(cases_json: Column, fallback: Column | None = None) -> Column:
    """Cases of a task: a list as it is, a wrapper {mode, fn_name, cases} with its name and mode filled in, else those of the fallback text."""
    return let(F.try_parse_json(cases_json), lambda v: _wrapped(v, fallback))


def _wrapped(v: Column, fallback: Column | None) -> Column:
    fn, mode = F.nullif(_text(v, "fn_name"), F.lit("")), F.nullif(_text(v, "mode"), F.lit(""))

    def own(x: Column) -> Column:
        got = F.when(_present(x, "fn_name"), _text(x, "fn_name")).otherwise(fn)
        kind = F.when(_present(x, "type"), _text(x, "type")).otherwise(F.coalesce(mode, F.when(fn.isNotNull(), "call").otherwise("stdin")))
        return F.struct(kind.alias("type"), _text(x, "input").alias("input"), _text(x, "output").alias("output"), got.alias("fn_name")).cast(CASE)

    wrapped = F.transform(F.try_variant_get(v, "$.cases", "array<variant>"), own)
    either = lambda x, a, b: F.when(_present(x, a), _text(x, a)).when(F.lower(_text(x, "type")).isin(*CALLS), _text(x, b))
    plain = F.transform(F.filter(_items(v), lambda x: _is(x, "OBJECT")), lambda x: F.struct(_text(x, "type").alias("type"), either(x, "input", "args").alias("input"), either(x, "output", "expected").alias("output"), _text(x, "fn_name").alias("fn_name")).cast(CASE))
    rest = public_cases(fallback) if fallback is not None else F.array().cast(_NONE)
    return F.when(_is(v, "OBJECT") & _present(v, "cases"), F.coalesce(wrapped, F.array().cast(_NONE))).when(_is(v, "ARRAY"), plain).otherwise(rest)


def metadata_function(metadata: Column) -> Column:
    return F.coalesce(F.nullif(F.get_json_object(metadata, "$.func_name"), F.lit("")), F.nullif(F.get_json_object(metadata, "$.fn_name"), F.lit("")))


def with_function(cases: Column, fn: Column) -> Column:
    """Call cases without a function get this one."""
    fill = lambda c: F.when((c["type"] == "call") & F.coalesce(c["fn_name"] == "", F.lit(True)) & fn.isNotNull(), c.withField("fn_name", fn)).otherwise(c)
    return F.transform(cases, fill)
