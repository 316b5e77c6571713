"""Readability scores: strict and lenient readers, pair filters, hypothesis checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.schemas import SCORE_KEYS, SCORES

from .pytext import WS, let, signed_one, signed_percent, strip

DETAILS = SCORE_KEYS[:-1]
THRESHOLD, GAP = 6.0, 0.5
IMPROVE, PRESERVE = 0.05, 0.02
_FENCED = rf"(?is)```(?:json)?{WS}*\n?(.*?)```"
_FLAT = r"(?s)\{[^{}]*\}"


def _repaired(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf",{WS}*\}}", "}"), rf",{WS}*\]", "]")


def _object(c: Column) -> Column:
    """The parsed JSON object, null if it isn't one."""
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def _number(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "double")


def judged(text: Column) -> Column:
    """struct(ok, reason, scores) of a judge's answer.

    The first candidate that is a JSON object counts: the text, or the inside of its first fence,
    then each flat object in it (or the span from the first to the last brace); without one, numbers after
    the keys' names anywhere in the text. Details are mandatory; overall is their mean if its key is absent.
    """
    return let(_read(text), _decided)


def _read(text: Column) -> Column:
    """struct(body, parsed, spelled): the stripped text, its first JSON object, and the numbers after the keys' names."""
    inner = lambda body: F.when(body.rlike(_FENCED), strip(F.regexp_extract(body, _FENCED, 1))).otherwise(body)
    spelled = lambda body: F.struct(*(F.nullif(F.regexp_extract(body, rf"(?i)[\"']?{k}[\"']?{WS}*[:=]{WS}*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double").alias(k) for k in SCORE_KEYS))
    found = lambda body: F.struct(body.alias("body"), let(inner(body), _first_object).alias("parsed"), spelled(body).alias("spelled"))
    return let(strip(F.coalesce(text, F.lit(""))), found)


def _first_object(raw: Column) -> Column:
    flats = F.regexp_extract_all(raw, F.lit(_FLAT), F.lit(0))
    span = F.regexp_extract_all(raw, F.lit(r"(?s)\{.*\}"), F.lit(0))
    candidates = F.concat(F.array(raw), let(flats, lambda f: F.when(F.size(f) > 0, f).otherwise(span)))
    return F.get(F.filter(F.transform(candidates, lambda c: _object(_repaired(c))), lambda v: v.isNotNull()), 0)


def _decided(s: Column) -> Column:
    parsed, by_text = s["parsed"], {k: s["spelled"][k] for k in SCORE_KEYS}
    whole = parsed.isNotNull()
    value = {k: F.when(whole, _number(parsed, k)).otherwise(by_text[k]) for k in SCORE_KEYS}
    has = lambda k: F.when(whole, F.schema_of_variant(parsed).rlike(rf"[<\s,]{k}:")).otherwise(by_text[k].isNotNull())
    null = lambda k: F.coalesce(F.is_variant_null(F.try_variant_get(parsed, f"$.{k}", "variant")), F.lit(False))
    some = F.greatest(*(by_text[k].isNotNull() for k in SCORE_KEYS)) | whole
    details = F.least(*(value[k].isNotNull() for k in DETAILS))
    mean = sum((value[k] for k in DETAILS[1:]), value[DETAILS[0]]) / len(DETAILS)
    reason = (
        F.when(s["body"] == "", "empty")
        .when(~some, "could not parse")
        .when(F.greatest(*(has(k) & value[k].isNull() & ~null(k) for k in SCORE_KEYS)), "not numeric")
        .when(~details, "missing required keys")
        .when(has("overall") & value["overall"].isNull(), "overall not numeric")
    )
    scores = F.struct(*(value[k].alias(k) for k in DETAILS), F.when(has("overall"), value["overall"]).otherwise(mean).alias("overall"))
    return let(F.struct(reason.alias("reason"), scores.cast(SCORES).alias("scores")), lambda r: F.struct(r["reason"].isNull().alias("ok"), r["reason"].alias("reason"), F.when(r["reason"].isNull(), r["scores"]).alias("scores")))


def strict(text: Column) -> Column:
    """The scores; an error where there are none (never invented zeros)."""
    return let(judged(text), lambda got: F.when(got["ok"], got["scores"]).otherwise(F.raise_error(F.concat(F.lit("judge scores: "), got["reason"])).cast(SCORES)))


def lenient(json: Column) -> Column:
    """Scores of a JSON object: missing or bad ones are 0; overall is the mean of the details if its key is absent and any detail is there."""
    return let(F.try_parse_json(json), _leniently)


def lenient_answer(text: Column) -> Column:
    """As lenient, of a judge's answer in any form that judged reads; 0 where there is no score at all."""
    return let(_read(text), lambda s: F.when(s["parsed"].isNotNull(), _leniently(s["parsed"])).otherwise(_spelled(s["spelled"])))


def _spelled(s: Column) -> Column:
    value = {k: F.coalesce(s[k], F.lit(0.0)) for k in SCORE_KEYS}
    some = F.greatest(*(s[k].isNotNull() for k in DETAILS))
    mean = sum((value[k] for k in DETAILS[1:]), value[DETAILS[0]]) / len(DETAILS)
    return F.struct(*(value[k].alias(k) for k in DETAILS), F.when(s["overall"].isNull() & some, mean).otherwise(value["overall"]).alias("overall"))


def _leniently(v: Column) -> Column:
    value = {k: F.coalesce(_number(v, k), F.lit(0.0)) for k in SCORE_KEYS}
    some = F.greatest(*(F.coalesce(F.variant_get(v, f"$.{k}", "variant").isNotNull() & ~F.is_variant_null(F.variant_get(v, f"$.{k}", "variant")), F.lit(False)) for k in DETAILS))
    absent = ~F.coalesce(F.schema_of_variant(v).rlike(r"[<\s,]overall:"), F.lit(False))
    mean = sum((value[k] for k in DETAILS[1:]), value[DETAILS[0]]) / len(DETAILS)
    return F.struct(*(value[k].alias(k) for k in DETAILS), F.when(absent & some, mean).otherwise(value["overall"]).alias("overall"))


def passes(scores: Column, threshold: float = THRESHOLD) -> Column:
    """Whether the overall score reaches the threshold; a missing one is 0."""
    return F.coalesce(scores["overall"], F.lit(0.0)) >= threshold


def keeps_pair(regen: Column, rl: Column, threshold: float = THRESHOLD, gap: float = GAP) -> Column:
    """regen >= threshold, regen > rl and regen - rl >= gap; null: false. Not-a-number never fails a comparison here, as each test is a rejection."""
    low = (regen < threshold) & ~F.isnan(regen)
    under = (regen <= rl) & ~F.isnan(regen) & ~F.isnan(rl)
    near = (regen - rl < gap) & ~F.isnan(regen - rl)
    return F.coalesce(~(low | under | near), F.lit(False))


def _packed(overall: Column) -> Column:
    down = lambda x: F.greatest(F.lit(0.0), overall - x)
    return F.struct(overall.alias("clarity"), down(0.2).alias("conciseness"), down(0.1).alias("informativeness"), overall.alias("naturalness"), overall.alias("overall"))


def mock_scores(regen: Column, rl: Column, base_regen: float = 7.5, base_rl: float = 5.0) -> tuple[Column, Column]:
    """Fixed scores: the regenerated text is better if the stripped texts differ."""
    differ = strip(F.coalesce(regen, F.lit(""))) != strip(F.coalesce(rl, F.lit("")))
    return tuple(_packed(F.when(differ, F.lit(x)).otherwise(F.lit(5.0))) for x in (base_regen, base_rl))


#: The names that a metric goes by, in order of preference.
CODING_NAMES = ("mbpp_plus_pass1", "pass_rate", "pass_at_1", "coding")
READABILITY_NAMES = ("readability_overall", "overall", "readability")


def aliased(metrics: Column, names: tuple[str, ...]) -> Column:
    """The first non-null metric of the names in a map; an error without one."""
    return F.coalesce(*(F.try_element_at(metrics, F.lit(n)) for n in names), F.raise_error(F.lit(f"metric missing: one of {' / '.join(names)}")).cast("double"))


def hypotheses(coding: dict[str, Column], reading: dict[str, Column], improve: float = IMPROVE, preserve: float = PRESERVE) -> Column:
    """array of (id, verified, delta, base, rl, final, skipped) for H1 to H4; tags base, rl, final (null: no final model)."""
    b, r, f = coding["base"], coding["rl"], coding["final"]
    x, y, z = reading["base"], reading["rl"], reading["final"]
    none = F.lit(None).cast("double")
    late = f.isNull() | z.isNull()

    def row(name, verified, delta, base, rl, final, skipped=F.lit(False)):
        return F.struct(F.lit(name).alias("id"), F.coalesce(verified, F.lit(False)).alias("verified"), delta.alias("delta"), base.alias("base"), rl.alias("rl"), final.alias("final"), skipped.alias("skipped"))

    unless = lambda c: F.when(~late, c)
    return F.array(
        row("H1_rl_improves_coding", r - b >= improve, signed_percent(r - b), b, r, none),
        row("H2_rl_hurts_readability", y < x, signed_one(y - x), x, y, none),
        row("H3_dpo_recovers_readability", unless(z >= x), unless(signed_one(z - y)), unless(x), unless(y), unless(z), late),
        row("H4_dpo_preserves_coding", unless(F.abs(f - r) <= preserve), unless(signed_percent(f - r)), none, unless(r), unless(f), late),
    )


def verdict(h3: Column, h4: Column) -> Column:
    """One of five cases, by whether readability (H3) and coding (H4) were kept."""
    return (
        F.when(h3 & h4, "kept readability and coding")
        .when(h3 & ~h4, "kept readability, not coding")
        .when(~h3 & h4, "kept coding, not readability")
        .when(~h3 & ~h4, "kept neither")
        .otherwise("incomplete")
    )
