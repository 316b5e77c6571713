"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontam, divergence, fim, langid, lines, lm, media, mixing, neardup, pii, secrets, substrings, toxicity


def queries() -> dict:
    return {
        "op1_neardup": neardup.op1_neardup,
        "op2_langid": langid.op2_langid,
        "op3_mixing": mixing.op3_mixing,
        "op4_lines": lines.op4_lines,
        "op5_pii": pii.op5_pii,
        "op6_decontam": decontam.op6_decontam,
        "op7_lm": lm.op7_lm,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_secrets": secrets.op9_secrets,
        "op10_media": media.op10_media,
        "op11_substrings": substrings.op11_substrings,
        "op12_fim": fim.op12_fim,
        "op13_divergence": divergence.op13_divergence,
    }


def oracle_sql() -> dict:
    return {"op11_substrings": substrings.ORACLE_SQL, "op12_fim": fim.ORACLE_SQL, "op13_divergence": divergence.ORACLE_SQL}
