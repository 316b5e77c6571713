"""Text functions with Unicode white-space and word classes spelled out.

Java's ``\\s``, ``\\w`` and ``\\Z`` and Spark's ``trim`` cover other characters
than the usual scripting-language ones; these helpers name the classes, so that
results don't depend on the engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: ASCII, U+001C to U+001F, U+0085 and the separators.
WS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
#: Word characters: letters, numbers and the low line.
WORD = r"[\p{L}\p{N}_]"
#: Line ends: CR LF, or one of LF, VT, FF, CR, U+001C to U+001E, U+0085, U+2028, U+2029.
LINE_END = r"\r\n|[\n\x{0b}\x{0c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, however often body names it (also inside other lambdas)."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+\\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+\\z", "")


def splitlines(c: Column) -> Column:
    """Lines without their ends; a final line end opens no further line; '' has none."""
    cut = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return let(F.split(c, LINE_END, -1), cut)


def ws_tokens(c: Column) -> Column:
    """The parts between runs of white space."""
    return F.filter(F.split(c, f"{WS}+", -1), lambda t: t != "")


def word_tokens(c: Column) -> Column:
    """The runs of word characters of the text in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"{WORD}+"), F.lit(0))


def filled(*cols: Column) -> Column:
    """The first that is neither null nor ''; else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols), F.lit(""))


def first_items(*cols: Column) -> Column:
    """The first array that is neither null nor empty, else the last one, an empty array where null."""
    empty = F.slice(cols[-1], 1, 0)
    return F.coalesce(*(F.when(F.size(c) > 0, c) for c in cols), empty, F.array().cast("array<string>"))


def truthy(c: Column) -> Column:
    return F.lower(c).isin("1", "true", "t", "yes", "y")


def numeric_id(c: Column) -> Column:
    """The number at the end of an id ('mbpp_7', 'Mbpp/7', '7'); null without one."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, "\n\\z", ""), r"(\d+)\z", 1), F.lit("")).try_cast("bigint")


def normal_stdout(c: Column) -> Column:
    """Each line without trailing white space, and no empty lines at the end."""
    lines = F.transform(splitlines(c), rstrip)
    return F.regexp_replace(F.array_join(lines, "\n"), "\n+\\z", "")


def signed_percent(delta: Column) -> Column:
    """'+8%' if within 1e-9 of a whole percentage, else one decimal; signed, zero as plus."""
    p = delta * 100.0
    sign = F.when(p >= 0, "+").otherwise("")
    # bround of the exact decimal expansion rounds the binary value half to even
    return F.when(F.abs(p - F.rint(p)) < 1e-9, F.concat(sign, F.rint(p).cast("bigint").cast("string"), F.lit("%"))).otherwise(F.concat(sign, one_decimal(p), F.lit("%")))


def signed_one(delta: Column) -> Column:
    return F.concat(F.when(delta >= 0, "+").otherwise(""), one_decimal(delta))


def one_decimal(x: Column) -> Column:
    """x with one decimal. A tie in binary (.25, .75) goes to the even digit, as its exact value says; other values round as written."""
    tie = F.abs(x * 20) % 2 == 1
    exact = tie & (x * 4 == F.rint(x * 4))
    even = F.format_string("%.1f", F.rint(x * 10) / 10)
    plain = F.format_string("%.1f", x)
    return F.when(exact, even).otherwise(plain)
