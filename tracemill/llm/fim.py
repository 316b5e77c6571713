"""Operator 12, fill-in-the-middle: texts cut at unit borders into prefix, middle and suffix, and put in another order.

A unit is a run of ASCII letters or one other code point, so units tile a text. An Arrow-batched pandas UDF
goes over a text once with the regex library's finditer and keeps the units' end offsets in an array of four
bytes each; the two cuts are then two lookups, and the parts are slices. SHA-256 of the seed and the id gives
the draws: the cuts, whether a text stays plain, and the order of the parts.

A text is without markers or it stays plain, and no marker can begin inside another, so the first marker of
each kind in an output is the one that was put there: ``restore`` gives the exact text from output and form.

Null texts are empty, and an empty text is plain. A null id is drawn for as an empty one. Draws depend on the id
alone, so repeated rows give repeated results. A text of any length is cut whole: four bytes a unit are held
beside it. Columns other than id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import table

UNIT = regex.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
SEED = 1
#: Percent of the texts that are cut, and percent of those that begin with the suffix.
CUT, SUFFIX_FIRST = 90, 20
CUT_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def unit_ends(text: str) -> array:
    """The offset after each unit."""
    return array("I", (m.end() for m in UNIT.finditer(text)))


def draws(seed_and_id: str) -> list[int]:
    """Four numbers below 2**32."""
    digest = hashlib.sha256(seed_and_id.encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def cut_text(text: str, drawn: list[int], rate: int = CUT, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """The values of CUT_SCHEMA for one text."""
    ends = unit_ends(text)
    n = len(ends)
    if not n or drawn[2] % 100 >= rate or any(m in text for m in MARKERS):
        return n, "plain", None, None, text
    a, b = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (a, b))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if drawn[3] % 100 < suffix_first:
        return n, "spm", a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(output: str, form: str) -> str:
    """The text that cut_text took."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, rest = output[len(first) :].split(second, 1)
    tail, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (head, tail) if form == "psm" else (tail, head)
    return prefix + middle + suffix


def _cut_texts(rate: int, suffix_first: int) -> Callable:
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in CUT_SCHEMA.split(", ")]
        for key, text in parts:
            found = pd.DataFrame([cut_text(t, draws(k), rate, suffix_first) for k, t in zip(key, text)], columns=names)
            yield found.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return run


def _digest_texts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for output, form in parts:
        yield pd.DataFrame({"output_sha256": [sha(x) for x in output], "restored_sha256": [sha(restore(x, f)) for x, f in zip(output, form)]})


def _restore_texts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for output, form in parts:
        yield pd.Series([restore(x, f) for x, f in zip(output, form)], dtype=object)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of."""
    return pandas_udf(_restore_texts, "string")(output, form)


def digests(output: str = "output", form: str = "form") -> Column:
    """SHA-256 of each output, and of the text that is restored from it."""
    return pandas_udf(_digest_texts, "output_sha256 string, restored_sha256 string")(output, form)


def transform(docs: DataFrame, seed: int = SEED, rate: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of (doc_id, text)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    found = docs.select("doc_id", pandas_udf(_cut_texts(rate, suffix_first), CUT_SCHEMA)(key, F.coalesce("text", F.lit(""))).alias("cut"))
    return found.select("doc_id", "cut.*")


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("digest", digests()).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "digest.*")


ORACLE_SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS whole, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s
  FROM documents),
drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4
  FROM units),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN whole = '' OR contains(whole, '<P>') OR contains(whole, '<S>') OR contains(whole, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix
  FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN whole WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(whole) AS restored_sha256
FROM parts
"""
