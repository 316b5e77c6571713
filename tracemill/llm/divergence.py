"""Operator 13, source divergence audit: how far the term shares of each source of a language lie from the others'.

Terms are runs of letters (ASCII ones as lower case) and of code points from U+0080 on. A language keeps the terms that
at least ``DOCUMENTS`` of its documents hold. A group is a language's source; its share of a kept term, in billionths,
comes from its count with one added to each, and all arithmetic is on integers.

Tasks count terms of (language, source) over all pieces they read, and only these counts are shuffled, by language and term,
so no row stands for an occurrence and a frequent term is at most a row a task and source. A partition's rows
come in term order. It cuts them into chunks: a sorted array of kept terms, whose places are the terms' integer ids (searchsorted), and
one dense count vector a source (bincount). A chunk has at most ``CELLS`` counts, so its width shrinks as sources grow.
With the sums over all chunks known, each chunk gives its part of every pair's divergence and its own leading
terms, where ids break ties, since they have the order of the terms' bytes. The parts are added up, and the leading terms
of all chunks ranked.

Null text, language or source is an empty one. Repeated rows count each. A language with no kept terms still gives its
pairs, with value 0; one with a single source gives no pairs. A text of any length is read whole, and a term of any
length is one term. Within a piece terms are told apart by 64-bit hashes, between pieces by themselves. Columns
other than these three are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, column, cut, flat, pieces, release, span_hashes, table, trim, words
from .exchange import numbered, pack, unpack

DOCUMENTS = 3
TOP = 200
SCALE_STEPS, SCALE_STEP = 3, 1000
PIECE_BYTES = 1 << 22
#: Rows of counts that a task holds, and counts of a chunk.
ROWS, CELLS = 1 << 20, 1 << 20
#: A language's sums are dealt to so many parts, so that its chunks need not meet in one task.
SALT = 16
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_KEYS = ["lang", "source", "term"]
_COUNTS = "lang string, source string, term string, n long, docs long"


# counts


def spans_as_strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans' bytes as a string array."""
    size = end - start
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - off[:-1], size) + np.arange(off[-1])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))).cast(pa.string())


def tally(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of each term of each (lang, source) of a piece."""
    data, off = flat(column(batch, "text"))
    low = LOWER[data]
    start, end, doc = words(low, off, BETWEEN)
    own, place, number = numbered(span_hashes(low, start, end))
    width = max(len(own), 1)
    lang, source = (column(batch, x).dictionary_encode() for x in ("lang", "source"))
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    held, n = np.unique(doc * width + number, return_counts=True)
    code = group[held // width] * width + held % width
    order = np.argsort(code, kind="stable")
    code = code[order]
    head = np.flatnonzero(np.diff(code, prepend=-1))
    at, docs = code[head], np.diff(np.append(head, len(code)))
    n = np.add.reduceat(n[order], head) if len(head) else n
    terms = spans_as_strings(low, start[place], end[place])
    g = at // width
    values = [lang.dictionary.take(pa.array(g // len(source.dictionary))), source.dictionary.take(pa.array(g % len(source.dictionary))), terms.take(pa.array(at % width)), pa.array(n), pa.array(docs)]
    return pa.table(values, names=[x.split()[0] for x in _COUNTS.split(", ")])


def added(tables: list[pa.Table]) -> pa.Table:
    """One row a (lang, source, term)."""
    found = pa.concat_tables(tables).group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return found.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns([*_KEYS, "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in pieces(batches, limit=PIECE_BYTES):
        held.append(tally(batch))
        rows += held[-1].num_rows
        if rows > ROWS:
            held = [added(held)]
            rows = held[0].num_rows
            if rows > ROWS // 2:
                yield from held[0].to_batches(max_chunksize=1 << 15)
                held, rows = [], 0
    if held:
        yield from added(held).to_batches(max_chunksize=1 << 15)


# chunks

_CHUNK = "lang string, terms array<string>, sources array<string>, sums array<long>, counts binary"
_CHUNK_TYPES = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]


def dense(rows: pa.Table, least: int, width: int) -> Iterator[tuple]:
    """Chunks of one language's counts (each term's rows complete): terms in byte order, sources, their sums, and [source, term] counts."""
    per_term = rows.group_by("term", use_threads=False).aggregate([("docs", "sum")])
    kept = np.array(sorted(x.encode() for x in per_term.filter(pc.greater_equal(per_term["docs_sum"], least))["term"].to_pylist()), dtype=object)
    if not len(kept):
        return
    term = np.array([x.encode() for x in rows["term"].to_pylist()], dtype=object)
    ids = np.searchsorted(kept, term)
    held = ids < len(kept)
    held[held] = kept[ids[held]] == term[held]
    source = rows["source"].combine_chunks().dictionary_encode()
    names, which, n = source.dictionary, source.indices.to_numpy()[held].astype(np.int64), rows["n"].to_numpy()[held]
    ids = ids[held]
    for a in range(0, len(kept), width):
        b = min(a + width, len(kept))
        here = (ids >= a) & (ids < b)
        # one row a source and term, so that weights below 2**53 are kept exactly
        counts = np.bincount(which[here] * (b - a) + ids[here] - a, n[here], len(names) * (b - a)).astype(np.int64).reshape(len(names), b - a)
        yield [x.decode() for x in kept[a:b]], names.to_pylist(), counts.sum(axis=1).tolist(), counts


def _chunked(least: int, width: int):
    names = [x.split()[0] for x in _CHUNK.split(", ")]

    def rows_of(table_: pa.Table) -> Iterator[pa.RecordBatch]:
        for lang in pc.unique(table_["lang"]).to_pylist():
            for terms, sources, sums, counts in dense(table_.filter(pc.equal(table_["lang"], lang)), least, width):
                row = (lang, terms, sources, sums, pack(counts.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _CHUNK_TYPES)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        held, rows = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows > ROWS // 4:
                last = held[-1].slice(batch.num_rows - 1)
                held = [added(held)]
                # the last term may go on in the next batch
                open_ = pc.and_(pc.equal(held[0]["lang"], last["lang"][0]), pc.equal(held[0]["term"], last["term"][0]))
                yield from rows_of(held[0].filter(pc.invert(open_)))
                held = [held[0].filter(open_)]
                rows = held[0].num_rows
        if held:
            yield from rows_of(added(held))

    return run


def chunks(docs: DataFrame, least: int = DOCUMENTS, width: int = CELLS) -> DataFrame:
    """Chunks of at most width kept terms of (text, lang, source) rows without nulls."""
    counts = docs.select("text", "lang", "source").mapInArrow(_counted, _COUNTS)
    return counts.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_chunked(least, width), _CHUNK)


# divergences


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / total), by long division in steps of three digits."""
    if total >= 2**63 // SCALE_STEP:
        counts = counts.astype(object)
    whole, rest = (counts + 1) // total, (counts + 1) % total
    for _ in range(SCALE_STEPS):
        rest = rest * SCALE_STEP
        whole, rest = whole * SCALE_STEP + rest // total, rest % total
    return (whole + 1).astype(np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


_VALUE = "lang string, source string, part string, item string, value long"


def _valued(top: int):
    names = [x.split()[0] for x in _VALUE.split(", ")]

    def rows(lang, source, part, item, value):
        n = len(value)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array([part] * n, pa.string()), item, pa.array(value, pa.int64())], names)

    def chunk(lang, terms, sources, blob, groups, sizes, vocabulary):
        n = len(terms)
        counts = np.zeros((len(groups), n), np.int64)
        if n:
            place = {x: k for k, x in enumerate(groups)}
            counts[[place[x] for x in sources]] = unpack(blob, len(sources) * n, np.int64).reshape(len(sources), n)
        p = np.stack([shares(c, size + vocabulary) for c, size in zip(counts, sizes)]) if n else np.ones((len(groups), 0), np.int64)
        q = shares(counts.sum(axis=0), sum(sizes) + vocabulary) if n else np.ones(0, np.int64)
        every = np.arange(len(groups))
        for k, name in enumerate(groups):
            others = every[every != k]
            for a in range(0, len(others), 1 << 12):
                some = others[a : a + (1 << 12)]
                yield rows(lang, [name] * len(some), "pair", pa.array([groups[j] for j in some], pa.string()), divergence(p[k], p[some]).sum(axis=1))
            over = np.flatnonzero((counts[k] > 0) & (p[k] > q))
            value = divergence(p[k][over], q[over])
            best = np.lexsort((over, -value))[:top]
            if len(best):
                yield rows(lang, [name] * len(best), "term", terms.take(pa.array(over[best])), value[best])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            for k in range(batch.num_rows):
                at = lambda name: column(batch, name)[k]  # noqa: B023, E731
                yield from chunk(at("lang").as_py(), at("terms").values, at("sources").as_py(), at("counts").as_py(), at("groups").as_py(), at("sizes").as_py(), at("vocabulary").as_py())

    return run


def audit(docs: DataFrame, least: int = DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of (text, lang, source): pairs of sources, and each source's leading terms."""
    docs = docs.select(*(F.coalesce(x, F.lit("")).alias(x) for x in ("text", "lang", "source")))
    groups = cut(docs.select("lang", "source").distinct(), "groups")
    most = groups.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    found = cut(chunks(docs, least, max(1, CELLS // most)), "chunks")
    held = found.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("n"))
    sizes = groups.join(held, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"))
    terms = found.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    sums = sizes.join(terms, "lang", "left").select("lang", F.col("g.source").alias("groups"), F.col("g.n").alias("sizes"), F.coalesce("v", F.lit(0)).alias("vocabulary"))
    # a chunk without terms gives each pair of a language at least a zero
    bare = groups.select("lang").distinct().select("lang", *(F.array().cast(f"array<{t}>").alias(x) for x, t in (("terms", "string"), ("sources", "string"), ("sums", "long"))), F.lit(b"").alias("counts"))
    salt = F.pmod(F.xxhash64("lang", F.get("terms", F.lit(0))), F.lit(SALT)).alias("salt")
    met = found.unionByName(bare).select("*", salt).join(sums.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt")), ["lang", "salt"])
    values = cut(met.drop("salt", "sums").mapInArrow(_valued(top), _VALUE), "values")
    release(groups, found)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = values.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).select("*", rank)
    leading = values.where("part = 'term'").select("*", rank).where(F.col("rank") <= top)
    return pairs.unionByName(leading)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (
  SELECT x.lang, x.source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS n
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c ON x.lang = c.lang AND x.source = c.source GROUP BY x.lang, x.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS p
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (
  SELECT p.lang, p.term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(p.n) + 1)) // (any_value(t.n) + any_value(v.v)) AS q
  FROM p JOIN v ON v.lang = p.lang JOIN (SELECT lang, sum(n) AS n FROM g GROUP BY lang) t ON t.lang = p.lang GROUP BY p.lang, p.term),
values_ AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source) f
    ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q)) // q.q
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM values_)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
