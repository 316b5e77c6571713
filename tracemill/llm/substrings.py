"""Operator 11, substring dedup: word sequences that repeat across documents, found by level-wise doubling.

The first level takes every window of ``WINDOW`` words. Only windows that stand in more than one document are candidates
of the next level, of twice the length: a window there is two adjacent repeated ones, and its hash is made
of theirs. Levels go on until no candidates survive. A word goes if a first-level window over it also starts in a
document with a smaller id; the further levels give how long the repeated passages are.

Documents are gathered in blocks. A block asks for each of its distinct windows once, with the least id that has it,
by ranges of hashes (``exchange``), so copies within a block are one request and a window that stands in many
documents is one request a block. A range answers with two bits a window: another block has it, and another block has it
with a smaller id. A level is one job, from the blocks' windows to the next level's, and its table is deleted once
the next one is written. Texts are carried as compressed blocks and met with the marks at the end.

Null texts have no words. Null ids come last, and as they are equal to each other they take no words from each
other; nor do rows with the same id. Windows don't cross documents, so texts shorter than a window are kept whole. A text of any
length is in one block. Windows are told apart by 64-bit hashes. Columns other than id and text are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _powers, column, cut, flat, mix, pieces, release, shuffles_freed, span_hashes, table, trim, words
from .exchange import edges, numbered, pack, pack_bits, pack_sorted, side, unpack, unpack_bits, unpack_sorted

WINDOW = 13
#: Bytes of text for a word, when the size of blocks is chosen; where words are shorter, blocks have more of them.
WORD_BYTES = 5
LAST_ID = np.int64(2**63 - 1)
_TWICE = np.uint64(0x9E3779B97F4A7C15)


# blocks of documents

_BLOCK = "block long, ids array<long>, sizes array<long>, texts binary"
_BLOCK_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _row(types: list, schema: str, row: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], _names(schema))


def _blocks(docs: DataFrame, most: int) -> DataFrame:
    """Blocks of (doc_id, text) of about most bytes: ids, bytes of each text, and all texts in one."""

    def run(batches):
        task, serial, ids, sizes, parts, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def block():
            texts = pa.compress(np.concatenate(parts).tobytes(), codec="zstd", asbytes=True)
            return _row(_BLOCK_TYPES, _BLOCK, ((task << 24) + serial, ids, sizes, texts))

        for batch in pieces(batches):
            data, off = flat(column(batch, "text"))
            ids += column(batch, "doc_id").to_pylist()
            sizes += np.diff(off).tolist()
            parts.append(data)
            held += len(data)
            if held >= most:
                yield block()
                serial, ids, sizes, parts, held = serial + 1, [], [], [], 0
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _BLOCK)


def texts_of(row: dict) -> Iterator[pa.RecordBatch]:
    """The texts of a block, in pieces."""
    off = np.concatenate([[0], np.cumsum(np.array(row["sizes"], np.int64))])
    raw = pa.decompress(row["texts"], int(off[-1]), codec="zstd")
    yield from pieces([pa.RecordBatch.from_arrays([pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off), raw)], ["text"])])


# windows of a block


class Windows:
    """A block's candidate windows of one length: first words, distinct hashes, and each window's number among these."""

    def __init__(self, ids: list, n: np.ndarray, at: np.ndarray, keys: np.ndarray, number: np.ndarray):
        self.ids = np.array([LAST_ID if i is None else i for i in ids], np.int64)
        self.n, self.at, self.keys, self.number = n, at, keys, number
        self.doc = np.searchsorted(np.cumsum(n) - n, at, "right") - 1
        order = np.argsort(number, kind="stable")
        head = np.flatnonzero(np.diff(number[order].astype(np.int64), prepend=-1))
        doc = self.doc[order]
        none = np.zeros(0, np.int64)
        #: The least id of a document that has the window, and whether several documents of the block do.
        self.least = np.minimum.reduceat(self.ids[doc], head) if len(head) else none
        self.several = doc[head] != doc[np.append(head[1:], len(doc)) - 1] if len(head) else none.astype(bool)


def word_hashes(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The number of words of each document, and all words' hashes."""
    n, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for batch in texts_of(row):
        data, off = flat(column(batch, "text"))
        start, end, doc = words(data, off)
        n.append(np.bincount(doc, minlength=batch.num_rows))
        hashes.append(span_hashes(data, start, end))
    return np.concatenate(n), np.concatenate(hashes)


def first_windows(row: dict, length: int) -> Windows:
    """All windows of so many words."""
    n, h = word_hashes(row)
    power, back = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[:-1], out=total[1:])
    end = np.repeat(np.cumsum(n), n)
    at = np.flatnonzero(np.arange(len(h)) + length <= end)
    keys, _, number = numbered(mix((total[at + length] - total[at]) * back[at]))
    return Windows(row["ids"], n, at, keys, number)


def doubled(w: Windows, survive: np.ndarray, length: int) -> Windows:
    """The windows of twice the length that consist of two surviving ones."""
    kept = np.flatnonzero(survive)
    place = np.full(int(w.n.sum()) + length + 1, -1, np.int64)
    place[w.at[kept]] = kept
    other = place[w.at[kept] + length]
    both = (other >= 0) & (w.doc[other] == w.doc[kept])
    kept, other = kept[both], other[both]
    hashes = w.keys[w.number]
    keys, _, number = numbered(mix(hashes[kept] * _TWICE + mix(hashes[other])))
    return Windows(w.ids.tolist(), w.n, w.at[kept], keys, number)


# levels

_LEVEL = "block long, ids array<long>, n array<long>, marks binary, longest array<long>, n_keys long, n_at long, keys binary, number binary, at binary"
_LEVEL_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), *[pa.binary()] * 3]
_ASK = "range long, block long, size long, keys binary, least binary"
_ASK_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
_ANSWER = "block long, range long, size long, elsewhere binary, smaller binary"
_ANSWER_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def _windows(row: dict, length: int | None) -> Windows:
    """Those of a block (length: of its texts) or of a level's row."""
    if length:
        return first_windows(row, length)
    keys, number, at = unpack_sorted(row["keys"], row["n_keys"]), unpack(row["number"], row["n_at"], np.uint32), unpack_sorted(row["at"], row["n_at"], np.int64)
    return Windows(row["ids"], np.array(row["n"], np.int64), at, keys, number)


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        trim()
        for k in range(batch.num_rows):
            yield {x: batch.column(i)[k].as_py() for i, x in enumerate(batch.schema.names)}


def _asked(source: DataFrame, length: int | None, ranges: int) -> DataFrame:
    cuts = edges(ranges)

    def run(batches):
        for row in _rows(batches):
            w = _windows(row, length)
            at = [0, *np.searchsorted(w.keys, cuts).tolist(), len(w.keys)]
            rows = [(k, row["block"], b - a, pack_sorted(w.keys[a:b]), pack(w.least[a:b])) for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if a < b]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ASK_TYPES)], _names(_ASK))

    return source.mapInArrow(run, _ASK)


def _answer(asked: pa.Table) -> pa.Table:
    """For each key of each request: whether another request has it, and whether one has it with a smaller id."""
    rows = asked.to_pylist()
    keys = np.concatenate([unpack_sorted(r["keys"], r["size"]) for r in rows])
    least = np.concatenate([unpack(r["least"], r["size"], np.int64) for r in rows])
    order = np.argsort(keys)
    ordered = keys[order]
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(head, len(keys)))
    elsewhere, smaller = np.empty(len(keys), bool), np.empty(len(keys), bool)
    elsewhere[order] = np.repeat(size > 1, size)
    smaller[order] = np.repeat(np.minimum.reduceat(least[order], head), size) < least[order]
    end = np.cumsum([r["size"] for r in rows])
    found = [(r["block"], r["range"], r["size"], pack_bits(elsewhere[b - r["size"] : b]), pack_bits(smaller[b - r["size"] : b])) for r, b in zip(rows, end.tolist())]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*found), _ANSWER_TYPES)], names=_names(_ANSWER))


def covered(w: Windows, taken: np.ndarray, length: int) -> np.ndarray:
    """Whether each word of the block is in one of the taken windows."""
    step = np.zeros(int(w.n.sum()) + 1, np.int64)
    np.add.at(step, w.at[taken], 1)
    np.add.at(step, w.at[taken] + length, -1)
    return np.cumsum(step[:-1]) > 0


def _met(first: bool, length: int):
    def run(source: pa.Table, answers: pa.Table) -> pa.Table:
        trim()
        row = source.to_pylist()[0]
        w = _windows(row, length if first else None)
        parts = answers.sort_by("range").to_pylist()
        bits = lambda name: np.concatenate([np.zeros(0, bool), *(unpack_bits(r[name], r["size"]) for r in parts)])
        elsewhere, smaller = bits("elsewhere"), bits("smaller")
        if len(elsewhere) != len(w.keys):
            raise RuntimeError("answers don't fit their block")
        again = smaller[w.number] | (w.least[w.number] < w.ids[w.doc])
        longest = np.zeros(len(w.n), np.int64) if first else np.array(row["longest"], np.int64)
        longest[w.doc[again]] = length
        marks = pack_bits(covered(w, again, length)) if first else row["marks"]
        new = doubled(w, (elsewhere | w.several)[w.number], length)
        values = (row["block"], row["ids"], w.n.tolist(), marks, longest.tolist(), len(new.keys), len(new.at), pack_sorted(new.keys), pack(new.number), pack_sorted(new.at))
        return pa.table([pa.array([x], t) for x, t in zip(values, _LEVEL_TYPES)], names=_names(_LEVEL))

    return run


def find(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Blocks of (doc_id, text), and the marks of the words to remove; both are tables in the shared folder."""
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    size = side(total // WORD_BYTES)
    blocks = cut(_blocks(docs, size * WORD_BYTES), "blocks")
    level, length, asked = None, window, total // WORD_BYTES
    with shuffles_freed(docs.sparkSession):
        while level is None or asked:
            source, first = (blocks, True) if level is None else (level, False)
            requests = _asked(source, length if first else None, max(1, -(-asked // size)))
            answers = requests.groupBy("range").applyInArrow(_answer, _ANSWER)
            if first:  # most of all requests: their shuffle files go before blocks are met
                answers = cut(answers, "answers")
            done = level
            level = cut(source.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_met(first, length), _LEVEL), f"windows-{length * 2}")
            release(answers if first else done)
            asked = level.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
            length *= 2
    return blocks, level


_KEPT = "doc_id long, n_words long, n_removed long, longest long, removed array<struct<start:long,end:long>>, kept string"


def _kept(blocks: pa.Table, levels: pa.Table) -> pa.Table:
    trim()
    row, found = blocks.to_pylist()[0], levels.to_pylist()[0]
    n = np.array(found["n"], np.int64)
    gone = unpack_bits(found["marks"], int(n.sum()))
    texts, at = [], 0
    for batch in texts_of(row):
        data, off = flat(column(batch, "text"))
        start, end, doc = words(data, off)
        kept = ~gone[at : at + len(start)]
        at += len(start)
        texts.append(joined(data, start[kept], end[kept], doc[kept], batch.num_rows))
    first = np.cumsum(n) - n
    before = np.concatenate([[0], np.cumsum(gone)])
    spans = [_spans(gone[a : a + k]) for a, k in zip(first.tolist(), n.tolist())]
    values = [pa.array(row["ids"], pa.int64()), pa.array(n), pa.array(before[first + n] - before[first]), pa.array(found["longest"], pa.int64())]
    values += [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.concat_arrays(texts)]
    return pa.table(values, names=["doc_id", "n_words", "n_removed", "longest", "removed", "kept"])


def _spans(gone: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
    return [{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2])]


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, docs: int) -> pa.Array:
    """Each document's words with one space between."""
    last = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
    size = end - start + ~last
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - off[:-1], size) + np.arange(off[-1])
    out = np.append(data, np.uint8(32))[at]
    out[off[1:][~last] - 1] = 32
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc, size, docs).astype(np.int64))])
    return pa.LargeStringArray.from_buffers(docs, pa.py_buffer(ends), pa.py_buffer(out)).cast(pa.string())


def rebuilt(blocks: DataFrame, levels: DataFrame) -> DataFrame:
    """Each document's kept words, the removed spans of words, and the longest level at which it repeats an earlier one."""
    return blocks.groupBy("block").cogroup(levels.select("block", "n", "marks", "longest").groupBy("block")).applyInArrow(_kept, _KEPT)


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents (doc_id, text) without the words of repeated windows."""
    return rebuilt(*find(docs, window))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, levels = find(table(spark, sf_dir, "documents"))
    digests = rebuilt(blocks, levels).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "longest")
    with shuffles_freed(spark):
        found = cut(digests, "kept")
    release(blocks, levels)
    return found


def _oracle(levels: int = 12) -> str:
    """longest: the largest of 13, 26, 52, ... words for which a window of the document also starts in one with a smaller id."""
    of = """SELECT r, k, p, dense_rank() OVER (ORDER BY {key}) AS c, min(k) OVER (PARTITION BY {key}) < k AS again,
         min(r) OVER (PARTITION BY {key}) < max(r) OVER (PARTITION BY {key}) AS survives FROM {source}"""
    parts = [f"w13 AS ({of.format(key='key', source='first')})"]
    for length in (WINDOW * 2**j for j in range(levels)):
        pairs = f"""(SELECT x.r, x.k, x.p, x.c AS c1, y.c AS c2 FROM w{length} x JOIN w{length} y ON x.r = y.r AND y.p = x.p + {length}
         WHERE x.survives AND y.survives)"""
        parts.append(f"w{length * 2} AS ({of.format(key='c1, c2', source=pairs)})")
    longest = " UNION ALL ".join(f"SELECT r, {WINDOW * 2**j} AS n FROM w{WINDOW * 2**j} WHERE again" for j in range(levels + 1))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
places AS (SELECT r, k, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d),
first AS (SELECT r, k, p, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS key FROM places),
{", ".join(parts)},
gone AS (SELECT DISTINCT r, unnest(range(p, p + {WINDOW})) AS p FROM w13 WHERE again),
every AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM every ANTI JOIN gone USING (r, p) GROUP BY r),
counted AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
longest AS (SELECT r, max(n) AS n FROM ({longest}) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(counted.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256,
       CAST(coalesce(longest.n, 0) AS BIGINT) AS longest
FROM d LEFT JOIN kept USING (r) LEFT JOIN counted USING (r) LEFT JOIN longest USING (r)
"""


ORACLE_SQL = _oracle()
