"""Operator 4, line dedup: fuzzy lines by MinHash over character shingles, one line kept for each component.

Lines end at U+000A. A line is compared by its words in lower case (A-Z) with single spaces; lines
with equal words are one node from the start, so copies cost nothing further. Nodes of ``Q``
bytes or more have the set of their byte shingles of length ``Q`` (characters, for ASCII; a shorter line
would be one shingle, so it is like none but its equals), a MinHash
signature of it in ``BANDS`` bands of ``ROWS`` values (a pair at similarity 0.8 is found with
probability 1 - (1 - 0.8 ** 4) ** 16 > 0.9997), and candidates are verified by the exact
Jaccard similarity of the sets, ``THRESHOLD`` or more. Components of the verified links
are found by distributed union-find (large-star and small-star steps). Of the lines of a
component, over the whole corpus, the one first by (doc_id, line number) is kept.

Blank lines are no copies of each other and stay. Null texts have no lines. Rows with the same id and
text count as one document, whose same lines are kept in each; rows with the same id and
other texts are documents of their own. Null ids come last. ``dedup_text`` drops documents of
whose lines, all non-blank ones were copies, and keeps all other columns. Lines of any length are
compared whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph
from .common import column, cut, mix, pieces, row_key, table

Q = 8
BANDS, ROWS = 16, 4
THRESHOLD = 0.8
#: Lines are hashed about so many shingles at a time.
BLOCK = 1 << 15
#: Copies' places are sent to all tasks up to so many numbers (16 MB); beyond, texts are joined with them by a shuffle.
BROADCAST_LINES = 4_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: A random order of the shingles for each two hashes: the first and the last of a line's shingles in it.
_ODD = (mix(np.arange(1, BANDS * ROWS // 2 + 1, dtype=np.uint64) * _STEP) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def plain_lines(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of each non-blank line of column text, in lower case with single spaces; the line's row, and its number there."""
    line, row, number = [], [], []
    for r, text in enumerate(column(batch, "text").cast(pa.large_binary()).to_pylist()):
        if text:
            for k, part in enumerate(text.lower().split(b"\n")):
                if kept := part.split():
                    line.append(b" ".join(kept))
                    row.append(r)
                    number.append(k)
    return line, np.array(row, np.int64), np.array(number, np.int32)


def nodes(line: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, line), np.uint64, len(line))


def grams(body: np.ndarray) -> np.ndarray:
    if len(body) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray(len(body) - Q + 1, np.uint64, np.ascontiguousarray(body), strides=(1,)).copy()


def band_keys(body: np.ndarray, off: np.ndarray, which: np.ndarray) -> np.ndarray:
    """[lines, bands] hashes of the bands of the given lines, each of Q bytes or more; shingles are hashed in blocks of lines that a CPU's cache holds."""
    first, size = off[which], off[which + 1] - off[which] - Q + 1
    ends = np.empty((len(_ODD), 2, len(which)), np.uint32)
    group = np.cumsum(size) // BLOCK
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(which)]
    for lo, hi in zip(edges[:-1], edges[1:]):
        n = size[lo:hi]
        at = np.cumsum(n) - n
        every = grams(body[first[lo] : first[hi - 1] + size[hi - 1] + Q - 1])
        if int(n.sum()) < len(every):
            every = every[np.repeat(first[lo:hi] - first[lo] - at, n) + np.arange(int(n.sum()))]
        x = (mix(every) >> np.uint64(32)).astype(np.uint32)
        y = np.empty_like(x)
        for i, odd in enumerate(_ODD):
            np.multiply(x, odd, out=y)
            np.minimum.reduceat(y, at, out=ends[i, 0, lo:hi])
            np.maximum.reduceat(y, at, out=ends[i, 1, lo:hi])
    keys = np.empty((len(which), BANDS), np.uint64)
    rows = ends.reshape(BANDS, ROWS, len(which))
    for j in range(BANDS):
        key = np.full(len(which), j + 1, np.uint64) * _STEP
        # two of a band's 32-bit values at a time
        for i in range(0, ROWS, 2):
            key = mix(key ^ (rows[j, i].astype(np.uint64) << np.uint64(32) | rows[j, i + 1]))
        keys[:, j] = key
    return keys


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line, node) of each non-blank line; and of each document, with line -1, how many it has as its node."""

    def run(batches):
        for batch in pieces(batches):
            line, row, number = plain_lines(batch)
            own = pa.array(row)
            names = ["doc_id", "row", "line", "node"]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").take(own), column(batch, "row").take(own), pa.array(number), pa.array(nodes(line).view(np.int64))], names)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "row"), pa.array(np.full(batch.num_rows, -1, np.int32)), pa.array(np.bincount(row, minlength=batch.num_rows))], names)

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, line int, node long")


def _distinct(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    """The distinct nodes of a batch's lines, and their words."""
    line = plain_lines(batch)[0]
    own, once = np.unique(nodes(line), return_index=True)
    return own, [line[k] for k in once.tolist()]


def _links(docs: DataFrame) -> DataFrame:
    """What Buckets yields for the bands of all lines of Q bytes or more; not kept, it goes straight to a shuffle."""

    def run(batches):
        buckets = graph.Buckets()
        for batch in pieces(batches):
            node, line = _distinct(batch)
            size = np.array([len(x) for x in line], np.int64)
            fit = np.flatnonzero(size >= Q)
            if len(fit):
                body = np.frombuffer(b"".join(line), np.uint8)
                yield from buckets.add(band_keys(body, np.concatenate([[0], np.cumsum(size)]), fit).ravel(), np.repeat(node[fit], BANDS))
        yield from buckets.flush()

    return docs.select("text").mapInArrow(run, graph.ROUTE_SCHEMA)


def _texts(docs: DataFrame) -> DataFrame:
    """(node, blob): the lines' words, once for each piece of a batch."""

    def run(batches):
        for batch in pieces(batches):
            node, line = _distinct(batch)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(line, pa.binary())], ["node", "blob"])

    return docs.select("text").mapInArrow(run, "node long, blob binary")


def gram_set(text: bytes) -> np.ndarray:
    """The sorted distinct shingles."""
    g = np.sort(grams(np.frombuffer(text, np.uint8)))
    return g[np.append(True, g[1:] != g[:-1])] if len(g) else g


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, line, first_doc, first_line) of the lines that are copies, with the line that stays for each; and the table _lines gives."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row"))
    every = cut(_lines(docs), "lines")
    lines = every.where("line >= 0")

    def fetch(wanted: DataFrame) -> DataFrame:
        wanted = graph.small(wanted)
        chosen = cut(lines.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row")).select("row").distinct(), "chosen")
        return _texts(docs.join(graph.small(chosen), "row", "left_semi")).join(wanted, "node", "left_semi").groupBy("node").agg(F.min("blob").alias("blob"))

    roots = graph.classes(graph.members(_links(docs), every.count() * BANDS), fetch, gram_set, threshold)
    placed = lines.join(graph.small(roots), "node", "left").select("doc_id", "row", "line", F.coalesce("root", "node").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row", "line")
    many = cut(placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root"), "many")
    shared = cut(placed.join(graph.small(many), "root"), "shared")
    groups = cut(shared.groupBy("root").agg(F.min(order).alias("first")).select("root", F.col("first.doc_id").alias("first_doc"), F.col("first.row").alias("first_row"), F.col("first.line").alias("first_line")), "groups")
    copies = shared.join(graph.small(groups), "root").where("row <> first_row or line <> first_line").select("doc_id", "row", "line", "first_doc", "first_line")
    return copies, every


def dedup_text(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the lines that are copies (n_chars follows, if it is a column), and without documents that were copies only."""
    copies, _ = removed_lines(docs.select("doc_id", "text"), threshold)
    name = "dropped_lines_" + "_" * max(map(len, docs.columns))  # longer than any of docs
    per_doc = cut(copies.groupBy(F.col("row").alias("row_")).agg(F.collect_set("line").alias(name)), "copies")
    if per_doc.agg(F.coalesce(F.sum(F.size(name) + 8), F.lit(0))).first()[0] <= BROADCAST_LINES:
        per_doc = F.broadcast(per_doc)
    schema = docs.schema
    joined = docs.join(per_doc, F.xxhash64(docs["doc_id"].cast("long"), docs["text"]) == per_doc["row_"], "left").select(*(docs[c] for c in schema.names), per_doc[name])

    def run(batches):
        for batch in pieces(batches):
            gone = [drop and set(drop) for drop in batch.column(batch.num_columns - 1).to_pylist()]
            if not any(gone):
                yield batch.select(list(range(len(schema.names))))
                continue
            at, keep = schema.names.index("text"), []
            text = batch.column(at).to_pylist()
            for i, (t, drop) in enumerate(zip(text, gone)):
                left = [x for k, x in enumerate(t.split("\n")) if k not in drop] if drop else None
                keep.append(left is None or any(x.strip(" \t\n\v\f\r") for x in left))
                if left is not None:
                    text[i] = "\n".join(left)
            arrays = list(batch.columns[:-1])
            arrays[at] = pa.array(text, arrays[at].type)
            if "n_chars" in schema.names:
                k = schema.names.index("n_chars")
                arrays[k] = pa.array([len(t) if drop else n for t, drop, n in zip(text, gone, arrays[k].to_pylist())], arrays[k].type)
            yield pa.RecordBatch.from_arrays(arrays, schema.names).filter(pa.array(keep))

    return joined.mapInArrow(run, schema)


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its non-blank lines, how many stay, the numbers of those that go, and for each of them line:doc_id:line of the one that stays."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    copies, lines = removed_lines(docs)
    first = F.concat_ws(":", F.coalesce(F.col("first_doc").cast("string"), F.lit("")), "first_line")
    gone = copies.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("line", first.alias("first")))).alias("gone"))
    gone = gone.select("row", F.size("gone").alias("n_removed"), F.array_join("gone.line", ",").alias("removed_lines"), F.array_join(F.transform("gone", lambda x: F.concat_ws(":", x["line"], x["first"])), ",").alias("copies_of"))
    n = F.col("n_lines")
    return (
        lines.where("line < 0")
        .select("row", "doc_id", F.col("node").alias("n_lines"))
        .join(gone, "row", "left")
        .select("doc_id", n, (n - F.coalesce("n_removed", F.lit(0))).alias("n_kept"), F.coalesce("removed_lines", F.lit("")).alias("removed_lines"), F.coalesce("copies_of", F.lit("")).alias("copies_of"))
    )
