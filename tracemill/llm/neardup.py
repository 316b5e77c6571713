"""Operator 1, MinHash near-dedup: BagMinHash signatures, banding, and exact verification of multiset overlap.

A document is the multiset of its shingles of ``SHINGLE`` words (A-Z as a-z); one with
fewer words is one shingle. A shingle of weight w stands for the levels 0 to w - 1,
cut at powers of two into blocks; each block is a Poisson process whose points carry a
time, a level and a register, so that documents that share a level share its points. A
register keeps the first point of its document's levels. Points are made in order of time
and only while they can still lower a register, so a long document needs about one
for each shingle. Two documents' registers agree with the probability of their weighted
Jaccard similarity, without bias.

``BANDS`` bands of ``ROWS`` registers find a pair at similarity 0.8 with probability
1 - (1 - 0.8 ** 5) ** 20 > 0.999. Candidates are verified: sum of minima over sum of maxima of
the shingles' counts is ``THRESHOLD`` or more. Documents with the same words are one node
from the start. Classes are the connected components of the verified links.

Null texts and texts without words are classes of their own. Rows with the same id and text count as
one document; rows with the same id and other texts are compared like any others. The class id is the
least doc_id of the class, nulls last (null if the class has none). Texts of any length are compared
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph
from .common import LOWER, column, cut, flat, mix, one_each, pieces, release, row_key, span_hashes, table, unit, words

SHINGLE = 5
BANDS, ROWS = 20, 5
THRESHOLD = 0.8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and document of each shingle, and a hash of the words of each document (0: no words)."""
    low = LOWER[data]
    start, end, doc = words(low, off)
    h = span_hashes(low, start, end)
    n = np.bincount(doc, minlength=len(off) - 1)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    place = np.arange(len(h)) - first[doc] if len(h) else np.zeros(0, np.int64)
    node = np.zeros(len(n), np.uint64)
    some = n > 0
    if some.any():
        node[some] = mix(np.add.reduceat(mix(h + place.astype(np.uint64) * _STEP), first[some]) ^ n[some].astype(np.uint64))
    whole = np.zeros(len(h), np.uint64)
    for j in range(k):
        take = h[j:] if j else h
        part = np.zeros(len(h), np.uint64)
        inside = place[: len(take)] + j < n[doc[: len(take)]]
        part[: len(take)] = np.where(inside, mix(take + np.full(1, j + 1, np.uint64) * _STEP), 0)
        whole += part
    start_of = (place + k <= n[doc]) | (place == 0) if len(h) else np.zeros(0, bool)
    return mix(whole[start_of]), doc[start_of], node


def counted(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, key) and their counts, by document and key."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    head = np.ones(len(key), bool)
    head[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    return key[at], doc[at], np.diff(np.append(at, len(key)))


def bag_minhash(key: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """[docs, m] hashes of the points that the registers keep (0 for documents without elements)."""
    parts = [(key, doc, weight, np.zeros(len(key), np.int64), np.ones(len(key), np.int64))]
    low = 1
    while len(key) and weight.max() > low:
        more = weight > low
        parts.append((key[more], doc[more], weight[more], np.full(more.sum(), low), np.full(more.sum(), low)))
        low *= 2
    key, doc, weight, floor, width = (np.concatenate(x) for x in zip(*parts))
    seed = mix(key + mix(floor.astype(np.uint64) + _STEP))
    time = np.zeros(len(key))
    regs = np.full(docs * m, np.inf)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = 0
    while len(seed):
        step += 1
        point = mix(seed + np.full(1, step, np.uint64) * _STEP)
        time = time - np.log(unit(point)) / width
        again = mix(point)
        level = floor + ((again >> np.uint64(40)).astype(np.int64) * width >> 24)
        place = doc * m + (again % np.uint64(m)).astype(np.int64)
        good = (level < weight) & (time < regs[place])
        np.minimum.at(regs, place[good], time[good])
        kept.append((place[good], time[good], point[good]))
        most = regs.reshape(docs, m).max(axis=1)
        live = time < most[doc]
        seed, time, doc, weight, floor, width = (x[live] for x in (seed, time, doc, weight, floor, width))
    out = np.zeros(docs * m, np.uint64)
    for place, t, point in kept:
        own = t == regs[place]
        out[place[own]] = point[own]
    return out.reshape(docs, m)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """[docs, bands] hashes of the bands."""
    keys = np.zeros((len(signature), bands), np.uint64)
    for j in range(bands):
        keys[:, j] = np.full(1, j + 1, np.uint64) * _STEP
        for i in range(rows):
            keys[:, j] = mix(keys[:, j] ^ signature[:, j * rows + i])
    return keys


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, row, node) of each document, and what Buckets yields (route, id, key)."""
    names = ["doc_id", "row", "node", "route", "id", "key"]

    def run(batches):
        buckets = graph.Buckets()
        for batch in pieces(batches):
            key, doc, node = shingles(*flat(column(batch, "text")))
            some = np.unique(node, return_index=True)[1]
            some = np.sort(some[node[some] > 0])
            void = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "row"), pa.array(node.view(np.int64), mask=node == 0), void, void, void], names)
            # texts with the same words are signed once
            place = np.full(len(node), -1)
            place[some] = np.arange(len(some))
            own = place[doc] >= 0
            signature = bag_minhash(*counted(key[own], place[doc[own]]), len(some), bands * rows)
            for out in buckets.add(band_keys(signature, bands, rows).ravel(), np.repeat(node[some], bands)):
                yield lift(out)
        for out in buckets.flush():
            yield lift(out)

    def lift(batch: pa.RecordBatch) -> pa.RecordBatch:
        void = pa.nulls(batch.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([void, void, void, *batch.columns], names)

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, node long, " + graph.ROUTE_SCHEMA)


def _sets(docs: DataFrame) -> DataFrame:
    """(node, blob): the sorted hashes of (shingle, occurrence), which make a multiset a set."""

    def run(batches):
        for batch in pieces(batches):
            key, doc, node = shingles(*flat(column(batch, "text")))
            key, doc, count = counted(key, doc)
            first = np.cumsum(count) - count
            which = np.repeat(np.arange(len(key)), count)
            nth = (np.arange(len(which)) - first[which]).astype(np.uint64)
            value, owner = mix(key[which] ^ nth * _STEP), doc[which]
            order = np.lexsort((value, owner))
            value, bounds = value[order], np.searchsorted(owner[order], np.arange(len(node) + 1))
            blobs = [value[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64), mask=node == 0), pa.array(blobs, pa.binary())], ["node", "blob"])

    return docs.select("text").mapInArrow(run, "node long, blob binary").where("node is not null")


def _placed(docs: DataFrame, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, root) of every row of docs, a table, and of each root of two rows or more its first row, (root, class_id, class_row, class_size)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row"))
    signed = cut(_signed(docs, bands, rows), "signed")
    nodes = signed.where("route is null").select("doc_id", "row", "node")

    def fetch(wanted: DataFrame) -> DataFrame:
        one = cut(nodes.where("node is not null").join(graph.small(wanted), "node", "left_semi").groupBy("node").agg(F.min("row").alias("row")).select("row").distinct(), "chosen")
        return _sets(docs.join(graph.small(one), "row", "left_semi")).groupBy("node").agg(F.min("blob").alias("blob"))

    dealt = signed.where("route is not null").select("route", "id", "key")
    root = graph.classes(graph.members(dealt, dealt.count()), fetch, lambda blob: np.frombuffer(blob, np.uint64), threshold)
    placed = cut(nodes.join(graph.small(root), "node", "left").select("doc_id", "row", F.coalesce("root", "node").alias("root")), "placed")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")
    groups = placed.where("root is not null").groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("class_size")).where("class_size > 1")
    groups = cut(groups.select("root", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("class_row"), "class_size"), "groups")
    release(signed, root)
    return placed, groups


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, class_size) of every row of (doc_id, text)."""
    placed, groups = _placed(docs, threshold, bands, rows)
    return placed.join(graph.small(groups), "root", "left").select("doc_id", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that have an earlier one, by doc_id, in their class; of rows that share id and text one stays. All columns stay."""
    placed, groups = _placed(docs.select("doc_id", "text"), threshold, BANDS, ROWS)
    repeated = cut(placed.where("root is not null").groupBy(F.col("row").alias("row_")).count().where("count > 1").select("row_"), "repeated")
    if not repeated.isEmpty():
        docs = one_each(docs, repeated)
    gone = graph.small(cut(placed.join(graph.small(groups), "root").where("row <> class_row").select(F.col("row").alias("row_")).distinct(), "gone"))
    return docs.join(gone, F.xxhash64(docs["doc_id"].cast("long"), docs["text"]) == gone["row_"], "left_anti")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
