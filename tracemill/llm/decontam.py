"""Operator 6, benchmark decontamination: q-gram lemma filtering in diagonal bands, verified by banded alignment.

Texts are compared in lower case with runs of white space as one space; places are in the lower-cased text. A passage of
n bytes may have e = ``EDITS`` * n edits; then a document that holds it shares at least
n - Q + 1 - Q e of its q-grams, on diagonals (document place minus passage place) that differ
by e at most. Each shared q-gram is counted in two overlapping bands of 2 (e + 1)
diagonals, so such a set is in one band whole; bands that reach the bound are verified by
a banded alignment of the whole passage against the region. The result is a row for each
document and passage found, with the least distance.

The passages are sent to all tasks in blocks of about ``BLOCK_BYTES``, chosen by a hash
of item_id and text; each block is matched against all rows. A passage for which the bound would be under 1 (fewer
than 16 bytes, about) is matched without edits, and not where it would begin or end inside a word (of letters and
digits, in any script); one of fewer than Q bytes by its bytes alone, in windows of its length. Null and empty texts and
passages match nothing; a passage without an id is found with a null item_id; repeated documents are found each, repeated
passages once. Of a passage's matches in a document the one of the least distance counts, the first of those. Texts of
any length are searched whole; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, column, flat, pieces, table

Q = 8
EDITS = 0.08
#: Postings that are expanded at a time.
HITS = 1 << 21
BLOCK_BYTES = 8 << 20
_BITS = 22


def normal(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with single spaces, the documents' offsets in them, and each byte's place in data."""
    if not len(data):
        return data, off.copy(), np.zeros(0, np.int64)
    space = IS_SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    heads = off[:-1][off[:-1] < len(data)]
    keep[heads] = True
    at = np.flatnonzero(keep)
    return np.where(space[at], np.uint8(32), LOWER[data[at]]), np.searchsorted(at, off), at


def _grams(data: np.ndarray) -> np.ndarray:
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, Q)).view(np.uint64).ravel()


def aligned(passage: np.ndarray, region: np.ndarray, edits: int, fixed: bool = False) -> tuple[int, int]:
    """Least edit distance of the whole passage to a part of the region that starts within its first 4 edits + 4 bytes (fixed: at its start), and where the part ends.

    Only the diagonals of the band are filled; beyond them a distance is more than edits.
    """
    width = len(region) - len(passage) + 2 * edits + 1
    if width <= 0:
        return edits + 1, 0
    far = np.int32(1 << 20)
    step = np.arange(width, dtype=np.int32)
    # column k of row i is region place i + k - edits
    place = step - edits
    row = np.where((place >= 0) & (place <= (0 if fixed else len(region))), 0, far).astype(np.int32)
    if fixed:
        row = np.minimum.accumulate(row - step) + step
    padded = np.concatenate([np.zeros(edits + 1, np.uint8), region, np.zeros(width + edits, np.uint8)])
    for i, c in enumerate(passage, 1):
        place = place + 1
        unlike = (padded[i : i + width] != c) | (place < 1) | (place > len(region))
        new = row + unlike
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[(place < 0) | (place > len(region))] = far
        row = np.minimum.accumulate(new - step) + step
    row = np.where((place < 0) | (place > len(region)), far, row)
    best = int(row.argmin())
    return int(row[best]), int(place[best])


def inside_word(body: bytes, at: int) -> bool:
    """Whether the UTF-8 text goes on with a letter or digit on both sides of a place."""

    def part(a: int, b: int) -> str:
        return body[a:b].decode("utf-8", "ignore")

    if not 0 < at < len(body):
        return False
    first = at - 1
    while first > max(0, at - 4) and body[first] & 0xC0 == 0x80:
        first -= 1
    return part(first, at)[-1:].isalnum() and part(at, at + 4)[:1].isalnum()


class Passages:
    """An index of a block of passages: items, their bytes, and postings of their q-grams."""

    def __init__(self, items: list[tuple[int | None, str]]):
        data, off = flat(pc.utf8_lower(pa.array([" ".join(t.split()) for _, t in items], pa.string())))
        body, off, _ = normal(data, off)
        self.items = [i for i, _ in items]
        self.bytes = [body[a:b] for a, b in zip(off[:-1], off[1:])]
        self.size = np.diff(off)
        edits = (self.size * EDITS).astype(np.int64)
        self.edits = np.where(self.size - Q + 1 - Q * edits >= 1, edits, 0)
        self.bound = np.maximum(1, self.size - Q + 1 - Q * self.edits)
        grams, owner, place = [], [], []
        for k, b in enumerate(self.bytes):
            g = _grams(b)
            grams.append(g)
            owner.append(np.full(len(g), k))
            place.append(np.arange(len(g)))
        g, owner, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, owner, place))
        order = np.argsort(g, kind="stable")
        g, self.owner, self.place = g[order], owner[order], place[order]
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        self.grams, self.first, self.count = g[head], head, np.diff(np.append(head, len(g)))
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.slot(self.grams)] = True
        self.tiny = {int(n): {} for n in np.unique(self.size) if 0 < n < Q}
        for k, b in enumerate(self.bytes):
            if 0 < len(b) < Q:
                self.tiny[len(b)].setdefault(int.from_bytes(b.tobytes(), "little"), []).append(k)

    @staticmethod
    def slot(g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)

    def regions(self, body: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Candidates as rows document, passage, band."""
        g = _grams(body)
        at = np.flatnonzero(self.seen[self.slot(g)])
        if not len(self.grams) or not len(at):
            return np.zeros((0, 3), np.int64)
        k = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        same = self.grams[k] == g[at]
        at, k = at[same], k[same]
        doc = np.searchsorted(off, at, "right") - 1
        inside = at + Q <= off[doc + 1]
        at, k, doc = at[inside], k[inside], doc[inside]
        # hits go in runs of about HITS postings; what one document's runs count for a band is added up
        group = np.cumsum(self.count[k]) // HITS
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(at)]
        parts = [self._bands(at[x:y], k[x:y], doc[x:y], off) for x, y in zip(edges[:-1], edges[1:])]
        key, count = _summed(np.concatenate([x for x, _ in parts], axis=1), np.concatenate([x for _, x in parts]))
        return key[:, count >= self.bound[key[1]]].T

    def _bands(self, at: np.ndarray, k: np.ndarray, doc: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, passage, band) of hits at places, of grams k, and how many of them each has: each counts in two bands."""
        n = self.count[k]
        which = np.repeat(np.arange(len(at)), n)
        post = self.first[k][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        owner = self.owner[post]
        band = (at[which] - off[doc[which]] - self.place[post]) // (self.edits[owner] + 1)
        found = [_summed(np.stack([doc[which], owner, band - shift]), np.ones(len(which), np.int64)) for shift in (0, 1)]
        return _summed(np.concatenate([x for x, _ in found], axis=1), np.concatenate([x for _, x in found]))

    def find(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int | None, int, int, int]]:
        """(document, item, distance, start, end) with byte places in the document, the best for each document and item."""
        body, spot, back = normal(data, off)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}

        def place(doc: int, k: int, distance: int, first: int, end: int) -> None:
            old = best.get((doc, k))
            if distance <= self.edits[k] and (old is None or (distance, first) < old[:2]):
                best[doc, k] = (distance, first, end)

        def exact(doc: int, k: int, a: int, region: bytes, p: bytes) -> bool:
            """The first copy of a passage in a region that begins and ends with words, if there is one."""
            at = region.find(p)
            while at >= 0:
                if self.edits[k] or self._whole(body, spot, doc, a + at, a + at + len(p)):
                    place(doc, k, 0, a + at, a + at + len(p))
                    return True
                at = region.find(p, at + 1)
            return False

        for doc, k, band in self.regions(body, spot).tolist():
            e, p = int(self.edits[k]), self.bytes[k]
            low = band * (e + 1)  # diagonals low to low + 2 (e + 1) - 1, and e more for the edits
            a = spot[doc] + max(0, low - e)
            region = body[a : min(spot[doc + 1], spot[doc] + low + 3 * (e + 1) + len(p))]
            if not exact(doc, k, a, region.tobytes(), p.tobytes()) and e:
                distance, end = aligned(p, region, e)
                if distance <= e:
                    # from the end back: where the part with this distance begins
                    _, length = aligned(p[::-1], region[max(0, end - len(p) - e) : end][::-1], e, True)
                    place(doc, k, distance, a + end - length, a + end)
        for n, held in self.tiny.items():
            if len(body) < n:
                continue
            window = sum(body[j : len(body) - n + 1 + j].astype(np.uint64) << np.uint64(8 * j) for j in range(n))
            at = np.flatnonzero(np.isin(window, np.array(list(held), np.uint64)))
            doc = np.searchsorted(spot, at, "right") - 1
            for i, d in zip(at.tolist(), doc.tolist()):
                if i + n <= spot[d + 1] and self._whole(body, spot, d, i, i + n):
                    for k in held[int(window[i])]:
                        place(d, k, 0, i, i + n)
        # an empty match (all of a passage edited away) is none
        return [(doc, self.items[k], d, int(back[a] - off[doc]), int(back[b - 1] + 1 - off[doc])) for (doc, k), (d, a, b) in sorted(best.items()) if a < b]

    @staticmethod
    def _whole(body: np.ndarray, spot: np.ndarray, doc: int, a: int, b: int) -> bool:
        """Whether neither end of a place is inside a word of its document."""
        x, y = max(int(spot[doc]), a - 4), min(int(spot[doc + 1]), b + 4)
        near = body[x:y].tobytes()
        return not inside_word(near, a - x) and not inside_word(near, b - x)


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of key, in order, and the sums of their counts."""
    order = np.lexsort(key[::-1])
    key, count = key[:, order], count[order]
    head = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])) if len(order) else np.zeros(0, np.int64)
    return key[:, head], np.add.reduceat(count, head) if len(head) else count


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> list[DataFrame]:
    """(item_id, text) in as many parts as keep each one under about limit bytes."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n = -(-int(items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]) // limit)
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, start, end) of all documents (doc_id, text); byte places, end exclusive."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, distance int, start long, end long"
    found = []
    for part in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.orderBy("item_id", "text").collect()])

        def run(batches, shared=shared):
            own = Passages(shared.value)
            for batch in pieces(batches):
                got = own.find(*flat(pc.utf8_lower(column(batch, "text"))))
                if got:
                    doc, *rest = zip(*got)
                    yield pa.RecordBatch.from_arrays([column(batch, "doc_id").take(pa.array(doc)), *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.int32(), pa.int64(), pa.int64())))], ["doc_id", "item_id", "distance", "start", "end"])

        found.append(docs.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def without(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs (any columns, with text) that hold no passage."""
    for part in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.orderBy("item_id", "text").collect()])

        def run(batches, shared=shared):
            own = Passages(shared.value)
            for batch in pieces(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[doc for doc, *_ in own.find(*flat(pc.utf8_lower(column(batch, "text"))))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.lit(True))
