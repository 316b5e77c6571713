"""Near-duplicate classes: members of shared buckets, verification of their pairs, connected components.

Buckets (equal band hashes) never become all pairs. A task sends the least member of each of its
buckets on, and all other members past that shuffle, since they are known to share a bucket; so a bucket
is met by one row for each task at most, however many members it has. Only members of buckets of two or
more nodes are kept, and buckets of the same members count once.

Each bucket's members are verified against its most central one, the member whose buckets are
the largest: the text that edited copies were made from, where there is one. Buckets whose members are
then still in different components have all their pairs tested that cross components, large buckets in tiles,
block against block. So every pair of a bucket is linked, in one component already, or tested.
Links, members and components stay in tables of the shared folder; each is deleted when its successor is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, release, trim

#: So many ids at most (32 MB) are sent to all tasks; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
FLUSH, PART = 1 << 18, 1 << 20
#: A block of a bucket has about so many members, or bytes; a product of two blocks takes so many values at once.
BLOCK, BLOCK_BYTES, COLUMNS = 512, 8 << 20, 2048
#: Blocks of so many members are compared pair by pair.
FEW = 12
#: route: where a row is sent; key: null for a bucket's least member in a task, route if it has others there, else the bucket of another member.
ROUTE_SCHEMA = "route long, id long, key long"


def small(ids: DataFrame) -> DataFrame:
    """ids (a few long columns, a table), marked for broadcast if their counted number allows it."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


class Buckets:
    """Collects (key, id) of a task and yields rows of ROUTE_SCHEMA."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.ids.append(ids)
        self.size += len(keys)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        key, id_ = np.concatenate(self.keys), np.concatenate(self.ids).view(np.int64)
        self.__init__()
        order = np.argsort(key)
        key, id_ = key[order], id_[order]
        same = np.append(False, key[1:] == key[:-1])
        at = np.flatnonzero(same | np.append(same[1:], False))
        if len(at):
            # only buckets of several rows need their ids in order, and once each
            inner = at[np.lexsort((id_[at], key[at]))]
            id_[at] = id_[inner]
            once = ~same | np.append(True, id_[1:] != id_[:-1])
            key, id_ = key[once], id_[once]
            same = np.append(False, key[1:] == key[:-1])
        more = np.append(same[1:], False)
        route = np.where(same, mix(key ^ mix(id_.view(np.uint64))), key).view(np.int64)
        valid = same | more
        for a in range(0, len(key), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(route[part]), pa.array(id_[part]), pa.array(key[part].view(np.int64), mask=~valid[part])], ["route", "id", "key"])


def members(rows: DataFrame, most: int) -> DataFrame:
    """Distinct (key, node) of all buckets of two nodes or more, from rows of ROUTE_SCHEMA, of which there are most at most.

    Buckets are dealt by their hashes, in so many parts that each has about PART rows; a task groups its part in memory. A
    bucket has one row a task (or FLUSH rows), so none outgrows its part.
    """

    def run(batches):
        trim()
        routes, ids, flags = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for batch in batches:
            route, id_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            valid = np.array(batch.column(2).is_valid(), bool)
            key = batch.column(2).fill_null(0).to_numpy()
            other = valid & (key != route)
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[other]), pa.array(id_[other])], ["key", "node"])
            routes.append(route[~other])
            ids.append(id_[~other])
            flags.append(valid[~other])
        route, id_, flag = (np.concatenate(x) for x in (routes, ids, flags))
        routes = ids = flags = None
        order = np.argsort(route)
        route = route[order]
        same = route[1:] == route[:-1]
        grouped = np.append(False, same) | np.append(same, False) if len(route) else np.zeros(0, bool)
        at = np.flatnonzero(grouped | flag[order])
        if len(at):
            route, id_, flag = route[at], id_[order[at]], flag[order[at]]
            head = np.flatnonzero(np.append(True, route[1:] != route[:-1]))
            many = (np.minimum.reduceat(id_, head) != np.maximum.reduceat(id_, head)) | np.logical_or.reduceat(flag, head)
            out = np.flatnonzero(np.repeat(many, np.diff(np.append(head, len(route)))))
            for a in range(0, len(out), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(route[out[a : a + (1 << 16)]]), pa.array(id_[out[a : a + (1 << 16)]])], ["key", "node"])

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // PART))
    return rows.repartition(parts, "route").mapInArrow(run, "key long, node long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b): the least node of its component, by large-star and small-star steps until all are stars."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "star")
        near = star.join(star.groupBy("a").agg(F.min("b").alias("m")), "a")
        # each row gives (a, m), and (b, m) where b isn't the least
        out = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        now = cut(near.select(out).select("e.*").where("a <> b").distinct(), "edges")
        release(edges, star)
        edges = now


def _central(held: DataFrame) -> DataFrame:
    """Distinct (a, b): each member b of each bucket of held (key, node, n, times) with the bucket's most central member a."""
    rank = held.groupBy("node").agg(F.sum(F.col("n") * F.col("times")).alias("rank"))
    leader = held.join(rank, "node").groupBy("key").agg(F.max(F.struct("rank", "node")).alias("top")).select("key", F.col("top.node").alias("a"))
    return held.join(leader, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, elements: Callable[[bytes], np.ndarray], threshold: float) -> DataFrame:
    """The rows of pairs (a, b) whose sets are similar; sets: (node, blob), a row for each node.

    All pairs of one a are met with its set; an a of many pairs in parts of about BLOCK pairs.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.col("b").alias("node"))
    heads = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"))
    rows = dealt.unionByName(heads).join(sets.select("node", "blob"), "node").select("a", "part", (F.col("node") != F.col("a")).alias("other"), "node", "blob")

    def run(batches):
        trim()
        now = head = None
        for batch in batches:
            a, part, other, node = (batch.column(k).to_pylist() for k in range(4))
            found = []
            for i, blob in enumerate(batch.column(4)):
                if not other[i]:
                    now, head = (a[i], part[i]), elements(blob.as_py())
                elif now == (a[i], part[i]):
                    x = elements(blob.as_py())
                    if min(len(x), len(head)) >= (threshold - 1e-9) * max(len(x), len(head)) and jaccard(head, x) >= threshold - 1e-12:
                        found.append((a[i], node[i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "other").mapInArrow(run, "a long, b long")


def alike(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """[left, right] whether the Jaccard similarity of sets (sorted distinct values, none empty) is the threshold or more, from products of 0/1 matrices."""
    n, m = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    own, at = np.unique(np.concatenate(left), return_inverse=True)
    other = np.concatenate(right)
    place = np.minimum(np.searchsorted(own, other), len(own) - 1)
    shared = own[place] == other
    used = np.zeros(len(own), bool)
    used[place[shared]] = True
    rank = np.cumsum(used) - 1
    rows, columns = np.repeat(np.arange(len(left)), n)[used[at]], rank[at[used[at]]]
    rows2, columns2 = np.repeat(np.arange(len(right)), m)[shared], rank[place[shared]]
    both = np.zeros((len(left), len(right)))
    order, order2 = np.argsort(columns, kind="stable"), np.argsort(columns2, kind="stable")
    rows, columns, rows2, columns2 = rows[order], columns[order], rows2[order2], columns2[order2]
    for low in range(0, int(used.sum()), COLUMNS):
        a, b = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        for matrix, r, c in ((a, rows, columns), (b, rows2, columns2)):
            part = slice(*np.searchsorted(c, [low, low + COLUMNS]))
            matrix[r[part], c[part] - low] = 1
        both += a @ b.T
    return both / (n[:, None] + m - both) >= threshold - 1e-12


def _linked(tile: list[tuple[int, int, bytes]], one: bool, elements: Callable[[bytes], np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that join all roots of a tile's members (root, block, blob) with similar sets: of each pair of members, or of different blocks."""
    first = tile[0][1]
    left = tile if one else [x for x in tile if x[1] == first]
    right = tile if one else [x for x in tile if x[1] != first]
    if not left or not right:
        return []
    x, y = (np.array([root for root, *_ in side], np.int64) for side in (left, right))
    if (x[0] == x).all() and (x[0] == y).all():
        return []
    sets = [elements(blob) for *_, blob in left]
    if len(left) <= FEW and len(right) <= FEW:
        return _few(x, sets, *((x, sets) if one else (y, [elements(blob) for *_, blob in right])), one, threshold)
    good = alike(sets, sets if one else [elements(blob) for *_, blob in right], threshold) & (x[:, None] != y)
    i, j = np.nonzero(good)
    links = np.unique(np.stack([np.minimum(x[i], y[j]), np.maximum(x[i], y[j])], axis=1), axis=0)
    join = _Joined()
    return [(v, w) for v, w in links.tolist() if join(v, w)]


class _Joined:
    """Union-find of a tile's roots: a call joins two, and says whether they weren't joined yet."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, v: int) -> int:
        up = self.up
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    def __call__(self, v: int, w: int) -> bool:
        p, q = self.top(v), self.top(w)
        if p != q:
            self.up[max(p, q)] = min(p, q)
        return p != q


def _few(x: np.ndarray, left: list[np.ndarray], y: np.ndarray, right: list[np.ndarray], one: bool, threshold: float) -> list[tuple[int, int]]:
    """What _linked gives, pair by pair: for small tiles this is faster than products of matrices."""
    join, out = _Joined(), []
    v, w = x.tolist(), y.tolist()
    for i, a in enumerate(left):
        for j in range(i + 1 if one else 0, len(right)):
            b = right[j]
            if min(len(a), len(b)) >= (threshold - 1e-9) * max(len(a), len(b)) and join.top(v[i]) != join.top(w[j]) and jaccard(a, b) >= threshold - 1e-12:
                join(v[i], w[j])
                out.append((min(v[i], w[j]), max(v[i], w[j])))
    return out


def _crossing(held: DataFrame, placed: DataFrame, sets: DataFrame, elements: Callable[[bytes], np.ndarray], threshold: float) -> DataFrame:
    """Distinct (a, b): links of roots by all similar pairs, in different components, of a bucket of held (key, node).

    placed: (node, root, size in bytes) of all nodes. A bucket of one root has nothing to test; of the others, equal ones
    are tested once, and large ones as tiles, block against block: a member goes to as many tiles as its bucket has blocks.
    """
    at = held.select("key", "node").join(placed, "node")
    mixed = at.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    mixed = mixed.select("key", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_BYTES)).alias("blocks"))
    blocked = at.join(mixed, "key").select("key", "node", "root", F.pmod(F.xxhash64("node"), "blocks").alias("block"), "blocks")
    dealt = blocked.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "node", "root", "block")
    tiles = dealt.join(sets.select("node", "blob"), "node").select("key", "i", "j", "block", "root", "blob").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block")

    def run(batches):
        trim()
        key, tile = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(k).to_numpy() for k in range(3)])
            edges = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            block, root = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            blob, found = batch.column(5).to_pylist(), []
            for a, b in zip(edges[:-1], edges[1:]):
                now = tuple(at[:, a].tolist())
                if now != key:
                    found += _linked(tile, key[1] == key[2], elements, threshold) if tile else []
                    key, tile = now, []
                tile += zip(root[a:b], block[a:b], blob[a:b])
            if found:
                yield _links(found)
        if tile and (found := _linked(tile, key[1] == key[2], elements, threshold)):
            yield _links(found)

    return tiles.mapInArrow(run, "a long, b long").distinct()


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])


def classes(found: DataFrame, fetch: Callable[[DataFrame], DataFrame], elements: Callable[[bytes], np.ndarray], threshold: float) -> DataFrame:
    """(node, root) of the nodes that similar pairs of a bucket join, a table.

    found: distinct (key, node) of all buckets of two nodes or more. fetch gives (node, blob), a row for each of a table of
    nodes; elements gives the sorted distinct values of a blob.
    """
    found = cut(found, "members")
    wanted = cut(found.select("node").distinct(), "wanted")
    sets = cut(fetch(wanted).withColumn("size", F.length("blob")), "sets")
    buckets = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    buckets = buckets.groupBy("n", "x", "y").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("times")).select("key", "n", "times")
    held = cut(found.join(buckets, "key"), "held")
    release(found, wanted)
    pairs = cut(_central(held), "pairs")
    base = cut(components(cut(_verified(pairs, sets, elements, threshold), "links")), "base")
    placed = cut(sets.select("node", "size").join(base, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size"), "placed")
    links = cut(_crossing(held, placed, sets, elements, threshold), "links")
    if not links.isEmpty():
        upper = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
        base = cut(placed.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "base")
    release(sets, held, pairs)
    return base


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct values; 0 if one is empty."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return both / (len(a) + len(b) - both)
