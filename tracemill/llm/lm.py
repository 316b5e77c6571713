"""Operator 7, LM scoring: deleted interpolation of n-gram maximum-likelihood estimates.

A text is its words (A-Z as a-z) and one end. P(word | word before) is a mixture of the
maximum-likelihood estimates of word pairs and of single words, and of a uniform one over the words
of the training documents and an unknown symbol; the end stands before a text. The mixture weights depend on the bucket
of the context's frequency (by powers of two) and are learned by expectation-maximisation on held-out
counts: of those training documents whose crc32 modulo 7 is ``DELETED``, against the counts of
the other training documents. The scores take the counts of all training documents. An unknown word shares the
unknown symbol's probability by its spelling, so the probabilities of all texts sum to one at most. Spelling is a deleted interpolation
of the same kind: of the estimates of a byte given two bytes before it, one, and none, and of a uniform part, with borders around a
word, counted over all words and weighted by buckets of the context of two.

``score`` is a text's log10 probability. ``symbol_score`` leaves spellings out: an unknown word is the unknown symbol,
as in the base score, a unigram model of words with one added to each count; these two are over the same events.

Counts are exact and of the whole corpus. Documents are gathered in blocks. A block asks
for each of its distinct words and pairs once, with its own counts: sorted 64-bit hashes, cut into
ranges, as differences in compressed planes of bytes. Blocks and ranges hold about ``exchange.side`` requests each, so the
rows that are exchanged grow with the corpus. A
range sums its requests (each word or pair is one request a block, so a frequent one is no hot key) and answers
each block in the block's order. Blocks meet their answers by their numbers. What a task holds is a block, or a range.

Null texts are empty: one end, no words. Without training documents N and V are 0 and only the uniform
parts are left. Every document is scored; repeated rows are scored each. A text longer than a block makes
one of its own. Columns other than doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange
from .common import LOWER, column, crc_fold, cut, flat, mix, pieces, release, shuffles_freed, span_hashes, table, trim, words
from .exchange import edges as range_edges
from .exchange import numbered, pack, pack_sorted, unpack, unpack_sorted

MOD, HELD_OUT, DELETED = 7, 2, 4
ROUNDS = 40
BUCKETS = 41
#: Bytes of text for a token, when the size of blocks is chosen.
TOKEN_BYTES = 5
#: Estimates are counted for the mixture weights in steps of a quarter of a power of two.
STEPS = 4
_END = np.uint64(0xE0D0E0D0E0D0E0D1)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Roles of blocks: counted, counted as held out for the weights, scored only.
KEPT, LEFT, SCORED = 0, 1, 2
#: A word's border, and the number of symbols that spell words.
BORDER, SYMBOLS = 256, 257


# the spelling of words


def spelled_codes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the bytes of each word and the border after it: the two symbols before and the symbol, as one number; and where each word begins."""
    size = end - start + 1
    off = np.cumsum(size) - size
    at = np.repeat(start - off, size) + np.arange(int(size.sum()))
    symbol = np.append(low, np.uint8(0))[np.minimum(at, len(low))].astype(np.int64)
    symbol[off + size - 1] = BORDER
    before = np.empty_like(symbol)
    before[1:] = symbol[:-1]
    before[off] = BORDER
    second = np.empty_like(symbol)
    second[1:] = before[:-1]
    second[off] = BORDER
    return (second * SYMBOLS + before) * SYMBOLS + symbol, off


_END_CODE = (BORDER * SYMBOLS + BORDER) * SYMBOLS + BORDER


def _summed(parts: list[tuple]) -> list[np.ndarray]:
    code, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return [code, *(np.bincount(place, np.concatenate([p[k] for p in parts]), len(code)).astype(np.int64) for k in (1, 2))]


def _spelling_counts(docs: DataFrame) -> pa.Table:
    """(code, kept, left): how often each code occurs in training documents, and in those left out for the weights; 257**3 rows at most, of (text, fold)."""

    def run(batches):
        held = []
        for batch in pieces(batches):
            data, off = flat(column(batch, "text"))
            low = LOWER[data]
            start, end, doc = words(low, off)
            left = column(batch, "fold").fill_null(-1).to_numpy(zero_copy_only=False) == DELETED
            if len(start):
                _, place, number = numbered(span_hashes(low, start, end))
                by = [np.bincount(number[left[doc] == side], minlength=len(place)) for side in (False, True)]
                code, _ = spelled_codes(low, start[place], end[place])
                size = end[place] - start[place] + 1
                held.append(_summed([(code, *(np.repeat(n, size) for n in by))]))
            held.append((np.array([_END_CODE]), np.array([(~left).sum()]), np.array([left.sum()])))
            if sum(len(h[0]) for h in held) > 1 << 20:
                held = [_summed(held)]
        if held:
            code, kept, out = _summed(held)
            for a in range(0, len(code), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in (code, kept, out)], ["code", "kept", "left"])

    found = docs.select("text", "fold").mapInArrow(run, "code long, kept long, left long")
    return found.groupBy("code").agg(F.sum("kept").alias("kept"), F.sum("left").alias("left")).toArrow().sort_by("code")


class Spelling:
    """P(symbol | two symbols before) from counts of codes (sorted), with mixture weights."""

    def __init__(self, code: np.ndarray, n: np.ndarray, weight: np.ndarray | None = None):
        self.code, self.n, self.weight = code[n > 0], n[n > 0], weight
        sums = lambda key, size: np.bincount(key, self.n, size) if len(self.n) else np.zeros(size)
        self.context = sums(self.code // SYMBOLS, SYMBOLS**2)
        two = sums(self.code % SYMBOLS**2, SYMBOLS**2)
        self.two = two / np.repeat(np.maximum(two.reshape(SYMBOLS, SYMBOLS).sum(axis=1), 1), SYMBOLS)
        self.one = sums(self.code % SYMBOLS, SYMBOLS) / max(float(self.n.sum()), 1)

    def parts(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each code's context, and its estimates: uniform, of the symbol, after one and after two symbols."""
        three = np.zeros(len(code))
        if len(self.code):
            at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            three = np.where(self.code[at] == code, self.n[at], 0)
        times = self.context[code // SYMBOLS]
        return bucket(times), np.stack([np.full(len(code), 1 / SYMBOLS), self.one[code % SYMBOLS], self.two[code % SYMBOLS**2], three / np.maximum(times, 1)], axis=1)

    def logs(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """log10 probability of each word's bytes and the border after it."""
        if not len(start):
            return np.zeros(0)
        code, off = spelled_codes(low, start, end)
        at, parts = self.parts(code)
        return np.add.reduceat(np.log10((parts * self.weight[at]).sum(axis=1)), off)


def learned_spelling(code: np.ndarray, kept: np.ndarray, left: np.ndarray) -> Spelling:
    """Weights of what was left out against what was kept, and the counts of both."""
    allowed = np.ones((BUCKETS, 4))
    allowed[0, 3] = 0
    if not kept.sum() + left.sum():
        allowed[:, 1:] = 0
    some = left > 0
    at, parts = Spelling(code, kept).parts(code[some])
    return Spelling(code, kept + left, mixture(at, parts, left[some], allowed))


# blocks, requests and answers


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time."""
    trim()
    names = batch.schema.names
    for k in range(batch.num_rows):
        yield {x: batch.column(i)[k].as_py() for i, x in enumerate(names)}


_BLOCK = "block long, role int, doc_id array<long>, n array<int>, size long, n_words int, ids binary, words binary, spelled binary"


def pairs_of(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before; the end stands before a document."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[first] = _END
    return mix(mix(before ^ _PAIR) + h)


def _blocks(docs: DataFrame, spelling: Spelling, size: int) -> DataFrame:
    """Blocks of documents (doc_id, text, fold) of one role each: numbers of words in the sorted table of the block's words."""
    shared = docs.sparkSession.sparkContext.broadcast(spelling)
    end_ = float(spelling.logs(np.zeros(1, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64))[0])
    names = [x.split()[0] for x in _BLOCK.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int32(), *[pa.binary()] * 3]

    def run(batches):
        task, serial = TaskContext.get().partitionId(), 0
        open_: list[list[tuple]] = [[], [], []]

        def block(role):
            nonlocal serial
            ids, n, hashes, spell = zip(*open_[role])
            h, n = np.concatenate(hashes), np.concatenate(n)
            own, place, number = numbered(h)
            row = [(task << 24) + serial, role, [x for y in ids for x in y], n, len(h), len(own), pack(number), pack_sorted(own), np.concatenate(spell)[place].tobytes() if role == SCORED else None]
            serial += 1
            open_[role] = []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

        for batch in pieces(batches):
            data, off = flat(column(batch, "text"))
            low = LOWER[data]
            start, end, doc = words(low, off)
            n = np.bincount(doc, minlength=batch.num_rows) + 1
            inner = np.ones(int(n.sum()), bool)
            inner[np.cumsum(n) - 1] = False
            h = np.full(len(inner), _END, np.uint64)
            h[inner] = span_hashes(low, start, end)
            fold = column(batch, "fold").fill_null(-1).to_numpy(zero_copy_only=False)
            roles = np.where(fold == HELD_OUT, SCORED, np.where(fold == DELETED, LEFT, KEPT))
            spell = np.zeros(0)
            if (roles == SCORED).any():
                spell = np.full(len(inner), end_, np.float32)
                some = roles[doc] == SCORED
                spelled = np.zeros(len(start), np.float32)
                spelled[some] = shared.value.logs(low, start[some], end[some])
                spell[inner] = spelled
            ids = np.array(column(batch, "doc_id").to_pylist(), object)
            each = np.repeat(roles, n)
            for role in np.unique(roles).tolist():
                open_[role].append((ids[roles == role].tolist(), n[roles == role], h[each == role], spell[each == role] if role == SCORED else spell))
                if sum(len(x[2]) for x in open_[role]) >= size:
                    yield block(role)
        for role in (KEPT, LEFT, SCORED):
            if open_[role]:
                yield block(role)

    return docs.select("doc_id", "text", "fold").mapInArrow(run, _BLOCK)


class Block:
    """A block's tokens: hashes, the tables of its words and pairs, and each token's number in both."""

    def __init__(self, n: list, n_words: int, ids: bytes, words_: bytes):
        self.n = np.array(n, np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.words = unpack_sorted(words_, n_words)
        self.word = unpack(ids, int(self.n.sum()), np.uint32)
        self.pairs, _, self.pair = numbered(pairs_of(self.words[self.word], self.first))


def _requests(blocks: DataFrame, ranges: int) -> DataFrame:
    """(range, order, block, role, size, keys, counts): each block's distinct words (1) and pairs (2) by ranges of their hashes."""
    names = ["range", "order", "block", "role", "size", "keys", "counts"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    cuts = range_edges(ranges)

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                b = Block(row["n"], row["n_words"], row["ids"], row["words"])
                for order, (keys, place) in enumerate(((b.words, b.word), (b.pairs, b.pair)), 1):
                    count = np.bincount(place, minlength=len(keys)).astype(np.uint32)
                    at = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
                    rows = [(k, order, row["block"], row["role"], y - x, pack_sorted(keys[x:y]), None if row["role"] == SCORED else pack(count[x:y])) for k, (x, y) in enumerate(zip(at[:-1], at[1:])) if x < y]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return blocks.select("block", "role", "n", "n_words", "ids", "words").mapInArrow(run, "range long, order int, block long, role int, size int, keys binary, counts binary")


_ANSWER = "block long, order int, range long, size int, counts binary, kept binary, distinct long"


def _answers(requests: DataFrame, ranges: int) -> DataFrame:
    """The corpus counts of each request's keys, in their order, and for blocks that are left out those without them; distinct: new words of a range."""
    names = [x.split()[0] for x in _ANSWER.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]

    def answer(at, asked):
        keys = [unpack_sorted(r["keys"], r["size"]) for r in asked]
        own, _, place = numbered(np.concatenate(keys))
        edges = np.cumsum([0, *map(len, keys)])
        every, kept = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for k, r in enumerate(asked):
            if r["role"] != SCORED:
                here, count = place[edges[k] : edges[k + 1]], unpack(r["counts"], r["size"], np.uint32)
                every[here] += count
                if r["role"] == KEPT:
                    kept[here] += count
        rows = []
        for k, r in enumerate(asked):
            here = place[edges[k] : edges[k + 1]]
            rows.append((r["block"], at[1], at[0], r["size"], pack(every[here]), pack(kept[here]) if r["role"] == LEFT else None, 0 if k else int((every > 0).sum())))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    def run(batches):
        at, asked = None, []
        for batch in batches:
            for r in _rows(batch):
                if (now := (r["range"], r["order"])) != at:
                    if asked:
                        yield answer(at, asked)
                    at, asked = now, []
                asked.append(r)
        if asked:
            yield answer(at, asked)

    return requests.repartition(ranges, "range").sortWithinPartitions("range", "order").mapInArrow(run, _ANSWER)


def _met(blocks: DataFrame, answers: DataFrame, handle, schema: str) -> DataFrame:
    """handle(row of _BLOCK, Block, counts by order, counts without the left out by order) for each block with its answers."""
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(x) for x in names]
    body = [x.split()[0] for x in _BLOCK.split(", ")][1:]
    left = blocks.select("block", F.lit(0).alias("order"), F.lit(0).cast("long").alias("range"), *body, *none("binary", "counts", "kept"))
    empty = [F.lit(None).cast(blocks.schema[x].dataType).alias(x) for x in body if x != "size"]
    right = answers.select("block", "order", "range", F.col("size").cast("long").alias("size"), *empty, "counts", "kept").select(left.columns)

    def run(batches):
        row, parts = None, {}

        def done():
            b = Block(row["n"], row["n_words"], row["ids"], row["words"])
            full = {k: np.concatenate(v) if v else None for k, v in parts.items()}
            if len(full[1, "counts"]) != len(b.words) or len(full[2, "counts"]) != len(b.pairs):
                raise RuntimeError("answers don't fit their block")
            return handle(row, b, [full[k, "counts"] for k in (1, 2)], [full.get((k, "kept")) for k in (1, 2)])

        for batch in batches:
            for r in _rows(batch):
                if not r["order"]:
                    if row is not None:
                        yield from done()
                    row, parts = r, {}
                else:
                    for kind in ("counts", "kept"):
                        if r[kind] is not None:
                            parts.setdefault((r["order"], kind), []).append(unpack(r[kind], r["size"], np.int64))
        if row is not None:
            yield from done()

    return left.unionByName(right).repartition("block").sortWithinPartitions("block", "order", "range").mapInArrow(run, schema)


# the mixture


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1.0).astype(np.int64), BUCKETS - 1)


def estimates(b: Block, counts: list[np.ndarray], total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: the bucket of its context, the estimate from its pair, and that from the word alone."""
    own = counts[0][b.word]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    end = np.searchsorted(b.words, _END)
    before[b.first] = counts[0][end]
    return bucket(before), counts[1][b.pair] / np.maximum(before, 1), own / max(total, 1)


def _step(f: np.ndarray) -> np.ndarray:
    """Estimates in steps, 1 for one, more for less; 0 for zero."""
    with np.errstate(divide="ignore"):
        return np.where(f > 0, 1 + np.rint(-np.log2(np.where(f > 0, f, 1)) * STEPS), 0).astype(np.int64)


def _held_counts(blocks: DataFrame, answers: DataFrame, total: int) -> DataFrame:
    """(bucket, pair, word, n): how many left-out tokens have a context of the bucket and estimates of these steps: a bounded table."""

    def handle(row, b, counts, kept):
        at, f2, f1 = estimates(b, kept, total)
        key, n = _tally(at, _step(f2), _step(f1))
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in key), pa.array(n)], ["bucket", "pair", "word", "n"])

    found = _met(blocks.where(f"role = {LEFT}"), answers.where("kept is not null"), handle, "bucket long, pair long, word long, n long")
    return found.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n"))


def _tally(*parts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    code, n = np.unique((parts[0] << 32) + (parts[1] << 16) + parts[2], return_counts=True)
    return [code >> 32, code >> 16 & 0xFFFF, code & 0xFFFF], n


def learn(at: np.ndarray, pair: np.ndarray, word: np.ndarray, n: np.ndarray, uniform: float, trained: bool = True) -> np.ndarray:
    """[bucket, (uniform, word, pair)] weights by expectation-maximisation; a bucket without held-out tokens keeps an even mixture.

    Contexts never seen (bucket 0) have no pairs, and without training there are no words: those weights are zero.
    """
    value = lambda step: np.where(step > 0, 2.0 ** (-(step - 1) / STEPS), 0.0)
    part = np.stack([np.full(len(at), uniform), value(word), value(pair)], axis=1)
    allowed = np.ones((BUCKETS, 3))
    allowed[0, 2] = 0
    if not trained:
        allowed[:, 1:] = 0
    return mixture(at, part, n, allowed)


def mixture(at: np.ndarray, part: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """[bucket, part] weights, by expectation-maximisation over n events each of a bucket with these estimates; parts that aren't allowed have none."""
    weight = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        share = part * weight[at]
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        new = np.stack([np.bincount(at, share[:, k], len(weight)) for k in range(part.shape[1])], axis=1) if len(at) else np.zeros_like(weight)
        new = (new + 1e-3) * allowed
        weight = new / new.sum(axis=1, keepdims=True)
    return weight


def _scores(blocks: DataFrame, answers: DataFrame, weight: np.ndarray, total: int, distinct: int) -> DataFrame:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "symbol_score"]

    def handle(row, b, counts, kept):
        at, f2, f1 = estimates(b, counts, total)
        own = counts[0][b.word]
        uniform = weight[at, 0] / (distinct + 1)
        spelled = np.frombuffer(row["spelled"], np.float32)[b.word] if row["spelled"] is not None else np.zeros(len(own))
        with np.errstate(divide="ignore"):
            symbols = np.where(own > 0, np.log10(weight[at, 2] * f2 + weight[at, 1] * f1 + uniform), np.log10(uniform))
        logs = symbols + np.where(own > 0, 0, spelled)
        add = lambda x: np.add.reduceat(x, b.first)
        base = add(np.log10(own + 1.0)) - b.n * np.log10(total + distinct + 1.0)
        columns = [pa.array(row["doc_id"], pa.int64()), pa.array(np.full(len(b.n), row["role"] == SCORED)), pa.array(b.n), pa.array(add((own > 0).astype(np.int64))), pa.array(base), pa.array(add(logs)), pa.array(add(symbols))]
        yield pa.RecordBatch.from_arrays(columns, names)

    return _met(blocks, answers, handle, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, symbol_score double")


def score(docs: DataFrame) -> DataFrame:
    """Score (doc_id, text); training rows are those out of fold HELD_OUT of MOD."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", crc_fold(F.col("doc_id"), MOD).cast("int").alias("fold"))
    spelled = _spelling_counts(docs.where(F.coalesce(F.col("fold") != HELD_OUT, F.lit(True))))
    spelling = learned_spelling(*(spelled[k].to_numpy() for k in ("code", "kept", "left")))
    volume = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    side = exchange.side(2 * volume // TOKEN_BYTES)  # a word and a pair a token, at most
    blocks = cut(_blocks(docs, spelling, side), "blocks")
    of = lambda roles: F.coalesce(F.sum(F.when(F.col("role").isin(*roles), F.col("size"))), F.lit(0))
    sums = blocks.agg(of((KEPT,)).alias("kept"), of((KEPT, LEFT)).alias("train"), F.coalesce(F.sum(F.col("n_words") + F.col("size")), F.lit(0)).alias("asked")).first()
    ranges = max(1, -(-sums.asked // side))
    with shuffles_freed(docs.sparkSession):
        answers = cut(_answers(_requests(blocks, ranges), ranges), "answers")
        distinct = answers.where("order = 1").agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first().v
        held = _held_counts(blocks, answers, sums.kept).toArrow()
        weight = learn(*(held[k].to_numpy() for k in ("bucket", "pair", "word", "n")), 1 / (distinct + 1), sums.train > 0)
        found = cut(_scores(blocks, answers, weight, sums.train, distinct), "scores")
    release(blocks, answers)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(sums.train)).cast("long").alias("train_tokens"), "base_score", "score", "symbol_score")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
