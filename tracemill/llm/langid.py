"""Operator 2, language ID: prediction by partial matching over bytes.

One variable-order context tree for each language: for each context of up to
``ORDER`` bytes the counts of the bytes that followed it, and an escape with
probability distinct / (total + distinct) to the next shorter context, whose
bytes already offered are excluded. The statistics are frozen after training, so
the code length of every byte seen after a context, and the cost of the escape of every context, are
computed once, exactly; a text's code length is a sum of what its bytes' longest known contexts say.
A byte is itself, but A-Z are a-z and white space is space; a text starts after spaces.

Texts without a letter, and null texts, are ``und`` with score 0. A text is given
the language with the shortest code (ties: the first by name); its score is the
posterior of that language at equal priors, 2 to the code lengths. The model is
fitted on at most about ``SAMPLE`` documents of each language, chosen by a hash
of the id; every document is predicted, whole. A language's tables hold what its sample has seen: about 50 bytes for each
four bytes that are new, whatever the number of languages. With no labelled row every text is ``und``.
Repeated rows are predicted each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, column, flat, in_fold, pieces, table

ORDER = 3
SAMPLE = 3000
#: Languages that share a table of grams.
GROUP = 8
#: The pipeline rejects texts that need more bits a byte than this under every language; random bytes need 8.
MOST_BITS = 6.0
UNKNOWN = "und"
_LETTER = r"\p{L}"
_FOLD = np.where(IS_SPACE, np.uint8(32), LOWER)
_VOID = np.uint32(0xFFFFFFFF)  # no text holds four such bytes


def _grams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each byte, it and the ORDER bytes before it as one number (the byte last); spaces stand before a document."""
    c = _FOLD[data].astype(np.uint32)
    key = c.copy()
    for k in range(1, ORDER + 1):
        before = np.full(len(c), 32, np.uint32)
        before[k:] = c[:-k] if k < len(c) else c[:0]
        for j in range(k):
            at = off[:-1] + j
            before[at[at < off[1:]]] = 32
        key |= before << np.uint32(8 * k)
    return key


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of all given documents; summed over each piece of a batch before the shuffle."""

    def run(batches):
        for batch in pieces(batches):
            langs = column(batch, "lang")
            for lang in pc.unique(langs).to_pylist():
                own = batch.filter(pc.equal(langs, lang))
                gram, n = np.unique(_grams(*flat(column(own, "text"))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Lookup:
    """Values by 32-bit keys, in a table of slots with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        slot = self.slot(keys)
        order = np.argsort(slot, kind="stable")
        place = np.arange(len(keys))
        at = np.maximum.accumulate(slot[order] - place) + place if len(keys) else place
        self.keys = np.full((1 << self.bits) + len(keys) + 1, _VOID)
        self.values = np.zeros(len(self.keys), np.float32 if values.dtype.kind == "f" else np.int32)
        self.keys[at], self.values[at] = keys[order], values[order]

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values (0 where there is none), and where there is one."""
        at = self.slot(keys)
        found = self.keys[at]
        hit = found == keys
        live = np.flatnonzero(~hit & (found != _VOID))
        while len(live):
            at[live] += 1
            found = self.keys[at[live]]
            good = found == keys[live]
            hit[live[good]] = True
            live = live[~good & (found != _VOID)]
        return np.where(hit, self.values[at], self.values.dtype.type(0)), hit


class Tree:
    """The frozen code lengths of one language, from the counts of its grams of ORDER + 1 bytes."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.seen: list[Lookup] = []
        self.escape: list[Lookup] = []
        for k in range(ORDER + 1):
            keys, place = np.unique(gram & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
            count = np.bincount(place, weights=n)
            context, owner = np.unique(keys >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(owner, weights=count), np.bincount(owner).astype(float)
            free = 1 - np.bincount(owner, weights=2.0 ** -self.bits(keys, k).astype(float))
            full = free <= 1e-9  # nothing left to escape to
            scale = np.where(full, total, total + kinds)
            self.seen.append(Lookup(keys, -np.log2(count / scale[owner])))
            self.escape.append(Lookup(context, np.where(full, 100.0, -np.log2(kinds / scale / np.where(full, 1, free)))))

    def grams(self) -> np.ndarray:
        return self.seen[ORDER].keys[self.seen[ORDER].keys != _VOID]

    def bits(self, key: np.ndarray, orders: int = ORDER + 1) -> np.ndarray:
        """Bits of the last byte of each gram, by contexts shorter than orders bytes."""
        out = np.zeros(len(key), np.float32)
        live = np.arange(len(key))
        for k in range(orders - 1, -1, -1):
            own = key[live] & np.uint32((1 << 8 * (k + 1)) - 1)
            value, hit = self.seen[k](own)
            cost, _ = self.escape[k]((own >> np.uint32(8))[~hit])
            out[live[hit]] += value[hit]
            live = live[~hit]
            out[live] += cost  # a context that was never seen costs nothing
            if not len(live):
                return out
        out[live] += 8
        return out


class Group:
    """Some languages' trees, with one table of the bits under each of them of every gram that one of them has seen."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        known = np.unique(np.concatenate([t.grams() for t in trees]))
        self.rows = Lookup(known, np.arange(1, len(known) + 1))
        self.bits = np.concatenate([np.zeros((1, len(trees)), np.float32), np.stack([t.bits(known) for t in trees], axis=1)])

    def lengths(self, key: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Bits of the runs of grams that begin at first (none empty), under each language."""
        row, hit = self.rows(key)
        out = np.add.reduceat(self.bits[row], first, axis=0, dtype=np.float64)
        new = np.flatnonzero(~hit)
        if len(new):
            owner = np.searchsorted(first, new, "right") - 1
            for k, tree in enumerate(self.trees):
                out[:, k] += np.bincount(owner, weights=tree.bits(key[new]), minlength=len(first))
        return out


class Model:
    def __init__(self, langs: list[str], trees: list[Tree]):
        self.langs, self.trees = langs, trees
        self.groups = [Group(trees[k : k + GROUP]) for k in range(0, len(trees), GROUP)]

    def lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of each document under each language."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        some = np.flatnonzero(np.diff(off) > 0)
        if len(some):
            key = _grams(data, off)
            for k, group in enumerate(self.groups):
                out[some, k * GROUP : (k + 1) * GROUP] = group.lengths(key, off[some])
        return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on (doc_id, text, lang): about sample rows of each language, by a hash of the id."""
    docs = docs.where("lang is not null and text is not null")
    known = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(known)
    if not langs:
        return Model([], [])
    spark = docs.sparkSession
    rate = spark.createDataFrame([(k, min(1.0, sample / n)) for k, n in known.items()], "lang string, rate double")
    picked = docs.join(F.broadcast(rate), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    rows = _counts(picked).toArrow()  # what the samples hold
    names = np.array(rows["lang"].to_pylist(), object)
    gram, n = rows["gram"].to_numpy().astype(np.uint32), rows["n"].to_numpy().astype(float)
    langs = [x for x in langs if (names == x).any()]
    return Model(langs, [Tree(gram[names == x], n[names == x]) for x in langs])


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns keep, then lang_pred, score, bits_per_byte; reads text once."""
    langs = model.langs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]

    def run(batches):
        own = shared.value
        for batch in pieces(batches):
            data, off = flat(column(batch, "text"))
            letter = pc.fill_null(pc.match_substring_regex(column(batch, "text"), _LETTER), False).to_numpy(zero_copy_only=False)
            size = np.diff(off)
            names = np.full(len(size), UNKNOWN, object)
            score, rate = np.zeros(len(size)), np.zeros(len(size))
            if langs:
                length = own.lengths(data, off)
                best = length.argmin(axis=1)
                gap = 2.0 ** -(length - length[np.arange(len(size)), best][:, None])
                names = np.where(letter, np.array(langs, object)[best], UNKNOWN)
                score = np.where(letter, 1 / gap.sum(axis=1), 0.0)
                rate = np.where(letter, length.min(axis=1) / np.maximum(size, 1), 0.0)
            arrays = [column(batch, c) for c in keep] + [pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(rate)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "lang_pred", "score", "bits_per_byte"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits_per_byte", DoubleType())])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def training(docs: DataFrame) -> DataFrame:
    return docs.where(~in_fold(F.col("doc_id"), 4, 2)).select("doc_id", "text", "lang")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), fit(training(docs)), ["doc_id"])
    return found.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def accept(docs: DataFrame, model: Model, most_bits: float = MOST_BITS) -> DataFrame:
    """The rows of docs (any columns, with text) in a language of the model: with a letter, and at most most_bits a byte under the best one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in pieces(batches):
            data, off = flat(column(batch, "text"))
            letter = pc.fill_null(pc.match_substring_regex(column(batch, "text"), _LETTER), False).to_numpy(zero_copy_only=False)
            fits = own.lengths(data, off).min(axis=1) <= most_bits * np.diff(off) if own.langs else np.zeros(batch.num_rows, bool)
            yield batch.filter(pa.array(letter & fits))

    return docs.mapInArrow(run, docs.schema)
