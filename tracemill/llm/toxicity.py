"""Operator 8, toxicity: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

Token weights are log-odds of toxic against other labelled documents (a document
counts a token once) under an informative Dirichlet prior: pseudo-counts in
proportion to the pooled counts, ``FLOOR`` at least. Only tokens with |z| >= ``Z``
and |weight| >= ``EFFECT`` keep a weight, all others have the drift ``rest``
(negative), so that segments end. Each text is scanned once, in linear time, for
all its maximal scoring segments. A segment's score S becomes an E-value K n
exp(-lambda S) with lambda the positive root of sum p(s) exp(lambda s) = 1 over
the tokens of non-toxic documents, and K counted in a random text of such tokens; significant segments (E <= ``E_MOST``) are
returned as spans of tokens. A logistic curve on the evidence of a document (the
sum of -log E over its significant segments, or of its best one) maps it to 0 to 1; its middle is the cut with the fewest
errors on the sample.

Fitted on at most ``SAMPLE`` labelled documents of each class, chosen by a hash of
the id; every document is scored. Null and empty texts have no segment and get the
score of evidence zero. With labels of one class only, or none, scores are 0. Every token that the sample marks
as significant is weighted. Repeated rows are scored each, and weigh as often as they are labelled; ties of segments are told
apart by place; texts of any length are scanned whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, column, flat, in_fold, pieces, span_hashes, table, words

SAMPLE = 6000
PRIOR = 500.0
FLOOR = 0.5
Z = 2.5
EFFECT = 1.0
#: Tokens of the random text that gives K, and how many segments it counts.
RANDOM_TOKENS, COUNTED = 1 << 20, 400
E_MOST = 0.05
_STRIP = np.zeros(256, bool)
_STRIP[[x for x in range(33, 127) if not chr(x).isalnum()]] = True


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and document of each word, A-Z as a-z, without ASCII punctuation at either end (all-punctuation words stay)."""
    low = LOWER[data]
    start, end, doc = words(low, off)
    core = np.flatnonzero(~_STRIP[low] & ~IS_SPACE[low])
    if not len(core):
        return span_hashes(low, start, end), start, end, doc
    first = np.searchsorted(core, start)
    some = core[np.minimum(first, len(core) - 1)]
    some = (some >= start) & (some < end)
    s = np.where(some, core[np.minimum(first, len(core) - 1)], start)
    e = np.where(some, core[np.searchsorted(core, end) - 1] + 1, end)
    return span_hashes(low, s, e), start, end, doc


def segments(weight: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time (Ruzzo and Tompa)."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total = 0.0
    for at, w in enumerate(weight):
        before, total = total, total + w
        if w <= 0:
            continue
        start = at
        left = before
        while found:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= left:
                k -= 1
            if k < 0 or found[k][3] >= total:
                break
            start, left = found[k][0], found[k][2]
            del found[k:]
        found.append((start, at + 1, left, total))
    return [(a, b, r - l) for a, b, l, r in found]


def runs(at: np.ndarray, weight: np.ndarray, n: int, rest: float) -> list[tuple[int, int, float]]:
    """segments() of n tokens that weigh rest but for those at the given places; linear in the weighted tokens."""
    places, values = [], []
    last = 0
    for a, w in zip(at.tolist(), weight.tolist()):
        if a > last:
            places.append((last, a))
            values.append((a - last) * rest)
        places.append((a, a + 1))
        values.append(w)
        last = a + 1
    return [(places[a][0], places[b - 1][1], s) for a, b, s in segments(np.array(values))]


class Model:
    def __init__(self, keys, weights, rest, lam, k, slope, offset):
        self.keys, self.weights, self.rest, self.lam, self.k, self.slope, self.offset = keys, weights, rest, lam, k, slope, offset

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> tuple[float, list[tuple[int, int, float]]]:
        """Sum of -ln E over the significant segments; if there is none, that of the best one where positive."""
        e = [math.log(self.k * max(n, 1)) - self.lam * s for _, _, s in found]
        strong = [(a, b, s) for (a, b, s), x in zip(found, e) if x <= math.log(E_MOST)]
        total = sum(-x for x in e if x <= math.log(E_MOST))
        return (total if strong else max([0.0, *(-x for x in e)])), strong

    def scan(self, data: np.ndarray, off: np.ndarray) -> list[tuple[float, int, list]]:
        """Evidence, number of tokens and significant segments of each document."""
        h, _, _, doc = tokens(data, off)
        size = np.bincount(doc, minlength=len(off) - 1)
        out = [(0.0, int(n), []) for n in size]
        if not len(self.keys) or not len(h):
            return out
        place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[place] == h)
        first = np.concatenate([[0], np.cumsum(size)])
        bounds = np.searchsorted(doc[hit], np.arange(len(size) + 1))
        for d in np.flatnonzero(np.diff(bounds)):
            own = hit[bounds[d] : bounds[d + 1]]
            weight = self.weights[place[own]]
            if (weight > 0).any():
                found = runs(own - first[d], weight, int(size[d]), self.rest)
                total, strong = self.evidence(found, int(size[d]))
                out[d] = (total, int(size[d]), strong)
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -60, 60)))


NONE = Model(np.zeros(0, np.uint64), np.zeros(0), -1.0, 1.0, 1.0, 0.0, -60.0)


def _token_counts(df: DataFrame) -> DataFrame:
    def run(batches):
        for batch in pieces(batches):
            h, _, _, doc = tokens(*flat(column(batch, "text")))
            toxic = column(batch, "toxic").to_numpy(zero_copy_only=False).astype(np.int64)[doc]
            order = np.lexsort((doc, h))
            h, doc, toxic = h[order], doc[order], toxic[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, toxic = h[once], toxic[once]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            bad, every = (np.add.reduceat(x, first) if len(h) else first for x in (toxic, np.ones_like(toxic)))
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(bad, pa.int64()), pa.array(every - bad, pa.int64())], ["token", "bad", "good"])

    return df.select("text", "toxic").mapInArrow(run, "token long, bad long, good long").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _root(value: np.ndarray, share: np.ndarray) -> float:
    """The positive lambda with sum share exp(lambda value) = 1; the mean is negative and some value positive."""
    low, high = 0.0, 1.0
    f = lambda x: float((share * np.exp(np.minimum(x * value, 700))).sum()) - 1
    while f(high) < 0 and high < 1e3:
        high *= 2
    low = high / 2**40
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def extreme_k(weight: np.ndarray, share: np.ndarray, rest: float, lam: float, n: int = RANDOM_TOKENS, counted: int = COUNTED) -> float:
    """K of the law that random text of n tokens has K n exp(-lam S) segments of score S or more: counted in such a text, from a fixed seed."""
    rng = np.random.default_rng(20_240_811)
    at = np.flatnonzero(rng.random(n) < share.sum())
    found = runs(at, weight[rng.choice(len(weight), len(at), p=share / share.sum())], n, rest)
    scores = np.sort([s for *_, s in found])[-counted:]
    return max(1e-9, len(scores) / n * math.exp(min(lam * float(scores[0]), 700.0))) if len(scores) else 1.0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on documents (doc_id, text) and labels (doc_id, toxic); a document labelled twice counts as toxic if any label says so."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas() for c in (0, 1)]
    if not all(len(p) for p in picked):
        return NONE
    chosen = spark.createDataFrame([(int(d), int(t)) for p in picked for d, t in zip(p.doc_id, p.toxic)], "doc_id long, toxic int")
    sampled = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    count = _token_counts(sampled)
    sums = count.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    if not sums.bad or not sums.good:
        return NONE
    prior = F.lit(FLOOR) + F.lit(PRIOR) * (F.col("bad") + F.col("good")) / F.lit(float(sums.bad + sums.good))
    odds = lambda n, total: F.log((F.col(n) + prior) / (F.lit(float(total) + PRIOR) - F.col(n) - prior))
    weighed = count.withColumn("w", odds("bad", sums.bad) - odds("good", sums.good)).withColumn("z", F.col("w") / F.sqrt(1 / (F.col("bad") + prior) + 1 / (F.col("good") + prior)))
    strong = weighed.where((F.abs("z") >= Z) & (F.abs("w") >= EFFECT)).orderBy("token").toPandas()  # tokens of the sample
    if not len(strong) or not (strong.w > 0).any():
        return NONE
    key = strong.token.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    strong, key = strong.iloc[order], key[order]
    weight = strong.w.to_numpy(float)
    plain = max(1.0, float(sums.good) - strong.good.sum())
    # the drift of all other tokens: small against a toxic token, yet the mean over clean text is negative
    share = strong.good.to_numpy(float) / float(sums.good)
    rest = min(-0.02, -1.5 * max(0.0, float((share * weight).sum())) * float(sums.good) / plain - 0.02)
    value, part = np.append(weight, rest), np.append(np.maximum(share, 0.5 / float(sums.good)), plain / float(sums.good))
    lam = _root(value, part / part.sum())
    model = Model(key, weight, rest, lam, 1.0, 1.0, 0.0)
    model.k = extreme_k(weight, part[:-1] / part.sum(), rest, lam)

    def run(batches):
        for batch in pieces(batches):
            got = model.scan(*flat(column(batch, "text")))
            yield pa.RecordBatch.from_arrays([column(batch, "toxic").cast(pa.int32()), pa.array([x[0] for x in got], pa.float64())], ["toxic", "evidence"])

    seen = sampled.mapInArrow(run, "toxic int, evidence double").toPandas()  # two classes of at most sample rows
    x, y = np.log1p(seen.evidence.to_numpy(float)), seen.toxic.to_numpy(float)
    mass = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    a, b = 1.0, -1.0
    for _ in range(200):  # ridge-penalised logistic regression by Newton steps
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(mass * (p - y) * x).sum() + 1e-3 * a, (mass * (p - y)).sum() + 1e-3 * b])
        q = mass * p * (1 - p)
        h = np.array([[(q * x * x).sum() + 1e-3, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    model.slope = max(float(a), 1e-3)
    model.offset = -model.slope * fewest_errors(x, y)
    return model


def fewest_errors(x: np.ndarray, y: np.ndarray) -> float:
    """The value between two of x above which y = 1 with the fewest errors; of equally good ones that in the widest gap."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    errors = np.concatenate([[(1 - y).sum()], (1 - y).sum() + np.cumsum(2 * y - 1)])  # with the cut before each place, and after the last
    edge = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    gap = np.diff(edge)
    best = min(range(len(errors)), key=lambda k: (errors[k] if gap[k] > 0 else np.inf, -gap[k]))
    return float(edge[best] + edge[best + 1]) / 2


SCHEMA = "doc_id long, score double, predicted int, n_segments int, segments string"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score (doc_id, text): score, predicted, and the significant passages as token ranges start:end."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in pieces(batches):
            got = own.scan(*flat(column(batch, "text")))
            p = own.score(np.log1p(np.array([x[0] for x in got])))
            arrays = [column(batch, "doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([len(x[2]) for x in got], pa.int32()), pa.array([",".join(f"{a}:{b}" for a, b, _ in x[2]) for x in got])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "predicted", "n_segments", "segments"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~in_fold(F.col("doc_id"), 5, 0))
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "n_segments", "segments")
