"""Operator 5, PII: fixed patterns, and a skip-chain conditional random field that adds spans.

Base spans are the four patterns' leftmost non-overlapping matches, each found in
linear time. The field's nodes are a document's candidate words: those with a digit
or an at sign. Labels are O, email, ip, card, phone. A node's potentials come from
its shape and context features; neighbouring candidates (in the same line) share
chain potentials, and candidates that repeat, or have the same digits or the same
local part, are linked by skip potentials to the next such
candidate, so that the links grow linearly with the document. Loopy belief
propagation (max-product, ``ROUNDS`` rounds) gives each node's label; a candidate
labelled with an entity, with a margin of ``MARGIN``, that no base span overlaps,
becomes a span of that kind. Base spans stay as they are.

Weights are learnt by pseudo-likelihood. Silver labels are the base spans, and O for other candidates, but
for those that look like an entity and only fail its check (``near_misses``: a card number with a wrong
digit, an address with a part over 255, a number of phone form and another length, an at sign without a
domain that the pattern takes): they have no label, as a rule of the base patterns is no evidence about them; the
field's context decides. What the pass over all documents gathers is a count for each (features, neighbours' labels,
linked labels, label), a bounded table, summed by the tasks. Null texts are empty; documents without
candidates have no spans; repeated rows are found each, and count each; ties of labels go to the one listed
first. Texts of any length are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, pieces, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
ROUNDS = 6
MARGIN = 2.0
RIDGE = 1e-6
#: The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_NEAR = re.compile(r"[0-9]{13,19}|[0-9]{3,6}(?:-[0-9]{3,6}){2,4}|[0-9]{1,4}(?:\.[0-9]{1,4}){3}|\+?[0-9][0-9().-]{6,16}[0-9]|[^@]+@[^@]+")
_DIGIT = re.compile(r"[0-9]")
_EDGE = "\"'`([{<>}])|,;:!?*#$%&="


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) < 4 or not p[:-3].strip("0") for p in four) and all(int(p[-3:]) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    some = bool(_DIGIT.search(text))
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if some else [],
        "card": cards(text) if some else [],
        "phone": phones(text) if some and "+" in text else [],
    }


def candidates(text: str) -> list[tuple[int, int]]:
    """The words with a digit or an at sign, without punctuation at their ends."""
    out = []
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and (text[b - 1] in _EDGE or text[b - 1] == "."):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _silver(text: str, nodes: list[tuple[int, int]], base: dict[str, list[tuple[int, int]]]) -> list[int]:
    """The label of each candidate: the kind of a base span that overlaps it (the first as listed)."""
    label = [0] * len(nodes)
    for k, kind in reversed(list(enumerate(KINDS, 1))):
        spans, at = base[kind], 0
        for i, (a, b) in enumerate(nodes):
            while at < len(spans) and spans[at][1] <= a:
                at += 1
            if at < len(spans) and spans[at][0] < b:
                label[i] = k
    return label


def near_misses(text: str, nodes: list[tuple[int, int]]) -> list[bool]:
    """Whether a candidate has an entity's form, but perhaps not what its check asks for."""
    return [bool(_NEAR.fullmatch(text[a:b])) for a, b in nodes]


def features(text: str, a: int, b: int) -> tuple[str, ...]:
    """Few-valued descriptions of a candidate: form, length class, what stands before it."""
    word = text[a:b]
    digits = sum(c in "0123456789" for c in word)
    letters = sum(c.isalpha() for c in word)
    form = "at" if "@" in word else f"dots{min(word.count('.'), 4)}" if "." in word and not letters else "digits" if digits == len(word) else "mixed" if letters else "marks"
    before = text[max(0, a - 2) : a]
    lead = "plus" if word[:1] == "+" else "open" if before[-1:] == "(" else "quote" if before[-1:] in "\"'" and before else "sign" if "=" in before or ":" in before else "none"
    return f"f:{form}", f"n:{form}:{min(digits, 20)}", f"b:{form}:{lead}", f"s:{form}:{min(letters, 6)}"


def _key(text: str, a: int, b: int) -> str:
    """Candidates with equal keys are linked: the same local part, the same digits (5 or more), or the same word."""
    word = text[a:b].lower()
    if "@" in word:
        return "@" + word.partition("@")[0]
    digits = "".join(c for c in word if c in "0123456789")
    return "#" + digits if len(digits) >= 5 else word


def graph(text: str, nodes: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges (next candidate, same line, at most 4 characters between) and skip edges (next one with the same key): two of each a node at most."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= 4 and "\n" not in text[nodes[i][1] : nodes[i + 1][0]]]
    last: dict[str, int] = {}
    skip = []
    for i, (a, b) in enumerate(nodes):
        k = _key(text, a, b)
        if k in last:
            skip.append((last[k], i))
        last[k] = i
    return chain, skip


class Model:
    """unary[feature] and pair weights, all over the labels."""

    def __init__(self, unary: dict[str, np.ndarray], chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip
        self.zero = np.zeros(len(LABELS))

    def label(self, text: str, nodes: list[tuple[int, int]], fixed: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Labels and margins over O by max-product messages; nodes in a base span are clamped to its kind."""
        own = np.array([sum((self.unary.get(f, self.zero) for f in features(text, a, b)), self.zero) for a, b in nodes])
        for i, k in enumerate(fixed):
            if k:
                own[i] = -1e3
                own[i, k] = 0.0
        chain, skip = graph(text, nodes)
        edges = np.array(chain + skip, np.int64).reshape(-1, 2)
        if len(edges):
            weight = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
            src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            both = np.concatenate([weight, weight.transpose(0, 2, 1)])
            message = np.zeros((len(src), len(LABELS)))
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            for _ in range(ROUNDS):
                belief = own.copy()
                np.add.at(belief, dst, message)
                sent = ((belief[src] - message[back])[:, :, None] + both).max(axis=1)
                sent -= sent.max(axis=1, keepdims=True)
                message = 0.5 * message + 0.5 * sent
            np.add.at(own, dst, message)
        best = own.argmax(axis=1)
        return best, own[np.arange(len(own)), best] - own[:, 0]


def _configurations(docs: DataFrame) -> DataFrame:
    """(features, chain neighbours' labels, linked labels, label, n) over all documents."""

    def run(batches):
        for batch in pieces(batches):
            seen: Counter = Counter()
            for text in column(batch, "text").to_pylist():
                if not text or not ("@" in text or _DIGIT.search(text)):
                    continue
                nodes = candidates(text)
                label = _silver(text, nodes, base_spans(text))
                hidden = [near and not k for near, k in zip(near_misses(text, nodes), label)]
                near: list[list[int]] = [[] for _ in nodes]
                far: list[list[int]] = [[] for _ in nodes]
                chain, skip = graph(text, nodes)
                for edges, to in ((chain, near), (skip, far)):
                    for i, j in edges:
                        if not hidden[j]:
                            to[i].append(label[j])
                        if not hidden[i]:
                            to[j].append(label[i])
                for i, (a, b) in enumerate(nodes):
                    if hidden[i]:
                        continue
                    # the labels next to it and linked to it, two of each at most: a bounded set of values
                    seen["|".join(features(text, a, b)), "".join(map(str, sorted(near[i]))), "".join(map(str, sorted(far[i]))), label[i]] += 1
            if seen:
                keys = list(zip(*seen))
                yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(keys[2]), pa.array(keys[3], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["features", "near", "far", "label", "n"])

    return docs.select("text").mapInArrow(run, "features string, near string, far string, label int, n long").groupBy("features", "near", "far", "label").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> Model:
    """Pseudo-likelihood by gradient ascent (Adam) on the counted configurations."""
    rows = _configurations(docs).orderBy("features", "near", "far", "label").toPandas()  # features have a bounded set of values
    names = {f: k for k, f in enumerate(sorted({f for x in rows.features for f in x.split("|")}))}
    m, size = len(LABELS), len(rows)
    if not size:
        return Model({}, np.zeros((m, m)), np.zeros((m, m)))
    at = np.array([[names[f] for f in x.split("|")] for x in rows.features])
    around = np.array([[side.count(str(k)) for side in pair for k in range(m)] for pair in zip(rows.near, rows.far)], float)
    y = np.eye(m)[rows.label.to_numpy()]
    mass = (rows.n.to_numpy(float) / rows.n.sum())[:, None]
    w, g1, g2 = np.zeros((len(names) + 2 * m, m)), 0.0, 0.0
    for step in range(1, 601):
        z = w[at].sum(axis=1) + around @ w[len(names) :]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = mass * (p - y)
        grad = RIDGE * w
        for k in range(at.shape[1]):
            np.add.at(grad, at[:, k], error)
        grad[len(names) :] += around.T @ error
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.99 * g2 + 0.01 * grad**2
        w -= 0.1 * (g1 / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.99**step)) + 1e-8)
    chain, skip = w[len(names) : len(names) + m], w[len(names) + m :]
    return Model({f: w[k] for f, k in names.items()}, (chain + chain.T) / 2, (skip + skip.T) / 2)


def entities(text: str, model: Model) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans by kind, and all spans (base and added) by kind as listed, then start."""
    base = base_spans(text)
    every = [(k, kind, a, b) for k, kind in enumerate(KINDS) for a, b in base[kind]]
    if "@" in text or _DIGIT.search(text):
        nodes = candidates(text)
        fixed = _silver(text, nodes, base)
        if nodes and not all(fixed):
            best, margin = model.label(text, nodes, fixed)
            every += [(best[i] - 1, KINDS[best[i] - 1], a, b) for i, (a, b) in enumerate(nodes) if best[i] and not fixed[i] and margin[i] >= MARGIN]
    return base, [(kind, int(a), int(b)) for _, kind, a, b in sorted(every)]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, model: Model) -> DataFrame:
    """Counts and digest of the base spans and all spans of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in pieces(batches):
            rows = []
            for key, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()):
                base, every = entities(text or "", own)
                listed = ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in base[k])
                rows.append((key, *(len(base[k]) for k in KINDS), hashlib.sha256(listed.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in every)))
            kinds = (*[pa.int64()] * 5, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, fit(docs))
