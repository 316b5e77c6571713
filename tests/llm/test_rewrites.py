"""Substring dedup, fill-in-the-middle and the divergence audit against brute force, on small tables with odd rows."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.llm import divergence, exchange, fim, substrings

from .test_llm import ODD, SCHEMA, prose

EXTRA = ("n", "form", "output", "block", "range", "keys", "terms", "groups", "salt", "rank", "value", "removed", "kept")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, prose(rng, ("en", "de", "fr")[i % 3], rng.randint(5, 150)), ("en", "de", "fr")[i % 3], f"src{i % 4}", 0) for i in range(90)]
    passage = prose(rng, "en", 60)
    for k in range(90, 130):  # copies, parts and passages
        words = out[k % 30][1].split()
        a = rng.randrange(len(words))
        kind = k % 4
        text = [out[k % 30][1], " ".join(words[a:]), f"{prose(rng, 'en', 9)} {passage} x{k}", "\n\t".join(words)][kind]
        out.append((k, text, (None, "en")[k % 2], (None, "src1", "src9")[k % 3], 0))
    out += [(40, out[7][1], "en", "src0", 0), (40, out[7][1], "en", "src0", 0), (None, passage, "", "", 0), (None, passage, None, None, 0)]
    out += [(9100, "a<P", "en", "src0", 0), (9101, "has <M> in it", "en", "src0", 0), (9102, "lone lone lone", "xx", "only", 0), (-5, " ".join(f"W{k}" for k in range(3000)), "en", "src0", 0), (9200, " ".join(f"W{k}" for k in range(2990)), "en", "src0", 0)]
    return out + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.select("*", *(F.lit("clash").alias(x) for x in EXTRA))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)




def split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# substrings


def plain_removed(rows, window):
    """For each row: words, kept words, and the longest doubled window that starts in a row with a smaller id."""
    last = 2**63 - 1
    words = [split(t) for _, t, *_ in rows]
    ids = [last if i is None else i for i, *_ in rows]
    longest, gone, length = [0] * len(rows), [set() for _ in rows], window
    while True:
        least = {}
        for k, w in enumerate(words):
            for a in range(len(w) - length + 1):
                key = tuple(w[a : a + length])
                least[key] = min(least.get(key, last), ids[k])
        some = False
        for k, w in enumerate(words):
            for a in range(len(w) - length + 1):
                some = True
                if least[tuple(w[a : a + length])] < ids[k]:
                    longest[k] = length
                    if length == window:
                        gone[k].update(range(a, a + length))
        if not some:
            break
        length *= 2
    return [(len(w), len(g), " ".join(x for j, x in enumerate(w) if j not in g), n) for w, g, n in zip(words, gone, longest)]


@pytest.mark.parametrize("window,small", [(13, False), (13, True), (4, True)])
def test_substrings_equal_brute_force(spark, rows, docs, monkeypatch, window, small):
    if small:  # many blocks and ranges
        monkeypatch.setattr(exchange, "SIDE", 400)
        monkeypatch.setattr(exchange, "LEAST", 0)
    rows = [r for r in rows if r[0] != 9005]  # its 40,000 equal words are for the next test
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept, r.longest) for r in substrings.remove(docs.where("doc_id is null or doc_id <> 9005"), window).collect())
    want = collections.Counter((r[0], *x) for r, x in zip(rows, plain_removed(rows, window)))
    assert got == want and sum(x[2] for x in got) > 3000 and max(x[4] for x in got) == window * 2 ** {13: 7, 4: 9}[window]


def test_substrings_of_long_repeats(spark, docs):
    """A long run of one word repeats within its document only, and then in a later one too."""
    long = docs.where("doc_id = 9005")
    assert [(r.n_words, r.n_removed, r.longest) for r in substrings.remove(long).collect()] == [(40_000, 0, 0)]
    both = long.unionByName(long.withColumn("doc_id", F.lit(9999).cast("long")).withColumn("text", F.expr("concat('begin ', text)")))
    got = {r.doc_id: r for r in substrings.remove(both).collect()}
    assert got[9005].n_removed == 0 and (got[9999].n_words, got[9999].n_removed, got[9999].kept) == (40_001, 40_000, "begin")
    assert [tuple(x) for x in got[9999].removed] == [(1, 40_001)] and got[9999].longest == 13 * 2**11


def test_no_rows(empty):
    assert substrings.remove(empty).count() == 0 and fim.transform(empty).count() == 0 and divergence.audit(empty).count() == 0


def test_requests_grow_with_the_corpus():
    """Rows of requests for each key stay below a bound at any size, and memory grows with the square root."""
    for keys in (10**4, 10**7, 10**10, 10**13):
        side = exchange.side(keys)
        blocks, ranges = -(-keys // side), -(-keys // side)
        assert blocks * ranges <= max(4, 1.1 * keys / exchange.LEAST) and side <= max(exchange.SIDE, 4.1 * keys**0.5)


def test_packed_bits_and_sorted_places():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 1000):
        bits = rng.integers(0, 2, n).astype(bool)
        assert (exchange.unpack_bits(exchange.pack_bits(bits), n) == bits).all()
        places = np.sort(rng.integers(0, 1 << 40, n))
        assert (exchange.unpack_sorted(exchange.pack_sorted(places), n, np.int64) == places).all()


# fill-in-the-middle


def plain_fim(doc_id, text, rate=90, spm=20):
    units, k, text = [], 0, text or ""
    letter = lambda c: "a" <= c <= "z" or "A" <= c <= "Z"
    while k < len(text):
        j = k + 1
        while letter(text[k]) and j < len(text) and letter(text[j]):
            j += 1
        units.append(text[k:j])
        k = j
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * j : 8 * j + 8], 16) for j in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("rate,spm", [(90, 20), (100, 50)])
def test_fim_equals_brute_force_and_restores(rows, docs, rate, spm):
    found = fim.transform(docs, rate=rate, suffix_first=spm)
    got = collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found.collect())
    assert got == collections.Counter((r[0], *plain_fim(r[0], r[1], rate, spm)) for r in rows)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    texts = collections.Counter((r.doc_id, r.t) for r in found.select("doc_id", fim.restored().alias("t")).collect())
    assert texts == collections.Counter((r[0], r[1] or "") for r in rows)
    digests = collections.Counter(tuple(r) for r in found.select("doc_id", fim.digests().alias("d")).select("doc_id", "d.*").collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert digests == collections.Counter((r[0], sha(plain_fim(r[0], r[1], rate, spm)[4]), sha(r[1] or "")) for r in rows)


def test_markers_beside_borders_restore():
    rng = random.Random(8)
    for k in range(3000):
        text = "".join(rng.choice("<PSM>a<") for _ in range(rng.randint(0, 9)))
        n, form, _, _, output = fim.cut_text(text, [rng.getrandbits(32) for _ in range(4)], 100, 50)
        assert fim.restore(output, form) == text and n == len(fim.unit_ends(text))


# divergence


def plain_audit(rows, least=3, top=200):
    terms = lambda t: "".join(c if c > "\x7f" or "a" <= c <= "z" or "A" <= c <= "Z" else " " for c in t).split(" ")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, count = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, t, la, s, _ in rows:
        found = [x for x in terms((t or "").translate(low)) if x]
        held[la or ""].update(set(found))
        count[la or "", s or ""].update(found)
    out = set()
    for lang in held:
        kept = sorted((x for x, n in held[lang].items() if n >= least), key=str.encode)
        share = lambda c: {x: 1 + 10**9 * (c[x] + 1) // (sum(c[y] for y in kept) + len(kept)) for x in kept}  # noqa: B023, E731
        sources = sorted(s for la, s in count if la == lang)
        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), collections.Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][x] - p[o][x]) ** 2 // p[o][x] for x in kept)) for o in sources if o != s]
            leading = [(x, (p[s][x] - q[x]) ** 2 // q[x]) for x in kept if count[lang, s][x] and p[s][x] > q[x]]
            for part, found, most in (("pair", pairs, None), ("term", leading, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, x, v, k) for k, (x, v) in enumerate(found[:most], 1)}
    return out


@pytest.mark.parametrize("top,cells", [(200, 1 << 20), (5, 60)])
def test_audit_equals_brute_force(rows, docs, monkeypatch, top, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)  # a few terms a chunk
    plain = docs.drop("rank", "value")
    got = [tuple(r) for r in divergence.audit(plain, top=top).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, top=top) and {x[2] for x in got} == {"pair", "term"}


def test_ties_have_the_order_of_bytes(spark):
    """Terms of equal value, among them ones whose UTF-16 order is another than their UTF-8 order."""
    words = ["ﬁn", "\U0001f600", "zed", "\xe9t\xe9", "Abc"]
    rows = [(k, " ".join(words) if k % 2 else "rest rest rest", "en", f"s{k % 2}", 0) for k in range(8)]
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA)).where("part = 'term' and source = 's1'").orderBy("rank").collect()
    assert [r.item for r in got] == sorted((w.lower() if w.isascii() else w for w in words), key=str.encode)


def test_shares_are_exact_for_large_counts():
    for total in (7, 10**12 + 7, 2**53 + 1, 10**17):
        counts = np.array([0, 1, total // 3, total - 1, 10**15 % total])
        assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts.tolist()]


def test_rows_of_one_term_over_many_batches(spark):
    """A term whose counts fill more than a batch is one term."""
    table = pa.table({"lang": ["en"] * 90, "source": [f"s{k % 3}" for k in range(90)], "term": ["one"] * 80 + ["two"] * 10, "n": [1] * 90, "docs": [1] * 90}, schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())]))
    divergence_rows = divergence.ROWS
    divergence.ROWS = 40
    try:
        found = [r for b in divergence._chunked(3, 100)(iter(table.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    finally:
        divergence.ROWS = divergence_rows
    assert [(r["terms"], sum(r["sums"])) for r in found] == [(["one"], 80), (["two"], 10)]
