"""The registered queries of the corpus operators, over tables in a folder, against brute force; and what they find of all pairs of the test tables."""

import collections
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import common, lines, neardup, registry

from .test_llm import ODD, PII, SCHEMA, SECRETS, components, edits, line_key, plain_language_model, plain_spans, prose, shingle_bag, tokens, brute_targets


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(17)
    out = []
    for i in range(150):
        la = ("en", "de", "fr")[i % 3]
        text = prose(rng, la, rng.randint(20, 120))
        if i % 7 == 0:
            text += f" mail a{i}@b.example.com or 10.0.{i}.300 or 192.168.0.{i} token=abc{i}defg AKIA{'X' * 18}{i} +49 (30) 12345-{i:03}"
        if i % 10 == 0:
            text += " idiot scum idiot moron"
        out.append((i, text, la, f"src{i % 4}", len(text)))
    for k in range(150, 180):
        words = out[k % 20][1].split(" ")
        if k % 2:
            words[rng.randrange(len(words))] = "other"
        out.append((k, " ".join(words), "en", "src0", None))
    return out + ODD


BENCH = [(i, prose(random.Random(50 + i), "en", 20)) for i in range(4)] + [(9, None), (None, "a passage that has no id but is long enough to be found")]


@pytest.fixture(scope="module")
def run(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    held = [(500 + k, f"begin {p} end", "en", "src1", 0) for k, (_, p) in enumerate(BENCH) if p]
    rows = rows + held
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(150)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    done = {}

    def call(name):
        if name not in done:
            done[name] = registry.queries()[name](spark, folder).collect()
        return done[name]

    call.rows, call.folder = rows, folder
    return call


def fold(i, mod):
    return None if i is None else zlib.crc32(str(i).encode()) % mod


def by_id(found):
    out = collections.defaultdict(list)
    for r in found:
        out[r.doc_id].append(r)
    return out


def test_op1(run):
    bags = {k: shingle_bag(t) for k, (_, t, *_) in enumerate(run.rows)}
    pairs = [(a, b) for a, x in bags.items() for b, y in bags.items() if a < b and x and y and sum((x & y).values()) >= (0.8 - 1e-12) * sum((x | y).values())]
    groups = collections.defaultdict(list)
    for k, root in components(pairs, bags).items():
        groups[root].append(run.rows[k][0])
    want = collections.Counter()
    for members in groups.values():
        least = min((m for m in members if m is not None), default=None)
        want.update((m, least, len(members)) for m in members)
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in run("op1_neardup")) == want and len(pairs) > 20


def test_op2(run):
    got = by_id(run("op2_langid"))
    assert sum(map(len, got.values())) == len(run.rows)
    for i, t, la, *_ in run.rows:
        r = got[i][0]
        assert r.held_out is (fold(i, 4) == 2) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif la and len(t) > 60 and i is not None and i < 150:
            assert r.lang_pred == la


def test_op3(run):
    size = collections.Counter()
    for _, t, _, s, _ in run.rows:
        size[s] += len(tokens(t))
    want, taken = brute_targets(size), collections.Counter()
    got = run("op3_mixing")
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len(tokens(t))) for i, t, *_ in run.rows)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    # what is left open is one document of each source
    most = {s: max((r.size for r in got if r.source == s), default=0) for s in size}
    assert all(abs(taken[s] - want[s]) <= most[s] for s in size) and abs(taken["src0"] - want["src0"]) <= 60


def test_op4(run):
    where, nodes = {}, set()
    for i, t, *_ in dict.fromkeys(run.rows):  # rows with equal id and text are one document
        for k, line in enumerate((t or "").split("\n")):
            if key := line_key(line):
                where[(i is None, i or 0, k)] = key
                nodes.add(key)
    sets = {n: {n[j : j + 8] for j in range(len(n) - 7)} for n in nodes}
    listed = sorted(nodes)
    root = components([(a, b) for x, a in enumerate(listed) for b in listed[x + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= (0.8 - 1e-12) * len(sets[a] | sets[b])], nodes)
    first = {}
    for at in sorted(where):
        first.setdefault(root[where[at]], at)
    for r in run("op4_lines"):
        own = sorted((at, first[root[key]]) for at, key in where.items() if at[:2] == (r.doc_id is None, r.doc_id or 0))
        gone = [(at[2], f[1], f[2]) for at, f in own if at != f]
        assert (r.n_lines, r.n_kept) == (len(own), len(own) - len(gone))
        assert r.removed_lines == ",".join(str(k) for k, *_ in gone) and r.copies_of == ",".join(f"{k}:{i}:{n}" for k, i, n in gone)
    assert len(run("op4_lines")) == len(run.rows)


@pytest.mark.parametrize("name,kinds", [("op5_pii", PII), ("op9_secrets", SECRETS)])
def test_op5_and_op9(run, name, kinds):
    got, some = by_id(run(name)), 0
    assert sum(map(len, got.values())) == len(run.rows)
    for i, t, *_ in run.rows:
        spans = plain_spans(kinds, t or "")
        flat = [f"{k}:{a}:{b}" for k in kinds for a, b in spans[k]] if name == "op5_pii" else [f"{k}:{a}:{b}" for a, _, k, b in sorted((a, o, k, b) for o, k in enumerate(kinds) for a, b in spans[k])]
        digest = hashlib.sha256(",".join(flat).encode()).hexdigest()
        r = next(x for x in got[i] if x.base_sha256 == digest)
        assert [r[f"n_{k}"] for k in kinds] == [len(spans[k]) for k in kinds] and set(flat) <= set(r.spans.split(",")) | {""}
        some += len(flat)
    assert some > 40


def test_op6(run):
    norm = lambda t: " ".join((t or "").lower().split())
    want = {}
    for d, t, *_ in run.rows:
        for i, p in BENCH:
            if p and t and len(t) < 5000:
                e = edits(norm(p), norm(t))
                if e <= int(len(norm(p)) * 0.08):
                    want[d, i] = e
    assert {(r.doc_id, r.item_id): r.distance for r in run("op6_decontam")} == want and len(want) == 5


def test_op7(run):
    _, scored = plain_language_model(run.rows)
    got = by_id(run("op7_lm"))
    for i, t, *_ in run.rows:
        n, known, total, base, score, symbols = scored(t)
        r = next(x for x in got[i] if x.n_tokens == n)
        assert r.held_out is (fold(i, 7) == 2) and (r.n_known, r.train_tokens) == (known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-5) and r.symbol_score == pytest.approx(symbols, rel=1e-9)


def test_op8(spark, run, tmp_path):
    got = by_id(run("op8_toxicity"))
    assert sum(map(len, got.values())) == len(run.rows)
    for i, *_ in run.rows:
        r = got[i][0]
        assert r.held_out is (fold(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert np.mean([got[i][0].predicted == int(i % 10 == 0) for i in range(150)]) > 0.97
    # labels of the fold that is held out are never read
    folder = str(tmp_path)
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{run.folder}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    labels = spark.read.parquet(f"{run.folder}/labels.parquet")
    labels.withColumn("toxic", F.when(common.in_fold(F.col("doc_id"), 5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{folder}/labels.parquet")
    again = registry.queries()["op8_toxicity"](spark, folder).collect()
    key = lambda r: (str(r.doc_id), r.score, r.segments)
    assert sorted(map(key, again)) == sorted(map(key, run("op8_toxicity")))


def test_op10(run):
    texts = collections.defaultdict(list)
    for i, t, *_ in run.rows:
        texts[i].append((t or "").encode())
    same = {}
    for r in run("op10_media"):
        raw = next(x for x in texts[r.doc_id] if len(x) == r.n_bytes)
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert same.setdefault(raw, r[5:]) == r[5:] and r.n_tiles == r.feature.count(".") + 1


# recall over the given tables


def whole_table(sf):
    import duckdb

    path = f"/root/testdata/{sf}/documents.parquet"
    return duckdb.sql(f"select doc_id, text from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'").fetchall()


def similar_pairs(sets, threshold):
    """All pairs of sorted arrays of distinct values that are similar: candidates share one of the rarest values, by the prefix bound."""
    every = np.concatenate(list(sets.values()))
    value, count = np.unique(every, return_counts=True)
    post = collections.defaultdict(list)
    for k, s in sets.items():
        n = count[np.searchsorted(value, s)]
        for v in s[np.lexsort((s, n))][: len(s) - math.ceil(threshold * len(s) - 1e-9) + 1].tolist():
            post[v].append(k)
    asked = {(a, b) for held in post.values() for i, a in enumerate(held) for b in held[i + 1 :]}
    out = []
    for a, b in asked:
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= threshold * max(len(x), len(y)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= (threshold - 1e-12) * (len(x) + len(y) - both):
                out.append((a, b))
    return out


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the test tables")
def test_recall_of_near_duplicates(spark, capsys):
    rows = whole_table("sf0.1")
    sets, same = {}, {}
    for a in range(0, len(rows), 500):
        part = rows[a : a + 500]
        data, off = np.frombuffer("".join(t or "" for _, t in part).encode(), np.uint8), np.cumsum([0, *(len((t or "").encode()) for _, t in part)])
        key, doc, node = neardup.shingles(data, off)
        key, doc, n = neardup.counted(key, doc)
        for k, (i, _) in enumerate(part):
            own = doc == k
            if node[k]:
                same[i] = int(node[k])
                sets.setdefault(int(node[k]), np.sort(np.concatenate([common.mix(key[own] + np.uint64(j)) for j in range(int(n[own].max()))][:1] + [common.mix(key[own][n[own] > j] + np.uint64(j)) for j in range(1, int(n[own].max()))])))
    pairs = similar_pairs(sets, 0.8)
    root = components(pairs, sets)
    got = {r.doc_id: r.class_id for r in neardup.op1_neardup(spark, "/root/testdata/sf0.1").collect()}
    class_of = {}
    for i, node in same.items():
        class_of.setdefault(node, set()).add(got[i])
    found = sum(class_of[a] == class_of[b] for a, b in pairs)
    groups = collections.defaultdict(set)
    for i, node in same.items():
        groups[root[node]].add(got[i])
    whole = sum(len(x) == 1 for x in groups.values())
    with capsys.disabled():
        print(f"\nnear-duplicates at scale factor 0.1: {found} of {len(pairs)} pairs, {whole} of {len(groups)} groups")
    assert found >= 0.99 * len(pairs) and whole >= 0.99 * len(groups) and len(set(got[i] for i in same)) >= len(groups)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="needs the test tables")
def test_recall_of_lines(spark, capsys):
    rows = whole_table("sf0.01")
    nodes, where = set(), {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if key := line_key(line):
                where[i, k] = key
                nodes.add(key)
    sets = {n: lines.gram_set(n) for n in nodes if len(n) >= lines.Q}
    root = components(similar_pairs(sets, 0.8), nodes)
    gone = {}
    for r in lines.op4_lines(spark, "/root/testdata/sf0.01").collect():
        for x in filter(None, r.copies_of.split(",")):
            k, i, n = map(int, x.split(":"))
            gone[r.doc_id, k] = (i, n)
    first = {}
    for at in sorted(where):
        first.setdefault(root[where[at]], at)
    want = {at: first[root[key]] for at, key in where.items() if first[root[key]] != at}
    right = sum(gone.get(at) == f for at, f in want.items())
    with capsys.disabled():
        print(f"\nlines at scale factor 0.01: {right} of {len(want)} copies with the line that stays, {len(gone.keys() - want.keys())} others")
    assert right >= 0.99 * len(want) and not gone.keys() - want.keys()
