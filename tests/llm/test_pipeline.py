"""The corpus pipeline's stages against plain computations on a small corpus."""

import glob
import random

from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import common, mixing

from .test_llm import SCHEMA, prose, shingle_bag


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, prose(rng, ("en", "de", "fr")[i % 3], 150), ("en", "de", "fr")[i % 3], f"s{i % 3}") for i in range(60)]
    bench = [(i, prose(rng, "en", 30)) for i in range(3)]
    header = "A common header line of many documents.\n"
    rows = [(i, header + t if i < 20 else t, la, s) for i, t, la, s in rows]
    rows += [(100, rows[30][1], "en", "s0")]  # an exact copy
    changed = rows[31][1].split(" ")
    changed[70] = "other"
    rows += [(101, " ".join(changed).replace("\n", " "), "de", "s1")]  # a near copy on one line
    rows += [(102, prose(rng, "en", 40) + " " + bench[1][1], "en", "s2"), (103, "12 34 !!", "en", "s0"), (104, None, None, None)]
    docs = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], SCHEMA)
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    seen = {}
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = common.cut(stage(spark, now, sf), name)
        if name != "mix":
            assert out.columns == docs.columns
        seen[name] = {r.doc_id: r for r in out.collect()}
        now = out
    ids = {i for i, *_ in rows}
    assert set(seen["language"]) == ids - {103, 104}
    assert set(seen["lines"]) == ids - {103, 104, 100}
    assert seen["lines"][0].text.startswith(header) and not any(header.strip() in seen["lines"][i].text for i in range(1, 20))
    assert set(seen["neardup"]) == ids - {103, 104, 100, 101}
    bags = {i: shingle_bag(r.text) for i, r in seen["neardup"].items()}
    assert not any(a < b and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()) for a in bags for b in bags)
    assert set(seen["decontaminate"]) == ids - {103, 104, 100, 101, 102}
    mixed = seen["mix"].values()
    size = {i: len(r.text.split()) for i, r in seen["decontaminate"].items()}
    assert all(r.copies > 0 and r.taken == r.copies * size[r.doc_id] for r in mixed)
    total = sum(size.values())
    for s, w in zip(("s0", "s1", "s2"), (5, 2, 1)):
        want = min(3 * sum(n for i, n in size.items() if seen["decontaminate"][i].source == s), total * w / 8)
        assert abs(sum(r.taken for r in mixed if r.source == s) - want) < 200
    tables_before = set(glob.glob(f"{common.shared_root(spark)}/tracemill/*"))
    result = corpus_pipeline.run(spark, sf)
    again = {r.doc_id: r for r in result.collect()}
    assert {i: r.taken for i, r in again.items()} == {r.doc_id: r.taken for r in mixed}
    # the corpus comes with its texts and columns, and the result's own table is the only one left
    assert result.columns == [*docs.columns, "size", "source_size", "target", "copies", "taken"]
    assert all((r.text, r.lang, r.source) == tuple(seen["decontaminate"][i][c] for c in ("text", "lang", "source")) for i, r in again.items())
    assert len(set(glob.glob(f"{common.shared_root(spark)}/tracemill/*")) - tables_before) == 1


def tables(spark, folder, rows, bench, extra=()):
    schema = SCHEMA + "".join(f", {x} string" for x in extra)
    spark.createDataFrame([(i, t, la, s, None if t is None else len(t), *("x" for _ in extra)) for i, t, la, s in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_no_documents_and_no_benchmark(spark, tmp_path):
    tables(spark, str(tmp_path), [], [])
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = common.cut(stage(spark, now, str(tmp_path)), name)
        assert out.count() == 0 and (name == "mix" or out.columns == now.columns)
        now = out


def test_clashing_columns_nulls_long_texts_and_repeated_ids(spark, tmp_path):
    """Each stage keeps all columns whatever their names, texts of any length, rows that only share an id, and rows without one."""
    rng = random.Random(41)
    plain = lambda n: prose(rng, "en", n).replace("\n", " ")
    long = " ".join(plain(40) for _ in range(600))
    a, b, c = plain(60), plain(60), plain(60)
    rows = [(k, plain(80), "en", "s0") for k in range(30)]
    rows += [(300, long, "en", "s1"), (301, a, "en", "s1"), (302, a, None, None), (302, b, "en", "s1"), (302, b, "en", "s1"), (None, c, "en", None), (None, plain(50), None, "s1"), (303, None, "en", "s0"), (304, "", "en", "s0"), (305, " \n ", "en", "s0")]
    extra = ("node", "row", "row_", "root", "line", "score", "lang_pred", "item_id", "part", "dropped_lines_", "class_id", "of", "target")
    tables(spark, str(tmp_path), rows, [(1, plain(30)), (None, None), (2, "")], extra)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = sorted([t for _, t, *_ in rows[:31]] + [a, b, c, rows[36][1]])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, now, str(tmp_path)), name)
        assert out.columns == now.columns and out.schema["n_chars"].dataType == now.schema["n_chars"].dataType
        now = out
    got = now.collect()
    assert sorted(r.text for r in got) == want and all(r.node == "x" and r.dropped_lines_ == "x" for r in got)
    assert sorted((r.doc_id for r in got if r.text in (a, b)), key=str) == [301, 302]
    out = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    mixed, plain = out.collect(), {(r.doc_id, r.text) for r in got}
    assert out.columns == [c for c in now.columns if c != "target"] + ["size", "source_size", "target", "copies", "taken"]
    assert all(r.copies > 0 and r.taken == r.copies * r["size"] and (r.doc_id, r.text) in plain and r.node == "x" and isinstance(r.target, float) for r in mixed) and {r.source for r in mixed} <= {"s0", "s1", None}


def test_the_mix_of_repeated_rows(spark):
    """Rows are drawn one by one; those with the same id, text and source come as one row with all their copies, those of another source apart."""
    rng = random.Random(3)
    texts = [prose(rng, "en", 30).replace("\n", " ") for _ in range(40)]
    rows = [(k, t, "en", "s0", 1) for k, t in enumerate(texts)] + [(7, texts[7], "en", "s0", 2)] * 2 + [(7, texts[7], "en", "s1", 1), (None, texts[3], None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plain = mixing.mix_documents(common.cut(mixing.sizes(docs.select("doc_id", "source", "text", common.row_key().alias("mix_row_")), ["doc_id", "source", "mix_row_"]), "sizes"))
    want = {}
    for r in plain.where("copies > 0").collect():
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.copies
    got = corpus_pipeline.mix(spark, docs, "").collect()
    assert {(r.doc_id, r.source): r.copies for r in got} == want and len(got) == len(want) and all(r.taken == r.copies * r["size"] for r in got) and all(r.text == texts[r.doc_id] for r in got if r.doc_id is not None)


def test_stages_are_the_agreed_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "neardup", "decontaminate", "mix"] and corpus_pipeline.ORACLE_SQL is None
    assert F is not None
