"""The queries over whole texts and all rows, against brute force on literal tables."""

import math

import pytest

from tracemill.plans import registry

TEXTS = [
    " ".join(["abc"] * 120 + ["thinker"] + ["ab", "fencings"] * 3 + ["abcde"] * 40),
    " ".join(["a"] * 19 + ["b"] + ["thinker"] + ["fencings", "abcd"] * 90 + ["thinker", "x" * 18]),
    " ".join(["x" * 20] * 30),
    "fencings thinker fencings  fencings tail",
    "",
]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return lambda name: {r.doc_id: tuple(r)[1:] for r in registry.queries()[name](spark, folder).collect()}


def ids(text):
    return [len(w) % 10 for w in text.split(" ")]


def closed(row):
    after, count = False, 0
    for i, t in enumerate(row):
        if t == 7:
            after, count = True, 0
        elif after and t == 8:
            count += 1
            if count == 2:
                return i + 1
    return len(row)


def test_fences_budgets_and_losses_read_whole_texts(whole):
    rows = {i: ids(t) for i, t in enumerate(TEXTS)}
    assert whole("fence_mask") == {i: (len(r), closed(r)) for i, r in rows.items()}
    last = lambda r: r[len(r) - r[::-1].index(7) :] if 7 in r else []
    assert whole("fence_stop") == {i: (last(r).count(8) >= 2,) for i, r in rows.items()}
    assert whole("loss_mask") == {i: (len(r) == 30 and 7 not in r, len(r) - (len(r) > 20 and r[20] == 7)) for i, r in rows.items()}
    got = whole("grpo_objective")
    for i, r in rows.items():
        ratio = [(t % 4) / 4 - t / 8 for t in r if t % 3]
        assert got[i][0] == pytest.approx(sum(-(0.5 - 0.04 * (math.exp(x) - x - 1)) for x in ratio) / max(1, len(ratio)), abs=2e-6)


def test_lenient_scores_of_all_forms(spark, tmp_path):
    n = 27
    spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    want = {}
    for i in range(n):
        s = [float(f"{4 + i * k % 7}.{i % 2 * 5}") for k in range(1, 6)]
        form = i % 9
        # fields that the form lacks: all, overall (then the mean), or clarity
        want[i] = [0.0] * 5 if form == 8 else [*s[:4], sum(s[:4]) / 4] if form in (4, 7) else [*s[:4], 0.0] if form == 5 else [0.0, *s[1:]] if form == 6 else s
    assert {r.doc_id: list(r)[1:] for r in run("judge_scores_lenient")} == {i: pytest.approx(x) for i, x in want.items()}
    assert list(run("readability_means")[0]) == pytest.approx([n, *(sum(x[k] for x in want.values()) / n for k in range(5))])


def test_stdout_keeps_rows_with_other_line_ends(spark, tmp_path):
    texts = {i: t for i, t in enumerate(["a \r\nb\t\r\n\r\n", "a\x0bb \x0c c", "x\x1cy\x1dz\x1e", "p\x85q \u2028r\u2029", "plain \n\n", "\r", None])}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.out for r in registry.queries()["stdout_normal"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else "\n".join(x.rstrip() for x in t.splitlines()).rstrip("\n") for i, t in texts.items()}
