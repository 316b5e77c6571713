"""State files: versions, conflicts, crashes, both stores; and what a run of phases refuses."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from tracemill.operators.gates import GateError
from tracemill.plans import phases
from tracemill.sources import jsonl, statefile


@pytest.fixture(params=["local", "hadoop"])
def store(request, spark, tmp_path):
    return (spark, f"file://{tmp_path}/state.json") if request.param == "hadoop" else (None, str(tmp_path / "state.json"))


def test_versions_and_conflicts(store, tmp_path):
    spark, path = store
    assert statefile.read(path, spark) == (None, 0)
    for k in range(7):
        doc, version = statefile.read(path, spark)
        assert statefile.write({"k": k, "é": [None, "\n"]}, path, version, spark) == version + 1 == k + 1
    assert statefile.read(path, spark) == ({"k": 6, "é": [None, "\n"]}, 7) and jsonl.read_document(path, spark)["k"] == 6
    assert sorted(n for n in os.listdir(tmp_path / "state.json.versions") if n[0] not in "._") == ["5.json", "6.json", "7.json"]
    assert '"k": 6' in (tmp_path / "state.json").read_text()
    with pytest.raises(statefile.StateConflict):
        statefile.write({"k": "late"}, path, 6, spark)
    assert statefile.read(path, spark)[0]["k"] == 6


def test_one_of_many_writers_wins(store):
    spark, path = store
    statefile.write({"k": 0}, path, 0, spark)

    def attempt(k):
        try:
            return statefile.write({"k": k}, path, 1, spark)
        except statefile.StateConflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(attempt, range(1, 9))) if spark is None else [attempt(k) for k in range(1, 9)]
    assert [d for d in done if d] == [2] and statefile.read(path, spark) == ({"k": 1 + done.index(2)}, 2)


def test_a_crash_between_bytes_leaves_the_old_state(store, monkeypatch, tmp_path):
    spark, path = store
    statefile.write({"k": "old"}, path, 0, spark)
    kind = statefile._Local if spark is None else statefile._Hadoop
    write = kind.write

    def broken(self, where, text):
        write(self, where, text[: len(text) // 2])
        raise KeyboardInterrupt

    monkeypatch.setattr(kind, "write", broken)
    for call in (lambda: statefile.write({"k": "new"}, path, 1, spark), lambda: statefile.replace('{"k": "new"}', path, spark)):
        with pytest.raises(KeyboardInterrupt):
            call()
    monkeypatch.undo()
    assert statefile.read(path, spark) == ({"k": "old"}, 1) and '"old"' in (tmp_path / "state.json").read_text()
    assert statefile.write({"k": "new"}, path, 1, spark) == 2


def test_a_document_of_another_hand_is_read(store, tmp_path):
    spark, path = store
    (tmp_path / "state.json").write_text('{"current_phase": "phase3_dpo"}')
    assert statefile.read(path, spark) == ({"current_phase": "phase3_dpo"}, 0) and statefile.write({"a": 1}, path, 0, spark) == 1
    assert statefile.read(path, spark) == ({"a": 1}, 1)
    jsonl.write_document({"x": "ü"}, str(tmp_path / "new/folder/r.json"))
    assert jsonl.read_document(str(tmp_path / "new/folder/r.json")) == {"x": "ü"}


def test_a_second_run_conflicts(store, tmp_path):
    spark, path = store
    steps = {p: lambda cycle: None for p in phases.PHASES}

    def other(cycle):
        phases.run(str(tmp_path), {p: lambda c: None for p in phases.PHASES}, resume=True, cycles=1, state_file=path, spark=spark)

    with pytest.raises(statefile.StateConflict):
        phases.run(str(tmp_path), steps | {"phase2_collect": other}, cycles=1, state_file=path, spark=spark)
    assert phases.load_state(path, resume=True, spark=spark)["status"] == "completed"


def test_what_a_run_refuses(spark, tmp_path):
    ran, root = [], str(tmp_path)
    steps = {p: lambda cycle, p=p: ran.append((cycle, p)) for p in phases.PHASES}
    bad = spark.createDataFrame([("mbpp_train", "empty", 0)], "dataset string, gate string, n bigint")
    with pytest.raises(GateError, match="mbpp_train: empty"):
        phases.run(root, steps, gate=lambda: bad)
    with pytest.raises(GateError, match="unknown phase"):
        phases.run(root, steps, only="phase4_dpo")
    assert not ran and phases.run(root, steps, only="phase3_dpo", cycle=1, gate=lambda: bad.limit(0))["current_phase"] == "phase4_eval" and ran == [(1, "phase3_dpo")]
    state = phases.run(root, steps, resume=True)
    assert ran[1:] == [(1, "phase4_eval")] and state["status"] == "completed" and state["current_cycle"] == 2
    with pytest.raises(GateError, match="completed"):
        phases.run(root, steps, resume=True)
    with pytest.raises(GateError, match="nothing is left"):
        phases.run(root, steps, cycle=2)


@pytest.mark.parametrize("remote", [False, True])
def test_models_that_must_not_be_loaded(spark, tmp_path, remote):
    at = lambda name: f"file://{tmp_path}/{name}" if remote else str(tmp_path / name)
    session = spark if remote else None
    phases.dry_run_marker(str(tmp_path / "dry"))
    for name, files in (("dry", ["adapter_config.json", "adapter_model.safetensors"]), ("half", ["adapter_config.json"]), ("bare", ["adapter_model.bin"]), ("real", ["adapter_config.json", "adapter_model.safetensors"]), ("merged", ["config.json", "model-00001-of-00002.safetensors"])):
        (tmp_path / name).mkdir(exist_ok=True)
        for f in files:
            (tmp_path / name / f).write_text("x")
    for name, why in (("none", "not found"), ("dry", "dry run"), ("half", "no adapter"), ("bare", "no adapter")):
        with pytest.raises(GateError, match=why):
            phases.require_model(at(name), spark=session)
    assert [phases.require_model(at(n), spark=session) for n in ("real", "merged")] == [at("real"), at("merged")]
