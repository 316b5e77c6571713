import sys

import pytest

from tracemill.plans import phases


def test_work_goes_on_over_phases_and_cycles():
    at = lambda cycle, phase: [phases.named(n) for n in phases.work({"current_cycle": cycle, "current_phase": phase}, 2)]
    every = [(c, p) for c in range(2) for p in phases.PHASES]
    assert at(0, "nothing") == every and at(0, phases.PHASES[0]) == every and at(0, phases.PHASES[-1]) == every[6:] and at(1, "phase3_dpo") == every[-2:] and at(2, "x") == []


def test_a_saved_state_resumes_at_each_phase_by_name(tmp_path):
    for place, name in enumerate(("phase1_grpo", "phase1_eval", "phase2_collect", "phase3_regen", "phase3_filter", "phase3_dpo", "phase4_eval")):
        path, ran = str(tmp_path / name), []
        phases.save_state(path, {"status": "running", "current_cycle": 1, "current_phase": name, "history": []})
        phases.run(str(tmp_path), {p: lambda cycle, p=p: ran.append((cycle, p)) for p in phases.PHASES}, resume=True, cycles=2, state_file=path)
        assert ran == [(1, p) for p in phases.PHASES[place:]] and ran[0] == (1, name)


def test_last_phase_ends_the_cycle():
    state = phases.moved({"history": []}, len(phases.PHASES))
    assert state["current_cycle"] == 1 and [h["cycle"] for h in state["history"]] == [0] and state["current_phase"] == phases.PHASES[0]
    assert phases.moved({}, 3) == {"current_cycle": 0, "current_phase": phases.PHASES[3]}


def test_watchdog():
    base = {"parent": False, "done": False, "model": False, "trainer": False, "checkpoint": False}
    assert phases.watch(**base) == "report" and phases.watch(**base | {"checkpoint": True}) == "resume" and phases.watch(**base | {"trainer": True, "checkpoint": True}) == "wait"
    assert phases.watch(**base | {"model": True}) == "resume" and phases.watch(**base | {"model": True, "done": True}) == "idle" and phases.watch(**base | {"parent": True}) == "wait"


def test_child_phases(tmp_path):
    made, log = str(tmp_path / "made"), str(tmp_path / "logs/a.log")
    phases.child([sys.executable, "-c", f"open({made!r}, 'w').write('x'); print('said')"], [], [made], log)
    assert (tmp_path / "logs/a.log").read_text() == "said\n"
    for command, inputs, outputs, error in ((["true"], [str(tmp_path / "no")], [], FileNotFoundError), (["true"], [], [str(tmp_path / "no")], FileNotFoundError), (["false"], [], [], RuntimeError)):
        with pytest.raises(error):
            phases.child(command, inputs, outputs, log)


def test_a_failed_run_resumes_at_its_phase(tmp_path):
    seen, broken = [], [True]

    def step(name):
        def run(cycle):
            if name == "phase3_regen" and broken.pop() if broken else False:
                raise RuntimeError("stop")
            seen.append((cycle, name))

        return run

    steps = {p: step(p) for p in phases.PHASES}
    try:
        phases.run(str(tmp_path), steps, cycles=1)
    except RuntimeError:
        pass
    state = phases.run(str(tmp_path), steps, cycles=1, resume=True)
    assert [p for _, p in seen] == list(phases.PHASES) and state["status"] == "completed" and len(state["history"]) == 1


def test_lineage_and_report(tmp_path):
    assert phases.model_path("/r", 1, "start", "base") == "/r/checkpoints/cycle_0/model_final" and phases.model_path("/r", 0, "start", "base") == "base"
    assert phases.adapters(str(phases.dry_run_marker(str(tmp_path / "m")).parent))["placeholder"]
    text = phases.markdown({"cycle": 2, "models": {"base": {"pass": 0.5}, "rl": {}}, "hypothesis_results": [{"id": "H1", "verified": True, "delta": "+8%"}], "verdict": "kept neither"})
    assert "| pass | 0.5000 | n/a |" in text and "| H1 | yes | +8% |" in text


def test_training_report():
    marks = [{"step": 10, "elapsed": "1:00", "eta": "2:00", "sec_per_it": 6.0}, {"step": 20, "elapsed": "2:00", "eta": "1:00", "sec_per_it": 6.5}]
    event = dict.fromkeys(["epoch", "reward", "reward_std", "completion_length", "kl", "grad_norm", "learning_rate", "loss"], 0.5) | {"kl": None}
    text = phases.training_report(marks, [event], {"rows": 3, "reward_mean": 0.25}, {"placeholder": False, "checkpoints": ["checkpoint-10"]})
    assert "- step: 20 of 300" in text and "| 20 | 2:00 | 1:00 | 6.5000 |" in text and "- kl: n/a" in text and "- rows: 3" in text and "- checkpoints: ['checkpoint-10']" in text
    assert "none yet" in phases.training_report([], [], {}, {}) and "- step: n/a" in phases.training_report([], [], {}, {})
