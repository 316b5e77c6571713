"""The outer loop's control: phases, state, paths and report. Plain driver code over small documents."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tracemill.operators.gates import GateError, require
from tracemill.sources import statefile
from tracemill.sources.jsonl import entries

#: The phases of a cycle, in order.
PHASES = ("phase1_grpo", "phase1_eval", "phase2_collect", "phase3_regen", "phase3_filter", "phase3_dpo", "phase4_eval")
CYCLES = 2
#: Fixed value: the file that marks a folder as a dry run's.
PLACEHOLDER = "DRY_RUN_PLACEHOLDER"


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


_PLACE = {name: place for place, name in enumerate(PHASES)}


def work(state: dict, cycles: int) -> range:
    """The numbers of all work that is left: cycle times the number of phases, plus the phase's place (an unknown phase: the first)."""
    return range(state["current_cycle"] * len(PHASES) + _PLACE.get(state.get("current_phase"), 0), cycles * len(PHASES))


def named(number: int) -> tuple[int, str]:
    """The cycle and the phase of a number of work."""
    cycle, place = divmod(number, len(PHASES))
    return cycle, PHASES[place]


def moved(state: dict, number: int) -> dict:
    """The state that points to this work; where a cycle begins, the one before it is history."""
    cycle, phase = named(number)
    new = {**state, "current_cycle": cycle, "current_phase": phase}
    if cycle and phase == PHASES[0]:
        new["history"] = [*state.get("history", ()), {"cycle": cycle - 1, "completed": _now(), "results": f"./results/cycle_{cycle - 1}_eval.json"}]
    return new


def load_state(path: str, *, resume: bool, cycle: int | None = None, spark: SparkSession | None = None) -> dict:
    """The saved state if resuming and there is one, else a fresh one; a given cycle is set in either."""
    return _load(path, resume, cycle, spark)[0]


def _load(path: str, resume: bool, cycle: int | None, spark: SparkSession | None) -> tuple[dict, int]:
    saved, version = statefile.read(path, spark)
    if resume and saved is not None:
        return (saved if cycle is None else saved | {"current_cycle": cycle}), version
    return {"status": "running", "current_cycle": cycle or 0, "current_phase": PHASES[0], "history": []}, version


def save_state(path: str, state: dict, version: int | None = None, spark: SparkSession | None = None) -> int:
    """Saves the state as made of a version of it (by default the one that is there now), and gives the new version."""
    return statefile.write(state | {"last_update": _now()}, path, statefile.read(path, spark)[1] if version is None else version, spark)


def model_path(root: str, cycle: int, stage: str, base: str) -> str:
    """A cycle starts from the base model or the final one of the cycle before."""
    if stage == "start":
        return base if cycle == 0 else model_path(root, cycle - 1, "final", base)
    return str(Path(root) / "checkpoints" / f"cycle_{cycle}" / f"model_{stage}")


def run(root: str, steps: dict, *, resume: bool = False, cycles: int = CYCLES, state_file: str | None = None, cycle: int | None = None, only: str | None = None, gate: Callable[[], DataFrame] | None = None, spark: SparkSession | None = None) -> dict:
    """Runs the work that is left, or one phase only: steps[phase](cycle). The state is saved before and after each.

    It refuses to start where the gate gives violations, to resume a run that is completed, to run beyond the cycles and
    to run a phase that it doesn't know. A second run over the same state ends in a conflict at one's next save.
    """
    path = state_file or str(Path(root) / "pipeline_state.json")
    if only is not None and only not in PHASES:
        raise GateError(f"unknown phase {only!r}: it is one of {', '.join(PHASES)}")
    if gate is not None:
        require(gate())
    state, version = _load(path, resume, cycle, spark)
    if resume and state.get("status") == "completed":
        raise GateError(f"the run of {path} is completed; remove its state to start anew")
    if state["current_cycle"] >= cycles:
        raise GateError(f"cycle {state['current_cycle']} of {cycles}: nothing is left to run")
    first = state["current_cycle"] * len(PHASES)
    for number in work(state, cycles) if only is None else [first + _PLACE[only]]:
        cycle, phase = named(number)
        state = {**state, "current_cycle": cycle, "current_phase": phase, "status": "running"}
        version = save_state(path, state, version, spark)
        steps[phase](cycle)
        state = moved(state, number + 1)
        version = save_state(path, state, version, spark)
    if only is None:
        state = {**state, "status": "completed"}
        save_state(path, state, version, spark)
    return state


def child(command: list[str], inputs: list[str], outputs: list[str], log: str) -> None:
    """A phase as a child process: its inputs must be there before, its outputs after; what it prints goes to log."""
    if gone := [p for p in inputs if not Path(p).exists()]:
        raise FileNotFoundError(f"inputs missing: {', '.join(gone)}")
    Path(log).parent.mkdir(parents=True, exist_ok=True)
    with open(log, "ab") as out:
        done = subprocess.run(command, stdout=out, stderr=subprocess.STDOUT, check=False)
    if done.returncode:
        raise RuntimeError(f"{command[0]} ended with {done.returncode}; see {log}")
    if gone := [p for p in outputs if not Path(p).exists()]:
        raise FileNotFoundError(f"outputs missing: {', '.join(gone)}")


#: What a watchdog does by what it sees: (parent alive, all done, model saved, trainer alive, checkpoint there) to an action; None: either.
WATCH = (
    ((True, None, None, None, None), "wait"),
    ((False, True, None, None, None), "idle"),
    ((False, False, True, None, None), "resume"),
    ((False, False, False, True, None), "wait"),
    ((False, False, False, False, True), "resume"),
    ((False, False, False, False, False), "report"),
)


def watch(**seen: bool) -> str:
    """The action for parent, done, model, trainer and checkpoint: a crash without a checkpoint is reported, never restarted from the start."""
    now = tuple(bool(seen[k]) for k in ("parent", "done", "model", "trainer", "checkpoint"))
    return next(action for rule, action in WATCH if all(r is None or r == x for r, x in zip(rule, now)))


def dry_run_marker(folder: str) -> Path:
    """Marks a folder as written by a dry run, which later steps refuse."""
    path = Path(folder) / PLACEHOLDER
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("dry run\n", encoding="utf-8")
    return path


def require_model(folder: str, what: str = "model", spark: SparkSession | None = None) -> str:
    """The folder of a trained model; an error if it isn't there, if a dry run wrote it, or if it holds neither an adapter nor weights.

    With a session it may be in any store that Spark reads.
    """
    names = set(entries(spark, folder)) if spark is not None else {p.name for p in Path(folder).glob("*")}
    if not names:
        raise GateError(f"{what} not found: {folder}")
    if PLACEHOLDER in names:
        raise GateError(f"{what} at {folder} was written by a dry run")
    weights = [n for n in names if n.startswith(("adapter_model", "model")) and n.endswith((".safetensors", ".bin"))]
    if not weights or ("adapter_config.json" not in names and "config.json" not in names):
        raise GateError(f"{what} at {folder} holds no adapter or model: {', '.join(sorted(names)[:5])}")
    return folder


def adapters(folder: str) -> dict:
    """What a model folder holds: adapter files, checkpoints, a dry-run marker."""
    at = Path(folder)
    return {
        "adapter_config": (at / "adapter_config.json").exists(), "adapter_weights": sorted(p.name for p in at.glob("adapter_model*")),
        "checkpoints": sorted(p.name for p in at.glob("checkpoint-*") if p.is_dir()), "placeholder": (at / PLACEHOLDER).exists(),
    }


def number(value, form: str = "%.4f") -> str:
    return "n/a" if value is None else form % value if isinstance(value, float) else str(value)


def yes_no(value) -> str:
    return {True: "yes", False: "no"}.get(value, "n/a")


def markdown(report: dict) -> str:
    """A report document (cycle, models, hypothesis_results, verdict) as Markdown."""
    models = report.get("models", {})
    names = sorted({n for m in models.values() for n in m})
    out = [f"# Evaluation of cycle {report.get('cycle', 0)}", "", "| metric | " + " | ".join(models) + " |", "|---|" + "---|" * len(models)]
    out += [f"| {n} | " + " | ".join(number(m.get(n)) for m in models.values()) + " |" for n in names]
    out += ["", "| hypothesis | verified | delta |", "|---|---|---|"]
    out += [f"| {h['id']} | {yes_no(h['verified'])} | {h.get('delta') or 'n/a'} |" for h in report.get("hypothesis_results", [])]
    if report.get("verdict"):
        out += ["", f"Verdict: {report['verdict']}"]
    return "\n".join(out) + "\n"


def _grid(names: list[str], rows: list) -> list[str]:
    cell = lambda r, n: number(r.get(n) if isinstance(r, dict) else r[n])
    return ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(cell(r, n) for n in names) + " |" for r in rows)]


def _facts(found: dict) -> list[str]:
    return [f"- {k}: {v if isinstance(v, (list, bool)) else number(v)}" for k, v in found.items()]


def training_report(progress: list, events: list, audit: dict, model: dict, total: int = 300) -> str:
    """A training log as Markdown, from collected rows: progress marks, metric events, one audit summary and what the model folder holds."""
    marks, metrics = ["step", "elapsed", "eta", "sec_per_it"], ["epoch", "reward", "reward_std", "completion_length", "kl", "grad_norm", "learning_rate", "loss"]
    last = progress[-1] if progress else {}
    parts = {
        "Where it stands": [f"- step: {last['step'] if last else 'n/a'} of {total}", *_facts(model)],
        "Last metrics": _facts({k: events[-1][k] for k in metrics}) if events else ["- none yet"],
        "Rewards of all ranks": _facts(audit),
        "Steps": _grid(marks, progress),
        "Metrics": _grid(metrics, events) if events else ["none yet"],
    }
    return "# Training log\n\n" + "\n\n".join(f"## {title}\n\n" + "\n".join(lines) for title, lines in parts.items()) + "\n"


def report_document(row) -> dict:
    """A one-row report as a document, for write_document and markdown."""
    return json.loads(json.dumps(row.asDict(recursive=True), default=str))
