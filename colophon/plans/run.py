"""The steps of a run, in order, each reading what earlier ones have written."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ColophonError, ConfigError, MissingInput

#: Fixed: step, its label, and the steps it needs.
STEPS = {
    "1": ("extract", ()),
    "1.5": ("cleanup", ("1",)),
    "2": ("vocabulary lookup", ("1",)),
    "3": ("vocabulary selection", ("2",)),
    "4": ("entity authority", ("1",)),
}
#: Fixed: exit codes.
OK, BAD_CONFIG, NO_INPUT, FAILED = 0, 2, 3, 4


@dataclass
class Report:
    status: dict[str, str] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def text(self) -> str:
        lines = [f"{s} {STEPS[s][0]}: {self.status[s]} in {self.seconds.get(s, 0):.1f} s" + (f" ({self.errors[s]})" if s in self.errors else "") for s in self.status]
        return "\n".join(lines)


def choose(text: str) -> list[str]:
    """Steps of a comma list, in the order in which they run."""
    asked = [x.strip() for x in text.split(",") if x.strip()]
    if unknown := [x for x in asked if x not in STEPS]:
        raise ConfigError(f"no such step: {', '.join(unknown)}")
    return [s for s in STEPS if s in asked]


def between(first: str | None = None, last: str | None = None) -> list[str]:
    names = list(STEPS)
    a, b = names.index(first) if first else 0, names.index(last) if last else len(names) - 1
    return names[a : b + 1]


def check(steps: list[str], resume: bool = False) -> None:
    """A fresh run needs each step's dependencies among the chosen steps; a resumed one finds them written."""
    for s in steps:
        missing = set(STEPS[s][1]) - set(steps)
        if missing and not resume:
            raise ConfigError(f"step {s} needs step {', '.join(sorted(missing))}")


def run(steps: list[str], work: dict[str, Callable[[], None]], keep_going: bool = False, resume: bool = False) -> Report:
    """Run the chosen steps.  A failed one stops the run, or, with ``keep_going``, just what depends on it."""
    check(steps, resume)
    report, broken = Report(), set()
    for s in [s for s in STEPS if s in steps]:
        if broken and not keep_going or broken & set(STEPS[s][1]):
            report.status[s] = "not run"
            broken |= {s} if broken & set(STEPS[s][1]) else set()
            continue
        began = time.monotonic()
        try:
            work[s]()
            report.status[s] = "ok"
        except ColophonError as e:
            report.status[s], report.errors[s] = "failed", str(e)
            broken.add(s)
        report.seconds[s] = time.monotonic() - began
    return report


def exit_code(outcome: Report | Exception) -> int:
    if isinstance(outcome, ConfigError):
        return BAD_CONFIG
    if isinstance(outcome, MissingInput):
        return NO_INPUT
    return FAILED if isinstance(outcome, Exception) or "failed" in outcome.status.values() else OK


def wants_batch(n: int, at_least: int, asked: bool | None = None, supported: bool = True) -> bool:
    """Send as one batch?  As asked for, or else from ``at_least`` items on (6 in step 1, 5 in step 3)."""
    return supported and (n >= at_least if asked is None else asked)


def masked(parameters: dict[str, object]) -> list[str]:
    """Lines that name a run's inputs; secrets are starred, what is unset is called default."""
    secret = lambda k: any(x in k.lower() for x in ("key", "token", "secret", "password"))
    return [f"{k}: {'(default)' if v is None else '****' if secret(k) else v}" for k, v in parameters.items()]


def _scripted():
    from ..sources.completions import ScriptedProvider

    def answer(prompt: str) -> str:
        body = prompt.split("\n\n", 1)[1]
        first = body.split("\n", 1)[0][:80].replace('"', "'").replace("\\", "/")
        if len(body) % 7 == 0:
            return ""
        if len(body) % 11 == 0:
            return "Error: the model is busy"
        return '```json\n{"title": "%s", "abstract": "%s", "subjects": "%s", "contentWarning": "none",}\n```' % (first, first, first)

    return ScriptedProvider(answer)


def scripted_extraction(docs: DataFrame) -> DataFrame:
    """doc_id, title, n_subjects, error, failure_reason of each document, by a provider that needs no network."""
    from ..functions import json_repair, quality
    from ..operators.extraction import extract

    done = extract(docs.select("doc_id", "text"), _scripted, "scripted")
    keys = F.map_keys(json_repair.repaired(F.col("raw")))
    whole = quality.complete_record(quality.REQUIRED, F.col("record.title"), F.col("record.abstract")) & (F.size(F.coalesce(keys, F.array().cast("array<string>"))) >= 4)
    reason = quality.failure_reason(F.lit(True), F.col("raw"), whole)
    return done.select("doc_id", F.col("record.title").alias("title"), F.size("record.subjects").alias("n_subjects"), "error", reason.alias("failure_reason"))
