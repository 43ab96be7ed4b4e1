"""Runs and their stages: which may start, resume, and complete."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace

STAGES = ("read", "import", "update", "remove")
NEEDS = {"read": (), "import": ("read",), "update": ("read", "import"), "remove": ("read", "import", "update")}
MOVES = {"pending": ("running", "cancelled"), "running": ("completed", "failed", "paused", "cancelled"), "paused": ("running", "cancelled"), "failed": ("running", "cancelled"), "completed": (), "cancelled": ()}


#: Schema of the table of runs.
RUNS = "id_run long, id_shop long, source string, fingerprint string, policy string, n_valid long, base string, " + ", ".join(f"{s} string" for s in STAGES) + ", errors string"


class RunError(RuntimeError):
    """A transition that the state doesn't allow."""


def policy_hash(language: int, feature_auto_create: bool, size_group: str) -> str:
    values = {"feature_auto_create": feature_auto_create, "language": language, "size_group": size_group}
    return hashlib.sha256(json.dumps(values, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def resolve_language(configured: int | None, of_shop: set[int], shop_default: int | None, global_default: int | None) -> int:
    """The configured language if the shop has it, else the shop's default, else the global one."""
    for choice in (configured if configured in of_shop else None, shop_default, global_default):
        if choice:
            return choice
    raise RunError("no language is configured")


def setting(value, default: int, least: int, most: int) -> int:
    """A whole number within bounds, else the default."""
    text = str(value).strip()
    if not text.lstrip("+-").isdigit():
        return default
    n = int(text)
    return n if least <= n <= most else default


@dataclass
class Run:
    id_run: int
    fingerprint: str = ""
    policy: str = ""
    stages: dict[str, str] = field(default_factory=lambda: dict.fromkeys(STAGES, "pending"))
    n_valid: int = 0
    base: str = ""  #: the parts that the mapping had of the scope when it was read
    errors: list[str] = field(default_factory=list)

    def start(self, stage: str, newest_read: int | None = None) -> None:
        missing = [s for s in NEEDS[stage] if self.stages[s] != "completed"]
        if missing:
            raise RunError(f"{stage} needs {', '.join(missing)}")
        later = STAGES[STAGES.index(stage) + 1 :]
        if any(self.stages[s] != "pending" for s in later):
            raise RunError(f"{stage} can't run again once a later stage has started")
        if newest_read is not None and newest_read > self.id_run:
            raise RunError(f"run {newest_read} has completed reading")
        if stage == "remove" and self.n_valid <= 0:
            raise RunError("remove needs valid rows")
        self.move(stage, "running")

    def move(self, stage: str, status: str) -> None:
        if status not in MOVES[self.stages[stage]]:
            raise RunError(f"{stage}: {self.stages[stage]} can't become {status}")
        self.stages[stage] = status

    def resume(self, fingerprint: str, policy: str) -> None:
        """A run goes on only with the input and the policy that it began with."""
        if self.fingerprint and fingerprint != self.fingerprint:
            raise RunError("the feed has changed since the run began")
        if self.policy and policy != self.policy:
            raise RunError("the policy has changed since the run began")
        self.fingerprint, self.policy = fingerprint, policy

    def fail(self, stage: str, error: str) -> None:
        self.errors.append(error[:8000])
        if self.stages[stage] == "running":
            self.stages[stage] = "failed"

    def cancel(self) -> None:
        """Stages that aren't complete never will be."""
        if self.stages["remove"] == "completed":
            raise RunError("the run is complete")
        self.check_alive()
        for stage, status in self.stages.items():
            if status != "completed":
                self.move(stage, "cancelled")
        self.errors.append("cancelled")

    def check_alive(self) -> None:
        if "cancelled" in self.stages.values():
            raise RunError(f"run {self.id_run} has been cancelled")

    def resumed(self, row: dict | None) -> Run:
        """The run as an earlier attempt left it: a row of the table of runs, or none."""
        if row is None:
            return self
        return replace(self, fingerprint=row["fingerprint"], policy=row["policy"], n_valid=row["n_valid"], base=row["base"], stages={s: "failed" if row[s] == "running" else row[s] for s in STAGES})

    def row(self, id_shop: int, source: str) -> tuple:
        """As RUNS has it."""
        return (self.id_run, id_shop, source, self.fingerprint, self.policy, self.n_valid, self.base, *(self.stages[s] for s in STAGES), "; ".join(self.errors)[:8000])

    @property
    def progress(self) -> int:
        return sum(s == "completed" for s in self.stages.values()) * 100 // len(STAGES)
