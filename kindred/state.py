"""State of a run: a JSON manifest that is replaced atomically.

Analyses are kept by the key of their cluster (a hash of its members), not by
its number, so that a later run that numbers clusters anew finds its own.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import asdict, dataclass, field
from pathlib import Path

from kindred.config import RunConfig

STAGES = ("indexing", "embedding", "clustering", "reranking", "analyzing", "complete")
FOLDER, FILE = ".kindred_cache", "state.json"
COMPARED = ("threshold", "min_cluster", "focus", "exclude")


@dataclass
class RunState:
    project_path: str
    config: dict
    started_at: float = field(default_factory=time.time)
    stage: str = STAGES[0]
    total_chunks: int = 0
    clusters: list[dict] = field(default_factory=list)
    analyses: dict[str, dict] = field(default_factory=dict)
    embeddings_completed: int = 0
    analyses_completed: int = 0
    last_error: str | None = None
    failed_clusters: list[str] = field(default_factory=list)

    def summary(self) -> str:
        out = [f"Stage: {self.stage}", f"Chunks: {self.total_chunks}", f"Embedded: {self.embeddings_completed}", f"Clusters: {len(self.clusters)}", f"Analyses: {len(self.analyses)}"]
        if self.failed_clusters:
            out.append(f"Failed: {len(self.failed_clusters)}")
        if self.last_error:
            out.append(f"Last error: {self.last_error[:50]}")
        return "\n".join(out)


def path_of(root: str | Path) -> Path:
    return Path(root) / FOLDER / FILE


def load_state(root: str | Path) -> RunState | None:
    """The saved state; None if there is none or it has another shape."""
    try:
        return RunState(**json.loads(path_of(root).read_text(encoding="utf-8")))
    except (OSError, ValueError, TypeError):
        return None


def save_state(root: str | Path, state: RunState) -> None:
    path = path_of(root)
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_suffix(".new")
    new.write_text(json.dumps(asdict(state), indent=2, default=list), encoding="utf-8")
    os.replace(new, path)


def clear_state(root: str | Path) -> bool:
    try:
        path_of(root).unlink()
    except FileNotFoundError:
        return False
    return True


def snapshot(config: RunConfig) -> dict:
    return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(config).items() if k != "given"}


def can_resume(root: str | Path, config: RunConfig) -> tuple[bool, str | None, RunState | None]:
    """Whether a saved run may go on, why not, and the saved run."""
    state = load_state(root)
    if state is None:
        return False, "there is no saved run", None
    if state.project_path != str(root):
        return False, "the project folder changed", state
    now = snapshot(config)
    for k in COMPARED:
        if state.config.get(k) != now[k]:
            return False, f"{k} changed", state
    if state.stage == "complete":
        return False, "the saved run is complete", state
    return True, None, state
