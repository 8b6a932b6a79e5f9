"""Run settings: defaults, then a TOML file, then the command line; what is given later wins.

A setting that was given on the command line wins even if it equals the
default.  The file is looked for in the analysed folder and then in its parents.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

#: File names in each folder, first wins, and the table that holds the settings.
NAMES, SECTION = (".kindredrc", ".kindred.toml"), "kindred"
FORMATS = {".md": "markdown", ".html": "html", ".json": "json", ".txt": "text"}


@dataclass(frozen=True)
class RunConfig:
    threshold: float = 0.80
    min_cluster: int = 2
    output: str | None = None
    sort_by: str = "severity"
    exclude: tuple[str, ...] = ()
    focus: tuple[str, ...] = ()
    lang: str | None = None
    verbose: bool = False
    max_chunks: int = 10_000
    batch_size: int = 32
    min_lines: int = 5
    max_lines: int = 100
    analyze: bool = False
    llm_model: str | None = None
    max_analyze: int | None = None
    parallel: int = 0
    rerank: bool = True
    rerank_model: str | None = None
    rerank_threshold: float = 0.5
    resume: bool = True
    quiet: bool = False
    given: frozenset = field(default=frozenset(), compare=False, repr=False)

    def __post_init__(self):
        if not 0 <= self.threshold <= 1 or not 0 <= self.rerank_threshold <= 1:
            raise ValueError("thresholds lie between 0 and 1")
        if self.output and self.output not in FORMATS.values() and Path(self.output).suffix not in FORMATS:
            raise ValueError(f"output must end in one of {', '.join(FORMATS)}")


def find_config_file(start: str | Path, names: tuple[str, ...] = NAMES) -> Path | None:
    folder = Path(start).resolve()
    for place in (folder, *folder.parents):
        for name in names:
            if (place / name).is_file():
                return place / name
    return None


def load_config(start: str | Path, names: tuple[str, ...] = NAMES, section: str = SECTION) -> dict[str, Any]:
    """Settings of the nearest file; none if there is no file or it can't be read."""
    path = find_config_file(start, names)
    if path is None:
        return {}
    try:
        found = tomllib.loads(path.read_text(encoding="utf-8")).get(section, {})
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError):
        return {}
    return found if isinstance(found, dict) else {}


def merge(file: dict[str, Any], cli: dict[str, Any]) -> RunConfig:
    """Settings from a file and from the command line, where None is "not given".

    Unknown settings of the file are ignored, as are lists that aren't lists.
    """
    known = {f.name for f in fields(RunConfig)} - {"given"}
    out: dict[str, Any] = {}
    for k, v in file.items():
        if k in ("exclude", "focus"):
            if isinstance(v, list):
                out[k] = tuple(v)
        elif k in known:
            out[k] = v
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in cli.items() if v is not None and v != [] and k in known}
    return replace(RunConfig(), **(out | given), given=frozenset(given))
