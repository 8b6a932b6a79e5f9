"""Shell globs as predicates on paths: ``*`` crosses ``/``, a pattern matches the whole text, case counts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Globs that are always excluded.
DEFAULT_EXCLUDES = [
    "*.git/*", "*node_modules/*", "*__pycache__/*", "*.pyc", "*venv/*", "*env/*", "*.egg-info/*", "*build/*", "*dist/*",
    "*.tox/*", "*target/*", "*.build/*", "*DerivedData/*", "*Pods/*", "*.cache/*",
]


def glob_to_regex(glob: str) -> str:
    """A regular expression that both Java and Python read alike."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            if out[-1:] != [".*"]:
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            negated = glob[i : i + 1] == "!"
            low = i + negated
            end = glob.find("]", low + 1) if glob[low : low + 1] == "]" else glob.find("]", low)
            if end < 0:
                out.append("\\[")
                continue
            body = re.sub(r"([\\\[\]&^~|])", r"\\\1", glob[low:end])
            out.append(f"[{'^' * negated}{body}]")
            i = end + 1
        else:
            out.append(re.sub(r"([^\w\s/])", r"\\\1", c) if c.isascii() else c)
    return "(?s)^(?:" + "".join(out) + r")\z"


def matches(path: Column, globs: list[str]) -> Column:
    """Whether any glob matches the whole of ``path``."""
    return reduce(lambda a, b: a | b, [path.rlike(glob_to_regex(g)) for g in globs], F.lit(False))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def selected(relative: Column, absolute: Column | None = None, exclude: list[str] | None = None, focus: list[str] | None = None, defaults: bool = True) -> Column:
    """Not excluded (by relative path, or by ``absolute`` if given), and in focus (by relative path or name) if there is a focus."""
    globs = (DEFAULT_EXCLUDES if defaults else []) + list(exclude or [])
    out = ~matches(relative, globs)
    if absolute is not None:
        out = out & ~matches(absolute, globs)
    if focus:
        out = out & (matches(relative, focus) | matches(base_name(relative), focus))
    return out
