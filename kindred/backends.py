"""Backends by purpose and name.

A backend is made in the process that uses it, by a factory that takes a path
or None.  Those built in need no files.  One that needs a file names it by
``needs``; the file is looked for at the path that the caller gives, in the
folder of fetched files, and in ``folders``, in that order.  ``source`` says
where ``fetch`` gets it from: a path, a URI of a file system that Arrow knows,
or an http address.  Nothing is fetched unasked.
"""

from __future__ import annotations

import os
import shutil
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from kindred.operators.analyze import TemplateGenerator
from kindred.operators.embed import HashingEmbedder
from kindred.operators.rerank import OverlapScorer
from kindred.shared import filesystem

PURPOSES = ("embedding", "reranker", "llm")
#: Where fetched files are kept, and further folders that are searched after it.
home = Path.home() / ".cache" / "kindred" / "models"
folders: list[str | Path] = []


@dataclass(frozen=True)
class Backend:
    purpose: str
    name: str
    factory: Callable[[str | None], Any]
    needs: str | None = None
    source: str | None = None

    def find(self, path: str | None = None) -> str | None:
        """The file that the backend needs: ``path`` if it exists, else the first that a folder holds."""
        if path and os.path.exists(path):
            return path
        places = [Path(folder) / self.needs for folder in (home, *folders)] if self.needs else []
        return next((str(p) for p in places if p.exists()), None)

    @property
    def available(self) -> bool:
        return self.needs is None or self.find() is not None


_known: dict[tuple[str, str], Backend] = {}


def register(backend: Backend) -> None:
    if backend.purpose not in PURPOSES:
        raise ValueError(f"a backend is for one of {', '.join(PURPOSES)}")
    _known[backend.purpose, backend.name] = backend


register(Backend("embedding", "hashing", lambda _: HashingEmbedder()))
register(Backend("reranker", "overlap", lambda _: OverlapScorer()))
register(Backend("llm", "template", lambda _: TemplateGenerator()))
DEFAULT = {"embedding": "hashing", "reranker": "overlap", "llm": "template"}


def get(purpose: str, name: str | None = None) -> Any:
    """The backend of that name, or the one built in; ``name:path`` hands a path to its factory."""
    key, _, path = (name or DEFAULT[purpose]).partition(":")
    found = _known.get((purpose, key))
    if found is None:
        raise ValueError(f"no {purpose} backend named {key!r}; there are {', '.join(sorted(n for p, n in _known if p == purpose))}")
    if not found.available and not path:
        raise FileNotFoundError(f"{purpose} backend {key!r} needs {found.needs}")
    return found.factory(path or found.find())


def missing(purposes: tuple[str, ...] = PURPOSES) -> list[Backend]:
    return [b for b in _known.values() if b.purpose in purposes and not b.available]


def fetch(backend: Backend, again: bool = False) -> str | None:
    """The backend's file below ``home``, got from its source unless it is there; None if it needs none.

    A file that breaks off is never seen under its name.
    """
    if backend.needs is None:
        return None
    target = home / backend.needs
    if target.exists() and not again:
        return str(target)
    if backend.source is None:
        raise FileNotFoundError(f"{backend.purpose} backend {backend.name!r} needs {backend.needs}, and no source of it is known")
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f"{target.name}.{uuid.uuid4().hex}")
    try:
        if backend.source.startswith(("http://", "https://")):
            stream = urllib.request.urlopen(backend.source, timeout=60)
        else:
            files, place = filesystem(backend.source)
            stream = files.open_input_stream(place)
        with stream, part.open("wb") as f:
            shutil.copyfileobj(stream, f)
        os.replace(part, target)
    finally:
        part.unlink(missing_ok=True)
    return str(target)


def ensure(purposes: tuple[str, ...] = PURPOSES) -> dict[str, str | None]:
    """Fetches what backends of ``purposes`` miss: name -> file, or None where that failed."""
    got: dict[str, str | None] = {}
    for b in missing(purposes):
        try:
            got[b.name] = fetch(b)
        except OSError:
            got[b.name] = None
    return got


def status() -> str:
    return "\n".join(f"{b.purpose}: {b.name} ({'ready' if b.available else 'needs ' + str(b.needs)})" for b in sorted(_known.values(), key=lambda b: (PURPOSES.index(b.purpose), b.name)))
