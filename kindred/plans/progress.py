"""Counts of items done while a stage runs.

A backend that is watched adds what it has done to an accumulator, which the
driver sees as tasks end.  A task that is run again counts again, so that counts
are held below the total until the stage has ended.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Counted:
    """A backend whose calls are counted."""

    def __init__(self, backend: Any, done: Any):
        self.backend, self.done = backend, done

    @property
    def model_id(self) -> str:
        return self.backend.model_id

    def embed(self, texts: list[str]):
        out = self.backend.embed(texts)
        self.done.add(len(texts))
        return out

    def score(self, query: str, document: str) -> float:
        out = self.backend.score(query, document)
        self.done.add(1)
        return out

    def generate(self, prompt: str) -> str:
        out = self.backend.generate(prompt)
        self.done.add(1)
        return out


@contextmanager
def watched(spark: SparkSession, on_items: Callable[[int, int, str], None] | None, items: DataFrame, stage: str, backend: Any, every: float = 0.5) -> Iterator[Any]:
    """``backend``, counted against the rows of ``items`` if there is anyone to tell."""
    if on_items is None:
        yield backend
        return
    total, done, over = items.count(), spark.sparkContext.accumulator(0), threading.Event()

    def tell() -> None:
        last = 0
        while not over.wait(every):
            now = min(done.value, max(total - 1, 0))
            if now > last:
                on_items(now, total, stage)
                last = now

    teller = threading.Thread(target=tell, daemon=True)
    teller.start()
    try:
        yield Counted(backend, done)
    finally:
        over.set()
        teller.join()
    on_items(total, total, stage)
