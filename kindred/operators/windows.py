"""Chunking by lines: sliding windows that end at blank lines, and parts of what is too long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import is_blank, let, lines

OVERLAP = 5


def check_sizes(min_lines: int, max_lines: int) -> None:
    if max_lines <= OVERLAP:
        raise ValueError(f"max_lines must be above {OVERLAP}: windows overlap by so many lines")
    if min_lines < 1:
        raise ValueError("min_lines must be 1 or more")


def _window(text: Column, i: Column, n: Column, min_lines: int, max_lines: int) -> Column:
    """End of the window at ``i``: the last blank line among its last ten, if it is not the end of the text."""
    end = F.least(i + max_lines, n)
    low, high = F.greatest(i + min_lines, end - 10) + 1, end - 1
    blanks = F.filter(F.sequence(low, F.greatest(low, high)), lambda j: (j <= high) & is_blank(F.get(text, j)).eqNullSafe(True))
    end = F.when(end < n, F.coalesce(F.array_max(blanks), end)).otherwise(end)
    return F.struct((i + 1).cast("int").alias("start_line"), end.cast("int").alias("end_line"), F.array_join(F.slice(text, i + 1, end - i), "\n").alias("content"))


def sliding_windows(files: DataFrame, content: str = "content", min_lines: int = 5, max_lines: int = 100) -> DataFrame:
    """A row for each window of each file: the file's other columns, start_line, end_line, content."""
    check_sizes(min_lines, max_lines)
    step = max_lines - OVERLAP

    def windows(text: Column) -> Column:
        n = F.size(text)
        starts = F.when(n >= min_lines, F.sequence(F.lit(0), n - min_lines, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(starts, lambda i: _window(text, i, n, min_lines, max_lines)), lambda w: w["end_line"] - w["start_line"] + 1 >= min_lines)

    others = [F.col(c) for c in files.columns if c not in (content, "start_line", "end_line")]
    return files.select(*others, F.inline(let(lines(F.coalesce(F.col(content), F.lit(""))), windows)))


def split_oversized(chunks: DataFrame, max_lines: int = 100) -> DataFrame:
    """Chunks of more than ``max_lines`` lines as consecutive parts; the others as they are.

    A part has type ``<type>_part`` and name ``<name>_part<k>``, or none.
    """
    n = F.col("end_line") - F.col("start_line") + 1
    text = lines(F.col("content"))
    whole = F.array(F.struct(F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.col("content").alias("content"), F.col("chunk_type").alias("chunk_type"), F.col("name").alias("name")))
    first = F.col("start_line")

    def parts(t: Column) -> Column:
        size = F.size(t)
        return F.transform(
            F.sequence(F.lit(0), F.ceil(size / max_lines).cast("int") - 1),
            lambda k: F.struct(
                (first + k * max_lines).cast("int").alias("start_line"),
                (first + F.least((k + 1) * max_lines, size) - 1).cast("int").alias("end_line"),
                F.array_join(F.slice(t, k * max_lines + 1, max_lines), "\n").alias("content"),
                F.concat(F.col("chunk_type"), F.lit("_part")).alias("chunk_type"),
                F.concat(F.col("name"), F.lit("_part"), k + 1).alias("name"),
            ),
        )

    others = [F.col(c) for c in chunks.columns if c not in ("start_line", "end_line", "content", "chunk_type", "name")]
    return chunks.select(*others, F.inline(F.when(n > max_lines, let(text, parts)).otherwise(whole)))
