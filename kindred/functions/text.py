"""Text functions as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's rstrip() takes off, as a Java regular expression class.
WHITE = "[\\s\\x1c-\\x1f\\x85\\p{Z}]"
BLANK = f"^{WHITE}*$"
MOST_CHARS = 2048


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def is_blank(line: Column) -> Column:
    return line.rlike(BLANK)


def chunk_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_id(path: Column, start: Column, end: Column, content: Column) -> Column:
    return F.concat(path, F.lit(":"), start, F.lit("-"), end, F.lit(":"), F.substring(F.sha2(content, 256), 1, 12))


def location(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start, F.lit("-"), end)


def line_count(start: Column, end: Column) -> Column:
    return end - start + 1


def preview(content: Column, most: int = 60) -> Column:
    """The stripped first line, cut to ``most`` characters with dots."""
    first = F.regexp_replace(F.get(lines(content), F.lit(0)), f"^{WHITE}+|{WHITE}+$", "")
    return F.when(F.length(first) > most, F.concat(F.substring(first, 1, most - 3), F.lit("..."))).otherwise(first)


def normalize(text: Column, most: int = MOST_CHARS) -> Column:
    """Lines without trailing space, runs of blank lines as one, cut to ``most`` characters with a note."""
    stripped = F.transform(lines(text), lambda x: F.regexp_replace(x, f"{WHITE}+$", ""))
    single = let(stripped, lambda a: F.filter(a, lambda x, i: ~((x == "") & (i > 0) & (F.get(a, i - 1) == "").eqNullSafe(True))))
    joined = F.array_join(single, "\n")
    return F.when(F.length(joined) > most, F.concat(F.substring(joined, 1, most), F.lit("\n# ... (truncated)"))).otherwise(joined)


def embedding_text(language: Column, chunk_type: Column, name: Column, content: Column) -> Column:
    """A heading with language, type and name, then the normalised content."""
    named = F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(": "), name)).otherwise("")
    return F.concat(F.lit("# "), language, F.lit(" "), chunk_type, named, F.lit("\n"), normalize(content))


def cut(text: Column, most: int, note: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(note))).otherwise(text)


def first_lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(lines(text), 1, n), "\n")
