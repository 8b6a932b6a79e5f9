import random

import pytest
from pyspark.sql import functions as F

from kindred.operators.windows import sliding_windows, split_oversized
from kindred.sources.chunkers import WindowChunker


def walk(rows, low_lines, high_lines):
    """Windows, found one after another."""
    out, i, n = [], 0, len(rows)
    while i == 0 or n - i >= low_lines:
        if n < low_lines:
            break
        end = min(i + high_lines, n)
        if end < n:
            for j in range(end - 1, max(i + low_lines, end - 10), -1):
                if rows[j].strip() == "":
                    end = j
                    break
        if end - i >= low_lines:
            out.append((i + 1, end))
        i += high_lines - 5
    return out


def test_windows_like_a_walk(spark):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(["", " ", "x", "y z"]) for _ in range(rng.randint(0, 90))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    for low, high in ((5, 20), (1, 6), (12, 30)):
        got: dict = {}
        for r in sliding_windows(df, min_lines=low, max_lines=high).collect():
            got.setdefault(r["i"], []).append((r["start_line"], r["end_line"]))
            assert r["content"] == "\n".join(texts[r["i"]].split("\n")[r["start_line"] - 1 : r["end_line"]])
        for i, t in enumerate(texts):
            want = walk(t.split("\n"), low, high)
            assert got.get(i, []) == want
            assert [(x.start, x.end) for x in WindowChunker().regions(t, low, high)] == want


def test_bounds():
    with pytest.raises(ValueError, match="max_lines"):
        sliding_windows(None, min_lines=1, max_lines=5)


def test_parts(spark):
    rows = [("a", 11, 35, "\n".join(map(str, range(25))), "function", "f"), ("b", 1, 10, "\n".join("x" * 10), "method", None), ("c", 1, 21, "\n".join(map(str, range(21))), "block", None)]
    df = spark.createDataFrame(rows, "p string, start_line int, end_line int, content string, chunk_type string, name string")
    got = [(r["p"], r["start_line"], r["end_line"], r["chunk_type"], r["name"], r["content"].count("\n")) for r in split_oversized(df, 10).orderBy("p", "start_line").collect()]
    assert got == [
        ("a", 11, 20, "function_part", "f_part1", 9), ("a", 21, 30, "function_part", "f_part2", 9), ("a", 31, 35, "function_part", "f_part3", 4),
        ("b", 1, 10, "method", None, 9), ("c", 1, 10, "block_part", None, 9), ("c", 11, 20, "block_part", None, 9), ("c", 21, 21, "block_part", None, 0),
    ]
    assert split_oversized(df.filter(F.lit(False)), 10).count() == 0
