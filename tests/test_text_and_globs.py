import fnmatch
import random
import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import globs, text

PART = st.text("ab/.[]!*?-é\n", max_size=8)


@given(PART, st.lists(PART, min_size=1, max_size=6))
def test_globs_match_like_fnmatch(glob, paths):
    pattern = re.compile(globs.glob_to_regex(glob).replace(r"\z", r"\Z"))
    if re.search(r"\[[^\]]*(--|-[^\]]*-|[/é\n!.*?]-|-[/é\n!.*?])", glob):
        return  # ranges between marks aren't portable
    for p in paths:
        assert bool(pattern.match(p)) == fnmatch.fnmatchcase(p, glob), (glob, p)


def test_globs_in_spark(spark):
    cases = [("a/b.py", "*.py"), ("a\n", "a"), ("x/tests/y", "**/tests/**"), ("tests/y", "**/tests/**"), ("[a", "[[]a"), ("b", "[!a]"), ("a", "[!a]"), ("a+b", "a+b")]
    df = spark.createDataFrame(cases, "p string, g string")
    for p, g in cases:
        got = df.filter(F.col("p") == p).select(globs.matches(F.col("p"), [g])).first()[0]
        assert got == fnmatch.fnmatchcase(p, g), (p, g)


def test_selection(spark):
    paths = ["src/a.py", "node_modules/x.js", "src/build/x.c", "lib/b.py", "src/a.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r[0] for r in df.filter(globs.selected(F.col("p"), None, ["lib/*"], ["*.py", "*.js"])).collect()}
    assert got == {"src/a.py"}
    absolute = F.concat(F.lit("/x/build/"), "p")
    assert df.filter(globs.selected(F.col("p"), absolute)).count() == 0


def normalized(s, most=2048):
    out = []
    for line in s.split("\n"):
        line = line.rstrip()
        if line or not out or out[-1]:
            out.append(line)
    joined = "\n".join(out)
    return joined[:most] + "\n# ... (truncated)" if len(joined) > most else joined


def test_normalize(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab \n\n\t\x0b\x1c\x85\xa0　") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["x" * 5000, "", "\n\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", text.normalize(F.col("t")).alias("n")).collect():
        assert r["n"] == normalized(texts[r["i"]]), repr(texts[r["i"]])


def test_previews_and_ids(spark):
    df = spark.createDataFrame([("p", 3, 5, "  " + "é" * 70 + "  \nx"), ("p", 1, 1, "short")], "path string, s int, e int, c string")
    a, b = df.select(text.preview(F.col("c")).alias("p"), text.location(F.col("path"), F.col("s"), F.col("e")).alias("l"), text.line_count(F.col("s"), F.col("e")).alias("n")).collect()
    assert a["p"] == "é" * 57 + "..." and a["l"] == "p:3-5" and a["n"] == 3 and b["p"] == "short"
