import os

import pytest
from pyarrow import fs as pafs

from kindred.examples import BODIES, CASES
from kindred.sources import chunkers
from kindred.sources.chunkers import Chunker, Region, chunk_files, chunk_text, register_chunker
from kindred.sources.files import TreeReader, scan
from kindred.sources.languages import detect_language, extensions_for

def test_regions_of_each_language():
    for language, (source, want) in CASES.items():
        got = [(r[1], r[2], r[5], r[6], r[7]) for r in chunk_text(source, "f", language, 2, 100)]
        assert got == want, language


def test_limits_parts_and_fallback():
    source = "def f():\n" + "    x = 1\n" * 30
    assert [(r[1], r[2], r[5], r[6]) for r in chunk_text(source, "p", "python", 5, 20)] == [(1, 20, "function_part", "f_part1"), (21, 31, "function_part", "f_part2")]
    assert chunk_text("def f(): pass\n", "p", "python", 5, 20) == []
    assert {r[8] for r in chunk_text("def (:\n" * 10, "p", "python")} == {"WindowChunker"}
    assert {r[8] for r in chunk_text("x\n" * 10, "p", "cobol")} == {"WindowChunker"}


class Whole(Chunker):
    def regions(self, text, min_lines, max_lines):
        yield Region(1, text.count("\n") + 1, "file")


def test_registry(spark):
    register_chunker("cobol", Whole)
    try:
        files = spark.createDataFrame([("a", "cobol", "x\n" * 9), ("b", None, None)], "file_path string, language string, content string")
        assert [(r["chunk_type"], r["chunker_used"]) for r in chunk_files(files).collect()] == [("file", "Whole")]
    finally:
        chunkers._registry.clear()


def test_scan(spark, tmp_path):
    for name, body in {"a.py": b"x\r\ny\rz", "_h/__init__.py": b"q", ".dot.py": b"\xff\xfeok", "b.txt": b"no", "node_modules/c.js": b"no", "d.RS": b"r", "e.kt": b"k"}.items():
        (tmp_path / os.path.dirname(name)).mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rows = {r["file_path"]: r for r in scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.py", "_h/__init__.py", ".dot.py", "d.RS", "e.kt"}
    assert rows["a.py"]["content"] == "x\ny\nz" and rows[".dot.py"]["content"] == b"\xff\xfeok".decode(errors="replace")
    assert rows["d.RS"]["language"] == "rust" and rows["e.kt"]["language"] == "kotlin"
    assert {r["file_path"] for r in scan(spark, str(tmp_path), exclude=["_h/*"], focus=["*.py"]).collect()} == {"a.py", ".dot.py"}
    assert scan(spark, str(tmp_path), language="nothing").count() == 0
    assert [r["language"] for r in scan(spark, str(tmp_path), language="kotlin").collect()] == ["kotlin"]


def test_excluded_folder_above(spark, tmp_path):
    root = tmp_path / "node_modules" / "p"
    root.mkdir(parents=True)
    (root / "a.py").write_bytes(b"q")
    assert scan(spark, str(root)).count() == 0 and scan(spark, str(root), absolute_excludes=False).count() == 1
    assert scan(spark, str(root), absolute_excludes=False, exclude=[f"{tmp_path}/*"]).count() == 1


def test_scan_of_uris_and_other_stores(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.py").write_bytes(b"q")
    (tmp_path / "b.py").write_bytes(b"rr")
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        assert sorted((r["file_path"], r["size"]) for r in scan(spark, root).collect()) == [("b.py", 2), ("x/a.py", 1)]
    reader = TreeReader({"path": "/", "extensions": ".py", "partitionBytes": "2"})
    reader.files, reader.root = pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem()), ""
    parts = reader.partitions()
    assert len(parts) == 2 and sorted(r[0] for p in parts for r in reader.read(p)) == ["b.py", "x/a.py"]
    with pytest.raises(Exception, match="nosuch"):
        scan(spark, "nosuch://host/folder").collect()


def test_languages():
    assert detect_language("x/y.TSX") == "typescript" and detect_language("x") is None
    assert ".h" in extensions_for("cpp") and detect_language("a.h") == "c" and extensions_for("none") == set()


@pytest.mark.parametrize("language", sorted(BODIES))
def test_bodies_without_blocks_and_with_errors(language):
    source, want = BODIES[language]
    assert [(r[1], r[2], r[5], r[6], r[7]) for r in chunk_text(source, "f", language, 2, 100)] == want


def test_nothing_found_gives_windows():
    source = "use std::fmt;\n" * 12
    assert [(r[1], r[2], r[5], r[8]) for r in chunk_text(source, "f", "rust")] == [(1, 13, "block", "WindowChunker")]
