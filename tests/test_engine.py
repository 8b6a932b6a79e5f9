import json
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred import backends, cli, config, report, schema, state
from kindred.operators import analyze, embed, rerank
from kindred.plans import engine
from kindred.shared import shared_dir
from kindred.streaming.incremental import embed_stream, file_stream

SOURCE = "class {0}:\n    def total(self, rows):\n        out = 0\n        for r in rows:\n            out += r.value\n            print(r)\n        return out\n\n\ndef other_{0}(x):\n    y = x + 1\n    z = y * 2\n    w = z - 3\n    return w\n"


@pytest.fixture
def project(tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.py").write_text(SOURCE.format(name.upper()))
    return tmp_path


def test_embedder():
    x = embed.HashingEmbedder().embed(["sum the rows", "sum the rows", "Sum The Rows", "", None, "other words here"])
    assert np.allclose(x[0], x[1]) and np.allclose(x[0], x[2]) and not x[3].any() and not x[4].any()
    assert np.isclose(np.linalg.norm(x[0]), 1) and x[0] @ x[5] < 0.5


def test_cache(spark):
    cache = embed.VectorCache(spark, shared_dir(spark) + "/test-cache")
    cache.clear()
    assert cache.stats() == {"entries": 0, "models": [], "mb": 0.0}
    calls = []

    class Counted(embed.HashingEmbedder):
        def embed(self, texts):
            calls.append(len(texts))
            return super().embed(texts)

    chunks = spark.createDataFrame([("a", "one two"), ("b", "three"), ("b", "three")], "file_path string, embed_text string")
    first = embed.embed_cached(chunks, cache).collect()
    assert len(first) == 3 and cache.stats()["entries"] == 2
    more = chunks.unionByName(spark.createDataFrame([("c", "four")], chunks.schema))
    assert embed.misses(more.withColumn("chunk_hash", F.sha2("embed_text", 256)), cache.read(), "hashing-256").count() == 1
    assert len(embed.embed_cached(more, cache, backend=Counted()).collect()) == 4
    cache.upsert(spark.createDataFrame([("a", "h", [1.0], "m2")], "file_path string, chunk_hash string, embedding array<float>, model_id string"))
    assert cache.stats()["models"] == ["hashing-256", "m2"] and cache.stats()["entries"] == 4
    cache.delete_model("m2")
    cache.delete_file("a")
    cache.vacuum()
    assert sorted(r["file_path"] for r in cache.read().collect()) == ["b", "c"]


def test_scores(spark):
    assert rerank.parse_score("", {" Yes": 0.6, "no": 0.2, "x": 0.9}) == pytest.approx(0.75)
    assert [rerank.parse_score(t) for t in ("yes.", "No", "irrelevant", "perhaps")] == [0.75, 0.25, 0.25, 0.5]
    df = spark.createDataFrame([("a b c", "b c d"), ("", None), ("X", "x")], "q string, d string")
    got = [r["score"] for r in rerank.score_pairs(df, "q", "d").collect()]
    assert got == [0.5, None, 1.0]


def test_answers():
    good = {"commonality": "Both regions add up the rows.", "abstraction": "Make one function of the two loops.", "suggested_name": "n/a", "complexity": "Huge", "worth_refactoring": "yes"}
    whole = json.dumps(good)
    want = good | {"suggested_name": "sharedUtility", "complexity": "medium", "worth_refactoring": True}
    for text in (whole, whole[2:], f"<think>{{x</think>{whole}", f"```json\n{whole}\n```", f"text {whole} more {{}}"[5:], f"```\n{whole}"):
        assert analyze.read_answer(text) == want, text
    no = analyze.read_answer(json.dumps(good | {"worth_refactoring": False, "complexity": ""}))
    assert (no["suggested_name"], no["complexity"], no["worth_refactoring"]) == ("n/a", "n/a", False)
    for bad in (None, "", "{", "{}", "[]", json.dumps(good | {"abstraction": "short"}), json.dumps(good | {"suggested_name": 3})):
        assert analyze.read_answer(bad) is None


def test_config(tmp_path):
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    (tmp_path / ".kindred.toml").write_text('[kindred]\nthreshold = 0.9\nsort_by = "lines"\nexclude = ["x"]\nfocus = "y"\nother = 1\n')
    got = config.merge(config.load_config(inner), {"threshold": 0.8, "exclude": [], "min_lines": None})
    assert (got.threshold, got.sort_by, got.exclude, got.focus, got.min_lines) == (0.8, "lines", ("x",), (), 5)
    (tmp_path / ".kindredrc").write_text("[kindred")
    assert config.load_config(inner) == {}
    with pytest.raises(ValueError):
        config.RunConfig(output="x.pdf")


def test_state(tmp_path):
    c = config.RunConfig()
    assert state.can_resume(tmp_path, c) == (False, "there is no saved run", None)
    state.save_state(tmp_path, state.RunState(str(tmp_path), state.snapshot(c), stage="embedding"))
    assert state.can_resume(tmp_path, c)[0]
    assert state.can_resume(tmp_path, config.RunConfig(threshold=0.5))[1] == "threshold changed"
    state.path_of(tmp_path).write_text("{")
    assert state.load_state(tmp_path) is None
    assert state.clear_state(tmp_path) and not state.clear_state(tmp_path)


def test_command_line(spark, project):
    said: list = []
    run = lambda *a: cli.main([str(project), "-q", "-t", "0.7", *a], spark, said.append)
    assert run("--analyze", "-o", "json") == 0
    doc = json.loads(said[-1])
    assert doc["meta"]["cluster_count"] == len(doc["clusters"]) >= 2 and doc["clusters"][0]["analysis"]["worth_refactoring"]
    assert {r["file"] for c in doc["clusters"] for r in c["regions"]} == {"a.py", "b.py", "c.py"}
    saved = state.load_state(project)
    assert saved.stage == "complete" and len(saved.analyses) == len(doc["clusters"])
    assert run("-o", str(project / "r.html")) == 0 and "<!doctype html>" in (project / "r.html").read_text()
    assert len(state.load_state(project).analyses) == len(saved.analyses)  # a run without analysis keeps them
    for kind, mark in (("markdown", "| Place |"), ("text", "Representative:")):
        assert run("-o", kind) == 0 and mark in said[-1]
    assert run("-o", "r.pdf") == 1 and cli.main([str(project / "none")], spark, said.append) == 1
    assert cli.main([str(project), "-q", "-f", "*.none"], spark, said.append) == 1
    assert cli.main([str(project), "--show-state"], spark, said.append) == 0 and "Chunks" in said[-1]
    assert cli.main([str(project), "--clear-cache"], spark, said.append) == 0 and state.load_state(project) is None
    assert cli.main(["--model-status"], spark, said.append) == 0


def test_backends(tmp_path):
    assert isinstance(backends.get("embedding"), embed.HashingEmbedder)
    backends.register(backends.Backend("llm", "filed", lambda path: path, needs=str(tmp_path / "model")))
    try:
        assert [b.name for b in backends.missing()] == ["filed"] and "needs" in backends.status()
        with pytest.raises(FileNotFoundError):
            backends.get("llm", "filed")
        assert backends.get("llm", "filed:/other") == "/other"
        (tmp_path / "model").write_text("x")
        assert backends.get("llm", "filed") == str(tmp_path / "model") and backends.get("llm", "filed:/other") == "/other"
    finally:
        del backends._known["llm", "filed"]
    with pytest.raises(ValueError, match="no reranker"):
        backends.get("reranker", "x")


def test_schemas(spark, project):
    seen: list = []
    result = engine.run(spark, str(project), config.RunConfig(threshold=0.7, analyze=True, parallel=2), on_analysis=lambda k, a: seen.append(k))
    assert schema.conforms(result.chunks, schema.CHUNK) and schema.conforms(result.members, schema.MEMBER)
    assert schema.conforms(result.clusters, schema.CLUSTER) and schema.conforms(result.analyses, schema.ANALYSIS)
    assert schema.conforms(result.rerank_stats, schema.RERANK_STATS)
    assert sorted(seen) == sorted(r[0] for r in result.analyses.select("cluster_id").collect()) and seen
    assert report.report_frame(result.clusters, result.members, result.analyses).count() == result.clusters.count()


def test_report_escapes():
    member = {"cluster_id": 1, "member_idx": 0, "file_path": "<a>|b", "start_line": 1, "end_line": 2, "chunk_type": "block", "name": None, "content": "<script>\n```", "language": "c"}
    row = {"cluster_id": 1, "similarity": 0.125, "file_count": 1, "size": 2, "total_lines": 1234, "members": [member, member], "representative": member, "analysis": None}
    assert "<script>\n" not in report.html_report([row], "r", 0.8) and "1,234" in report.html_report([row], "r", 0.8)
    assert "\\|b" in report.markdown_report([row], "r", 0.8) and "````" in report.markdown_report([row], "r", 0.8)
    assert "12%" in report.text_report([row], "r", 0.8)


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("a.py", "python", SOURCE.format("A")), ("b.py", "python", SOURCE.format("B"))]
    frame = spark.createDataFrame(rows, "file_path string, language string, content string")
    frame.limit(1).write.parquet(str(source))
    cache = embed.VectorCache(spark, f"file://{tmp_path}/cache")
    for more in (None, frame):
        if more is not None:
            more.write.mode("append").parquet(str(source))
        embed_stream(file_stream(spark, str(source)), cache, str(tmp_path / "check")).awaitTermination()
    assert cache.read().select("file_path").distinct().count() == 2 and cache.stats()["entries"] == 6


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r["size"] >= 2 and r["similarity"] > 0.79 for r in rows)
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries)


def test_reports_have_every_cluster(spark):
    """1,200 clusters, with whole texts for representatives and first lines for the others."""
    from kindred import report

    n = 1200
    clusters = spark.range(1, n + 1).selectExpr("id AS cluster_id", "id AS position", "0.9D AS similarity", "2L AS size", "1L AS file_count", "4L AS total_lines", "1L AS representative")
    members = spark.range(0, 2 * n).selectExpr("id div 2 + 1 AS cluster_id", "id % 2 AS member_idx", "concat('f', id) AS file_path", "1 AS start_line", "2 AS end_line", "'block' AS chunk_type", "cast(null AS string) AS name", "concat('first ', id, '\\nsecond') AS content")
    analyses = clusters.selectExpr("cluster_id", "'same' AS commonality", "'x' AS suggested_name")
    found = report.collect(clusters, members, analyses)
    assert len(found) == n and all(c["analysis"]["commonality"] == "same" for c in found)
    assert [m["content"] for m in found[4]["members"]] == ["first 8\nsecond", "first 9\nsecond"]  # the first member, and the representative
    assert found[4]["representative"]["file_path"] == "f9"
    assert len(report.collect(clusters, members, most=3)) == 3


def test_model_files(tmp_path, monkeypatch):
    """An explicit path comes first, then fetched files, then further folders; a fetch needs a source."""
    monkeypatch.setattr(backends, "home", tmp_path / "home")
    monkeypatch.setattr(backends, "folders", [tmp_path / "other"])
    (tmp_path / "far").write_text("far")
    b = backends.Backend("llm", "filed", lambda path: path, "m.bin", (tmp_path / "far").as_uri())
    unknown = backends.Backend("reranker", "lost", lambda path: path, "l.bin")
    monkeypatch.setattr(backends, "_known", {("llm", "filed"): b, ("reranker", "lost"): unknown})
    assert b.find() is None and not b.available and backends.missing(("llm",)) == [b]
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "m.bin").write_text("dev")
    assert backends.get("llm", "filed") == str(tmp_path / "other" / "m.bin")
    said = []
    assert cli.main(["--fetch-models", "reranker"], None, said.append) == 1 and said == ["lost: failed"]
    assert backends.fetch(b) == str(tmp_path / "home" / "m.bin") == b.find()
    assert Path(b.find()).read_text() == "far" and os.listdir(tmp_path / "home") == ["m.bin"]
    assert b.find(str(tmp_path / "far")) == str(tmp_path / "far")
    assert backends.ensure(("llm",)) == {} and cli.main(["--fetch-models", "llm"], None, said.append) == 0


def test_items_are_counted(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"f{i}.py").write_text("def same(a, b):\n    total = a + b\n    total = total * 2\n    print(total)\n    return total\n")
    seen = []
    engine.run(spark, str(tmp_path), config.RunConfig(analyze=True, rerank=True), on_items=lambda *x: seen.append(x))
    assert (4, 4, "embedding") in seen and (4, 4, "reranking") in seen and (1, 1, "analyzing") in seen
    assert all(done <= total for done, total, _ in seen)
