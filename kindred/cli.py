"""Command line: find similar code below a folder.

Exit codes: 0 for a finished run, one without clusters, and status commands; 1
for a missing folder, no chunks, a report file of unknown kind, or a model that
can't be fetched.
"""

from __future__ import annotations

import argparse
import shutil
import sys
from pathlib import Path

from kindred import __version__, backends, state
from kindred.config import NAMES, SECTION, RunConfig, load_config, merge
from kindred.operators.clusters import SORTS
from kindred.report import collect, format_of, report


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("kindred", description=__doc__)
    p.add_argument("path", nargs="?")
    yes_no = argparse.BooleanOptionalAction
    p.add_argument("-t", "--threshold", type=float)
    p.add_argument("-m", "--min-cluster", type=int)
    p.add_argument("-o", "--output", help="text, markdown, json, html, or a file that ends in .txt, .md, .json, .html")
    p.add_argument("--sort-by", choices=SORTS)
    p.add_argument("-e", "--exclude", action="append", default=[])
    p.add_argument("-f", "--focus", action="append", default=[])
    p.add_argument("-l", "--lang")
    p.add_argument("-v", "--verbose", action="store_const", const=True)
    for name in ("max-chunks", "batch-size", "min-lines", "max-lines", "max-analyze", "parallel"):
        p.add_argument(f"--{name}", type=int)
    p.add_argument("--analyze", action=yes_no)
    p.add_argument("--llm-model")
    p.add_argument("--rerank", action=yes_no)
    p.add_argument("--rerank-model")
    p.add_argument("--rerank-threshold", type=float)
    p.add_argument("--resume", action=yes_no)
    p.add_argument("-q", "--quiet", action="store_const", const=True)
    p.add_argument("--config-names", nargs="*", default=list(NAMES), help="settings files that are looked for, first wins")
    p.add_argument("--config-section", default=SECTION)
    p.add_argument("--clear-cache", action="store_true")
    p.add_argument("--model-status", action="store_true")
    p.add_argument("--fetch-models", nargs="*", choices=backends.PURPOSES, help="get the files that backends miss, of all purposes if none is named")
    p.add_argument("--show-state", action="store_true")
    p.add_argument("--clear-state", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    return p


def main(args: list[str] | None = None, spark=None, out=print) -> int:
    a = parser().parse_args(args)
    if a.model_status:
        out(backends.status())
        return 0
    if a.fetch_models is not None:
        got = backends.ensure(tuple(a.fetch_models) or backends.PURPOSES)
        for name, place in got.items():
            out(f"{name}: {place or 'failed'}")
        return int(None in got.values())
    root = Path(a.path or ".")
    if a.path is not None and not root.is_dir():
        out(f"{root} is not a folder")
        return 1
    if a.clear_cache:
        shutil.rmtree(root / state.FOLDER, ignore_errors=True)
        out("cache and state cleared")
        return 0
    if a.clear_state:
        out("state cleared" if state.clear_state(root) else "there is no state")
        return 0
    if a.show_state:
        saved = state.load_state(root)
        out(saved.summary() if saved else "there is no state")
        return 0
    if a.path is None:
        out("a folder is needed")
        return 1
    try:
        config: RunConfig = merge(load_config(root, tuple(a.config_names), a.config_section), vars(a))
        kind = format_of(config.output)
        chosen = {"scorer": backends.get("reranker", config.rerank_model), "generator": backends.get("llm", config.llm_model)}
    except (ValueError, FileNotFoundError) as e:
        out(str(e))
        return 1
    return analyse(root, config, kind, chosen, spark, out)


def analyse(root: Path, config: RunConfig, kind: str, chosen: dict, spark, out) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from kindred.operators.embed import VectorCache
    from kindred.plans.engine import run

    spark = spark or SparkSession.builder.appName("kindred").getOrCreate()
    project = str(root.resolve())
    saved = state.load_state(root) if config.resume else None
    now = state.RunState(project, state.snapshot(config), analyses=saved.analyses if saved and saved.project_path == project else {})
    known = None
    if now.analyses:
        known = spark.createDataFrame([{"cluster_key": k} | v for k, v in now.analyses.items()], "cluster_key string, commonality string, abstraction string, suggested_name string, complexity string, worth_refactoring boolean")

    def progress(i: int, n: int, stage: str) -> None:
        now.stage = stage
        state.save_state(root, now)
        if not config.quiet:
            print(f"[{i}/{n}] {stage}", file=sys.stderr)

    def items(done: int, total: int, stage: str) -> None:
        print(f"  {stage}: {done:,} of {total:,}", file=sys.stderr)

    cache = VectorCache(spark, (root / state.FOLDER / "vectors").resolve().as_uri())
    try:
        result = run(spark, project, config, cache=cache, known=known, progress=progress, on_items=None if config.quiet else items, **chosen)
    except Exception as e:
        now.last_error = str(e)
        state.save_state(root, now)
        raise
    now.total_chunks = now.embeddings_completed = result.chunks.count()
    if not now.total_chunks:
        state.save_state(root, now)
        out("no chunks found")
        return 1
    clusters = collect(result.clusters, result.members, result.analyses)
    for c in clusters:
        if c["analysis"]:
            now.analyses[c["cluster_key"]] = c["analysis"]
    now.clusters = [{"id": c["cluster_id"], "key": c["cluster_key"], "similarity": c["similarity"], "size": c["size"]} for c in clusters]
    now.analyses_completed = len(now.analyses)
    if result.failed is not None:
        now.failed_clusters = [r[0] for r in result.clusters.join(result.failed, "cluster_id").select(F.col("cluster_key")).collect()]
    now.stage = "complete"
    state.save_state(root, now)
    if not clusters:
        out("no similar code found")
        return 0
    made = report(clusters, project, config.threshold, kind)
    if config.output and config.output != kind:
        Path(config.output).write_text(made, encoding="utf-8")
        out(f"report written to {config.output}")
    else:
        out(made)
    return 0


if __name__ == "__main__":
    sys.exit(main())
